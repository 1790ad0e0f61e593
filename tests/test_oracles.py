"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from tradewind.plans import queries_io  # noqa: F401
from tradewind.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: One or two of each family; the driver compares all of them.
NAMES = [n for n in QUERIES if n.split("_")[0] in ("a1", "a2", "a3", "a9", "a31", "src9", "src11", "src16", "p8", "p11", "j2", "j3", "j8", "j12", "j15", "j17", "j18", "w1", "w3", "w7", "t5", "u6", "d3", "d4", "d9", "snk5", "f2", "f4", "f10", "l3", "q5", "q7", "r2", "r5", "m1", "v2", "v7", "st1", "st5", "g6", "g13", "src6", "snk3", "snk8", "snk14", "d8", "g7", "g9")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(found.fetchall(), columns)


def test_fallback_join_takes_touches_of_all_lines(spark):
    all_hits, some = (QUERIES[n](spark, SF) for n in ("j17_multi_key_fallback_all", "j17_multi_key_fallback"))
    assert some.subtract(all_hits).count() == 0 and all_hits.count() > 2 * some.count()


def test_every_query_has_sql():
    assert not set(QUERIES) ^ set(ORACLES)
