"""Keyed tables, split histories, and order within keys by ranges."""

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tradewind.operators import aggregates as A
from tradewind.operators import joins as J
from tradewind.operators import ranges, scd
from tradewind.operators import windows as W
from tradewind.operators.history import History, open_history
from tradewind.sources.sinks import stored
from tradewind.sources.tables import KeyedTable, read_state, upsert_row

ts = lambda t: F.lit(t).cast("timestamp")


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_upsert_reads_and_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.create(spark.range(20_000).select("id", F.lit("old").alias("v")), path, ["id"], 1000)
    before, state = _files(path), table.manifest()
    source = spark.range(0, 20_000, 1000).select("id", F.lit("new").alias("v")).union(spark.createDataFrame([(-1, "new")], "id bigint, v string"))
    touched = table.upsert(source)
    assert 1 < len(touched) <= 21
    scanned = {b for f in table.read(state, touched).inputFiles() for b in [int(f.split("__bucket=")[1].split("/")[0])]}
    assert scanned == touched
    after = _files(path)
    assert before.items() <= after.items()
    assert {int(f.split("__bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} == touched
    assert {r["v"]: r["count"] for r in table.read().groupBy("v").count().collect()} == {"old": 19_980, "new": 21}
    assert len(table.manifest()["folders"]) == 2 and table.read().columns == ["id", "v"]


def test_keyed_table_equals_a_dictionary(spark, tmp_path):
    r, table, want = random.Random(1), None, {}
    for n in range(5):
        rows = {r.choice([None, *range(30)]): (r.choice(["x", None]), n) for _ in range(12)}
        df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k int, v string, n int")
        want |= rows
        if table is None:
            table = KeyedTable.create(df, str(tmp_path / "t"), ["k"], 4)
        else:
            table.upsert(df)
        assert {x["k"]: (x["v"], x["n"]) for x in table.read().collect()} == want and table.read().count() == len(want)
    table.upsert(spark.createDataFrame([(99, 1.5)], "k int, extra double"))
    assert tuple(table.read().where("k = 99").first()) == (99, None, None, 1.5) and table.read().where("extra is null").count() == len(want)
    assert table.upsert(table.read().limit(0)) == set()
    gone = table.vacuum()
    assert gone and table.read().count() == len(want) + 1 and len(table.folder.names("versions")) == 1


def test_keyed_table_refuses(spark, tmp_path):
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="several rows"):
        KeyedTable.create(two, str(tmp_path / "a"), ["k"], 2)
    table = KeyedTable.create(two.limit(1), str(tmp_path / "b"), ["k"], 2)
    with pytest.raises(ValueError, match="already"):
        KeyedTable.create(two.limit(1), str(tmp_path / "b"), ["k"], 2)
    state = table._merged(table.manifest(), spark.createDataFrame([(5, "c")], "k int, v string"))[0]
    table.upsert(spark.createDataFrame([(6, "d")], "k int, v string"))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(state)
    assert table.read().count() == 2
    empty = KeyedTable.create(two.limit(0), str(tmp_path / "c"), ["k"], 2)
    assert read_state(spark, str(tmp_path / "none")) is None and empty.read().count() == 0
    assert upsert_row(spark, str(tmp_path / "d"), "k", two.limit(1)).count() == upsert_row(spark, str(tmp_path / "d"), "k", two.limit(1)).count() == 1


def test_merge_leaves_closed_files_alone(spark, tmp_path):
    path = str(tmp_path / "h")
    snap = lambda rows: spark.createDataFrame(rows, "sku string, season string")
    day = lambda n: ts(f"2020-01-{n:02d}")
    history = History.begin(snap([(f"s{k}", "a") for k in range(200)]), path, "sku", ["season"], day(1), 50)
    plain = scd.seed_history(snap([(f"s{k}", "a") for k in range(200)]), "sku", ["season"], day(1))
    before = _files(path)
    for n, rows in enumerate(([("s3", "b"), ("new", None)], [("s3", "c"), ("s4", "b"), ("s5", "a")], [("s3", "c")], [("new", "x")]), 2):
        touched = history.merge(snap(rows), day(n))
        plain = scd.merge(plain, snap(rows), "sku", ["season"], day(n))
        after = _files(path)
        assert before.items() <= after.items()  # nothing that was there is rewritten
        live = [f for f in after.keys() - before.keys() if "/__bucket=" in f]
        assert {int(f.split("__bucket=")[1].split("/")[0]) for f in live} == touched and len(touched) == len([x for x in rows if x[0] != "s5"]) * (n != 4)
        before = after
    rows = lambda df: sorted(map(tuple, df.select("product_key", "sku", "season", "effective_from", "effective_to", "is_current").collect()), key=repr)
    assert rows(history.all_versions()) == rows(plain) and history.closed().count() == 4
    assert tuple(scd.integrity(history.all_versions(), "sku").first())[1:4] == (0, 0, 0)
    assert history.live().count() == 201 and open_history(spark, path).manifest()["top"] == plain.agg(F.max("product_key")).first()[0]
    assert open_history(spark, str(tmp_path / "none")) is None
    history.vacuum()
    assert rows(history.all_versions()) == rows(plain)


def _events(r, n, keys):
    base = dt.datetime(2024, 1, 1)
    return [(k, r.choice(keys), base + dt.timedelta(hours=r.randint(0, 400))) for k in range(n)]


def test_as_of_join_by_one_sort(spark):
    r = random.Random(2)
    base, keys = dt.datetime(2024, 1, 1), ["hot"] * 6 + ["a", "b", None, "none"]
    facts = _events(r, 600, keys) + [(1000, "a", None)]
    versions, open_end = [], dt.datetime(9999, 12, 31)
    for key, n in (("hot", 60), ("a", 3), ("b", 1), ("unused", 5)):
        starts = sorted(r.sample(range(400), n))
        for x, (at, after) in enumerate(zip(starts, [*starts[1:], None], strict=True)):
            end = open_end if after is None else base + dt.timedelta(hours=after - (x % 3 == 1))
            versions.append((f"{key}{at}", key, base + dt.timedelta(hours=at), end))
    f = spark.createDataFrame(facts, "id int, key string, at timestamp")
    v = spark.createDataFrame(versions, "version string, key string, effective_from timestamp, effective_to timestamp")
    got = {x["id"]: x["v_version"] for x in J.as_of_join(f, v, "key", "at").collect()}
    want = {i: next((n for n, k, a, b in versions if k == key and at and a <= at < b), None) for i, key, at in facts}
    assert got == want and len([x for x in got.values() if x]) > 300
    assert J.as_of_join(f, v.limit(0), "key", "at").where("v_version is not null").count() == 0 and J.as_of_join(f.limit(0), v, "key", "at").count() == 0
    rows = ranges.cut(f.where("key = 'hot'"), ["key"], ["at", "id"], 8)
    sizes = [x["count"] for x in rows.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == rows.parts >= 7 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_numbers_within_hot_keys(spark):
    r = random.Random(3)
    rows = _events(r, 3000, [1, 1, 1, 2, 3, None]) + [(k, 10 + k % 700, dt.datetime(2024, 2, 1)) for k in range(3000, 5000)]
    df = spark.createDataFrame(rows, "id int, customer_id int, created_at timestamp")
    got = {x["id"]: (x["order_seq"], x["cohort_month"]) for x in W.order_sequence(df).collect()}
    want, n, first = {}, Counter(), {}
    for i, key, at in sorted(rows, key=lambda x: (x[2], x[0])):
        n[key] += 1
        first.setdefault(key, at.date().replace(day=1))
        want[i] = (n[key], first[key])
    assert got == want
    plan = W.order_sequence(df)._jdf.queryExecution().toString()
    assert plan.count("SinglePartition") == 0
    assert W.order_sequence(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10, 200_000])
def test_surrogate_keys_of_any_size(spark, n):
    df = spark.range(n).select(F.lpad(F.reverse(F.col("id").cast("string")), 9, "0").alias("sku"))
    keyed = W.surrogate_key(df, "sku", "key", 5)
    assert dict(keyed.dtypes)["key"] == "bigint"
    if n <= 10:
        assert [r["key"] for r in keyed.orderBy("sku").collect()] == list(range(6, 6 + n))
    else:
        wrong = keyed.orderBy("sku").select((F.col("key") - 6).alias("key")).toPandas()["key"]
        assert wrong.tolist() == list(range(n))


def test_exact_quantiles_of_a_hot_day(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([None, r.randint(-50, 5000), 7])) for _ in range(4000)] + [("one", 3), ("none", None)]
    df = spark.createDataFrame(rows, "day string, cents bigint")
    at = {"p0": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x["day"]: (x["n"], *[x[n] for n in at]) for x in A.exact_quantiles(df, ["day"], "cents", at).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (day VARCHAR, cents BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = {x[0]: x[1:] for x in con.execute(f"SELECT day, count(cents), {', '.join(f'quantile_cont(cents, {p})' for p in at.values())} FROM t GROUP BY 1").fetchall()}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
    cut = ranges.cut(df.where("day = 'hot' and cents is not null").groupBy("day", "cents").count(), ["day"], ["cents"], 8)
    sizes = [x["count"] for x in cut.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) == 8


def test_buckets_by_week_follow_moving_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame(x, "k int, week int, v string")
    table = KeyedTable.create(rows([(k, k % 10, "a") for k in range(100)]), path, ["k"], by="week")
    before = _files(path)
    assert table.upsert(rows([(3, 7, "moved"), (200, 12, "new")])) == {3, 7, 12}
    assert before.items() <= _files(path).items()
    got = {r["k"]: (r["week"], r["v"]) for r in table.read().collect()}
    assert len(got) == 101 == table.read().count() and got[3] == (7, "moved") and got[200] == (12, "new")
    assert table.read(buckets={12}).count() == 1 and table.read(buckets={3}).count() == 9
    table.upsert(rows([(200, 1, "back"), (5, None, "lost")]))
    assert table.read(buckets={12}).count() == 0 and table.read(buckets={-1}).first()["v"] == "lost"
    table.replace(rows([(1, 1, "only")]), {1, 2})
    assert table.read(buckets={1, 2}).count() == 1 and table.read().count() == 81


@pytest.mark.parametrize("by", [None, "k % 3"])
def test_new_table_is_dealt_by_bucket_only(spark, tmp_path, monkeypatch, by):
    """Its keys are unique, so no row has to be found last of its key."""
    monkeypatch.setattr("tradewind.sources.tables.Window", None)
    rows = spark.range(40).selectExpr("if(id = 0, null, id) as k", "id as v")
    table = KeyedTable.create(rows, str(tmp_path / "t"), ["k"], 4, by)
    assert sorted(r["v"] for r in table.read().collect()) == list(range(40))


@pytest.mark.parametrize("by", [None, "k % 3"])
@pytest.mark.parametrize("most", [500_000, 0])
def test_upsert_computes_its_source_once_and_shuffles_hashes(spark, tmp_path, monkeypatch, by, most):
    """The source is written once, in its place; of the table's rows only hashes of keys are shuffled, and few replaced keys are sent to its tasks."""
    written, seen = [], spark.sparkContext.accumulator(0)
    monkeypatch.setattr("tradewind.sources.tables.REPLACED", most)
    monkeypatch.setattr("tradewind.sources.tables.stored", lambda df, name: written.append((name, df.columns)) or stored(df, name))
    count = F.udf(lambda v: seen.add(1) or v, "bigint").asNondeterministic()
    rows = lambda a, b, plus: spark.range(a, b).selectExpr("if(id = 0, null, id) AS k", f"id + {plus} AS v").withColumn("v", count("v"))
    table = KeyedTable.create(rows(0, 60, 0), str(tmp_path / "t"), ["k"], 4, by)
    assert seen.value == 60 and not written
    table.upsert(rows(0, 20, 1000).union(rows(100, 105, 0)))
    assert seen.value == 85 and [n for n, _ in written] == ["hits", "replaced"] and all("v" not in c for _, c in written)
    assert sorted(r["v"] for r in table.read().collect()) == [*range(20, 60), *range(100, 105), *range(1000, 1020)]
    twice = rows(20, 22, 0).union(rows(21, 22, 7))
    folders = table.folder.names("data")
    with pytest.raises(ValueError, match="several rows"):
        table.upsert(twice)
    assert table.folder.names("data") == folders and table.read().count() == 65


def test_keys_of_one_hash_are_told_apart(spark, tmp_path, monkeypatch):
    collide = F.xxhash64
    monkeypatch.setattr("tradewind.sources.tables.F.xxhash64", lambda *c: F.pmod(collide(*c), F.lit(3)))
    table = KeyedTable.create(spark.range(30).selectExpr("id AS k", "0 AS v"), str(tmp_path / "t"), ["k"], 2)
    table.upsert(spark.range(28, 40).selectExpr("id AS k", "1 AS v"))
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: int(k >= 28) for k in range(40)}
