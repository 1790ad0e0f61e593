"""Data-quality checks as specs: all of a table in one aggregation, and all of its unique keys in another; results as a DataFrame.

A spec is a dict with type, table, column (or columns), and severity where it differs from the type's. A new type is a
function registered under its name that turns a spec into (checked, failed) aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.scalars import key_to_timestamp
from tradewind.sources.sinks import stored

SEVERITY = {"not_null": "fail", "unique": "fail", "range": "warn", "freshness": "warn", "allowed_values": "fail", "row_count": "warn"}
RESULT = "table_name string, check_type string, column_name string, severity string, checked bigint, failed bigint, passed boolean, message string"
CHECKS: dict[str, Callable[[DataFrame, dict, Column], tuple[Column, Column]]] = {}


def check_type(name: str):
    def register(f):
        CHECKS[name] = f
        return f

    return register


def _total(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("bigint")), F.lit(0)).cast("bigint")


def _missing(df: DataFrame, c: str) -> Column:
    test = F.col(c).isNull()
    return test | F.isnan(c) if df.schema[c].dataType.simpleString() in ("double", "float") else test


@check_type("not_null")
def _not_null(df: DataFrame, spec: dict, now: Column) -> tuple[Column, Column]:
    return F.count("*"), _total(_missing(df, spec["column"]))


@check_type("range")
def _range(df: DataFrame, spec: dict, now: Column) -> tuple[Column, Column]:
    if spec.get("min") is None and spec.get("max") is None:
        raise ValueError("a range check needs a bound")
    bad = F.lit(False)
    if spec.get("min") is not None:
        bad |= F.col(spec["column"]) < F.lit(spec["min"])
    if spec.get("max") is not None:
        bad |= F.col(spec["column"]) > F.lit(spec["max"])
    return F.count("*"), _total(F.coalesce(bad, F.lit(False)))


@check_type("freshness")
def _freshness(df: DataFrame, spec: dict, now: Column) -> tuple[Column, Column]:
    """The newest time is at most so many hours old; a negative number asks for a time in the future."""
    kind = df.schema[spec["column"]].dataType.simpleString()
    newest = F.max(F.col(spec["column"]) if kind == "timestamp" else key_to_timestamp(F.col(spec["column"])))
    age = (F.unix_timestamp(now) - F.unix_timestamp(newest)) / 3600
    return F.count("*"), F.coalesce(age > spec["hours"], F.lit(True)).cast("bigint")


@check_type("allowed_values")
def _allowed(df: DataFrame, spec: dict, now: Column) -> tuple[Column, Column]:
    return F.count("*"), _total(F.coalesce(~F.col(spec["column"]).isin(spec["values"]), F.lit(False)))


@check_type("row_count")
def _row_count(df: DataFrame, spec: dict, now: Column) -> tuple[Column, Column]:
    n = F.count("*")
    return n, ((n < spec.get("min", 0)) | (n > spec.get("max", 1 << 62))).cast("bigint")


def check_unique_keys(df: DataFrame, lists: list[list[str]]) -> list[tuple[int, int]]:
    """For each list of columns the rows, and the rows in groups of equal keys: all members of a group count.

    One pass and one shuffle for all lists: a row becomes a (list, hash) for each, and these are counted. Only rows whose
    hash occurs more than once are looked at again, by their keys themselves, as two keys may have one hash.
    """
    keys = [F.struct(F.lit(k).alias("k"), F.xxhash64(*columns).alias("h")) for k, columns in enumerate(lists)]
    counts = df.select(F.explode(F.array(*keys)).alias("x")).groupBy("x.k", "x.h").agg(F.count(F.lit(1)).alias("n"))
    # hashes that occur once become one row of a list and task, so only repeated ones are written
    counts = stored(counts.groupBy("k", F.when(F.col("n") > 1, F.col("h")).alias("h")).agg(F.sum("n").alias("n")), "keys")
    rows = {r["k"]: (r["n"], r["again"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.count("h").alias("again")).collect()}
    suspect, failed = [k for k, (_, again) in rows.items() if again], {}
    if suspect:
        whole = [F.struct(F.lit(k).alias("k"), F.xxhash64(*lists[k]).alias("h"), F.array(*[F.col(c).cast("string") for c in lists[k]]).alias("key")) for k in suspect]
        again = df.select(F.explode(F.array(*whole)).alias("x")).select("x.*").join(counts.where("h is not null").select("k", "h"), ["k", "h"], "left_semi")
        n = F.col("count")
        failed = dict(again.groupBy("k", "h", "key").count().groupBy("k").agg(F.sum(F.when(n > 1, n).otherwise(0))).collect())
    return [(rows.get(k, (0, 0))[0], failed.get(k, 0)) for k in range(len(lists))]


def check_unique(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    return check_unique_keys(df, [columns])[0]


def check_fk(df: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Rows, and rows with a value that the parent lacks."""
    known = parent.select(F.col(parent_column).alias("__p")).distinct()
    lost = F.col(column).isNotNull() & F.col("__p").isNull()
    return df.join(known, F.col(column) == F.col("__p"), "left").agg(F.count("*").alias("checked"), _total(lost).alias("failed"))


def pct_unresolved(df: DataFrame, key: str, warn: float, fail: float) -> DataFrame:
    """Share of key 0 in percent, with its tier."""
    rate = 100.0 * _total(F.col(key) == 0) / F.nullif(F.count("*"), F.lit(0))
    return df.agg(F.round(rate, 4).alias("pct"), slo_tier(rate, warn, fail).alias("tier"))


def slo_tier(rate: Column, warn: float, fail: float) -> Column:
    return F.when(rate >= fail, "FAIL").when(rate >= warn, "WARN").otherwise("PASS")


def columns_of(specs: list[dict], table: str) -> list[str]:
    """The columns of a table that its specs name."""
    return list(dict.fromkeys(c for s in specs if s["table"] == table for c in s.get("columns") or [s.get("column")] if c))


def run_checks(spark: SparkSession, specs: list[dict], tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """A row for each spec. Unknown types are skipped with a warning; a check that can't run is a failed result."""
    out = []
    name = lambda s: ",".join(s.get("columns") or [s.get("column") or ""])
    result = lambda s, checked, failed, text="": (s["table"], s["type"], name(s), s.get("severity") or SEVERITY.get(s["type"], "warn"), checked, failed, failed == 0, text)
    for table in dict.fromkeys(s["table"] for s in specs):
        df, fused, aggs, unique = tables.get(table), [], [], []
        for s in (s for s in specs if s["table"] == table):
            try:
                if df is None:
                    raise ValueError(f"no table {table}")
                if s["type"] == "unique":
                    columns = s.get("columns") or [s["column"]]
                    if lost := sorted(set(columns) - set(df.columns)):
                        raise ValueError(f"no columns {lost}")
                    unique.append((s, columns))
                elif s["type"] not in CHECKS:
                    out.append((table, s["type"], name(s), "warn", 0, 0, True, "unknown type, skipped"))
                else:
                    if s.get("column") and s["column"] not in df.columns:
                        raise ValueError(f"no column {s['column']}")
                    aggs += CHECKS[s["type"]](df, s, now)
                    fused.append(s)
            except Exception as e:  # noqa: BLE001  a broken check must not hide the others
                out.append(result(s, 0, 1, str(e)[:200]))
        if unique:
            out += [result(s, *found) for (s, _), found in zip(unique, check_unique_keys(df, [c for _, c in unique]), strict=True)]
        if fused:
            row = df.agg(*[a.alias(str(k)) for k, a in enumerate(aggs)]).first()
            out += [result(s, row[2 * k], row[2 * k + 1]) for k, s in enumerate(fused)]
    return spark.createDataFrame(out, RESULT)


def gate(results: DataFrame) -> DataFrame:
    """Raises where a check of severity fail failed; returns the results."""
    bad = results.where("severity = 'fail' and not passed").select("table_name", "check_type", "column_name").collect()
    if bad:
        raise ValueError(f"data-quality gate: {[tuple(r) for r in bad]}")
    return results


def report(results: DataFrame) -> DataFrame:
    ok = F.sum(F.col("passed").cast("bigint"))
    return results.groupBy("table_name").agg(F.count("*").alias("checks"), ok.alias("passed"), F.round(100.0 * ok / F.count("*"), 2).alias("pass_rate"))


def assert_grain(df: DataFrame, keys: list[str], rows: int | None = None) -> int:
    """The number of rows, after raising where there are none, keys repeat, or the number is another than expected."""
    checked, repeated = check_unique(df, keys)
    if not checked or repeated or rows is not None and checked != rows:
        raise ValueError(f"{checked} rows, {repeated} of repeated keys {keys}, expected {rows or 'some'}")
    return checked


def assert_no_fanout(before: DataFrame, after: DataFrame) -> tuple[int, int]:
    """Both row counts, in one job; raises where a lookup join changed the number of rows."""
    n = {r[0]: r[1] for r in before.select(F.lit("before").alias("at")).unionAll(after.select(F.lit("after").alias("at"))).groupBy("at").count().collect()}
    if n.get("before", 0) != n.get("after", 0):
        raise ValueError(f"{n.get('before', 0)} rows became {n.get('after', 0)}")
    return n.get("before", 0), n.get("after", 0)


def iso_boundary_checks(calendar: DataFrame) -> DataFrame:
    """Days whose ISO year differs from their calendar year, with both."""
    return calendar.where("iso_year <> cal_year").select("date_key", "iso_year", "iso_week", "cal_year")
