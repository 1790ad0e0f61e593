"""Operators on hand-written rows: readers, sinks, history, checks, reconciliation, metrics, lineage."""

import datetime as dt
import json
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradewind.fixtures import Views
from tradewind.functions import scalars as S
from tradewind.operators import aggregates as A
from tradewind.operators import analytics as V
from tradewind.operators import filters as P
from tradewind.operators import joins as J
from tradewind.operators import lineage as LG
from tradewind.operators import quality as Q
from tradewind.operators import reconcile as C
from tradewind.operators import scd as D
from tradewind.operators import windows as W
from tradewind.plans import metrics as M
from tradewind.plans import pipelines as L
from tradewind.plans import queries, queries_io  # noqa: F401
from tradewind.plans.registry import QUERIES
from tradewind.sources import readers as R
from tradewind.sources import sinks as K
from tradewind.sources import tables as T

SF = "/root/testdata/sf0.001"
ts = lambda x: F.lit(x).cast("timestamp")
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_csv_folder_and_schema_versions(spark, tmp_path):
    raw = spark.createDataFrame([("s1", "v1", 'a "quoted"\nname', "x", "g", "f", "c", "m", "1.50", "oops")], ", ".join(f"`{h}` string" for h in R.HEADERS["current"]))
    K.export_csv(raw, str(tmp_path / "csv"), {c: c for c in raw.columns})
    back = R.read_csv_folder(spark, str(tmp_path / "csv"))
    df = R.normalize_columns(back, R.detect_schema(back.columns))
    assert df.columns == R.CANONICAL and df.first()["item_description"] == 'a "quoted"\nname'
    assert P.bad_numeric_to_null(df.withColumn("retail", F.col("retail").cast("string")), ["retail"], "decimal(10,2)").first()["retail"] is None
    assert R.detect_schema(R.HEADERS["legacy"])["Vend_ID"] == "vend_id"
    with pytest.raises(ValueError, match="lacks"):
        R.detect_schema(["SKU", "Style#"])
    with pytest.raises(ValueError, match="no known"):
        R.detect_schema(["a"])


def test_optional_tables_and_required_columns(spark, tmp_path):
    assert R.table_or_default(spark, str(tmp_path / "none")) is None
    assert R.table_or_default(spark, "no_such_table") is None
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        R.require_columns(df, ["c", "a", "b"])
    assert R.require_columns(df, ["a"]) is df


def test_ranking_runs_over_pages(spark):
    page = lambda ids, **more: json.dumps({"results": [{"id": i, "uid": f"u{i}"} for i in ids], **more})
    rows = [("c", 1, page("ab", elevated=["b"], total=3, per_page=2, sorting=[{"label": "x"}, {"label": "y", "default": True}], campaigns=["k"])), ("c", 2, page("d", removed=["ud", "d"]))]
    df = spark.createDataFrame(rows, "collection string, page int, json string")
    got = [(r["product_id"], r["position"], r["is_pinned"], r["is_removed"]) for r in R.explode_ranking(df).orderBy("position").collect()]
    assert got == [("a", 1, False, False), ("b", 2, True, False), ("d", 3, False, True)]
    assert tuple(R.ranking_meta(df).first()) == ("c", 3, 2, "y", '["k"]')


def test_pruned_reads_reach_the_scan(spark, tmp_path):
    days = R.generate_calendar(spark, "2024-12-28", "2025-01-03").select(F.col("date_actual").alias("event_date"), "date_key")
    K.overwrite_partitioned(days, str(tmp_path / "t"), ["event_date"])
    table = spark.read.parquet(str(tmp_path / "t"))
    assert R.read_partition_pruned(table, "event_date", "2025-01-03", "2025-01-03").count() == 3
    assert R.read_partition_pruned(table, "event_date", None, "2025-01-03").count() == 7
    plan = R.read_partition_pruned(table, "event_date", "2025-01-03", "2025-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_calendar_boundaries(spark):
    rows = {r["date_key"]: r for r in R.generate_calendar(spark, "2023-01-01", "2030-12-31").collect()}
    assert len(rows) == 2922
    assert (rows[20241230]["iso_year"], rows[20241230]["iso_week"]) == (2025, 1)
    assert (rows[20230101]["iso_year"], rows[20230101]["iso_week"], rows[20230101]["is_weekend"]) == (2022, 52, True)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.business_date_key(ts("2026-01-01 03:00:00"))) == 20251231
    assert one(S.business_date_key(ts("2025-07-01 04:30:00"))) == 20250701
    assert one(S.legacy_business_date(ts("2025-07-01 04:30:00"))) == dt.date(2025, 6, 30)
    assert [one(S.normalize_source(F.lit(x))) for x in ("google%20ads", "google-ads", " EMARSYS ", "x")] == ["google-ads", "google-ads", "Emarsys", "x"]
    assert one(S.created_date(F.lit("FBA STA (05/12/2026 17:52)-PBI3"))) == dt.date(2026, 5, 12)
    assert one(S.short_name(F.lit("cat.mart.t"))) == "mart.t" and one(S.week_ending(F.lit("2025-01-01").cast("date"))) == dt.date(2025, 1, 5)
    assert one(S.safe_ratio(F.lit(1.0), F.lit(0.0))) is None


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    K.overwrite_table(spark.range(3), path)
    K.append_raw(spark.range(2).withColumn("extra", F.lit("x")), path)
    assert K.read_merged(spark, path).where("extra is null").count() == 3
    snap = lambda day, n: spark.range(n).withColumn("snapshot_date", F.lit(day))
    K.replace_where(snap("d1", 2), f"{path}2", "snapshot_date")
    K.replace_where(snap("d2", 3), f"{path}2", "snapshot_date")
    K.replace_where(snap("d1", 5), f"{path}2", "snapshot_date")
    assert {r[0]: r[1] for r in spark.read.parquet(f"{path}2").groupBy("snapshot_date").count().collect()} == {"d1": 5, "d2": 3}
    assert K.ctas(spark, "made", "select 1 as a").first()[0] == 1
    K.create_view(spark.range(4), "seen")
    assert spark.sql("select count(*) from seen").first()[0] == 4


def test_upsert_needs_unique_keys_and_is_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    once = K.upsert(t, s, ["k"], null_safe=True)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "N")], key=repr)
    assert sorted(map(tuple, K.upsert(once, s, ["k"], null_safe=True).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)
    assert K.upsert(t, s, ["k"]).where("k is null").count() == 2
    with pytest.raises(ValueError, match="several rows"):
        K.upsert(t, s.union(s), ["k"])


def test_surrogate_keys_agree_beyond_one_task(spark):
    df = spark.range(120_000).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("sku"))
    row = W.surrogate_key(df, "sku", "key", 5).agg(F.min("key"), F.max("key"), F.countDistinct("key"), F.sum((F.col("key") == F.col("sku").cast("int") + 6).cast("int"))).first()
    assert tuple(row) == (6, 120_005, 120_000, 120_000)


def _snap(spark, rows):
    return spark.createDataFrame(rows, "sku string, season string")


def test_history_demo(spark):
    h = D.seed_history(_snap(spark, [("a", "FW25"), ("b", None)]), "sku", ["season"], ts("2026-01-01"))
    h2 = D.merge(h, _snap(spark, [("a", "Core"), ("c", "")]), "sku", ["season"], ts("2026-09-01"))
    assert J.as_of_point(h2, "sku", "a", ts("2026-07-01")).first()["season"] == "FW25"
    assert J.as_of_point(h2, "sku", "a", ts("2026-09-01")).first()["season"] == "Core"
    assert J.as_of_point(h2, "sku", "b", ts("2027-01-01")).count() == 1
    assert tuple(D.integrity(h2, "sku").first())[1:4] == (0, 0, 0)
    assert D.merge(h2, _snap(spark, [("a", "Core"), ("c", "")]), "sku", ["season"], ts("2027-01-01")).exceptAll(h2).count() == 0
    assert D.merge(h2, _snap(spark, [("c", None)]), "sku", ["season"], ts("2027-01-01")).where("sku = 'c'").count() == 2
    assert D.seed_unknown(D.seed_unknown(h2, "sku"), "sku").where("product_key = 0").count() == 1


@few
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", None])), unique_by=lambda r: r[0], max_size=4), min_size=1, max_size=3))
def test_histories_never_overlap(spark, snapshots):
    h = D.seed_history(_snap(spark, snapshots[0]), "sku", ["season"], ts("2020-01-01"))
    for n, rows in enumerate(snapshots[1:], 1):
        h = D.merge(h, _snap(spark, rows), "sku", ["season"], ts(f"202{n}-01-01"))
    rows = sorted((r["sku"], r["effective_from"], r["effective_to"]) for r in h.collect())
    assert all(a[0] != b[0] or a[2] == b[1] for a, b in zip(rows, rows[1:], strict=False))
    assert tuple(D.integrity(h, "sku").first())[1:4] in ((0, 0, 0), (None, None, 0))


def test_checks(spark):
    df = spark.createDataFrame([(1, 1, -5.0), (2, 2, 20.0), (2, 3, float("nan")), (3, None, 50.0), (3, None, None)], "id int, n int, price double")
    stamped = df.withColumn("at", ts("2026-01-01 00:00:00"))
    assert Q.check_unique(df, ["id"]) == (5, 4) and Q.check_unique(df.limit(0), ["id"]) == (0, 0)
    specs = [{"type": "not_null", "table": "t", "column": "n"}, {"type": "not_null", "table": "t", "column": "price"}, {"type": "range", "table": "t", "column": "price", "min": 0, "max": 30}, {"type": "range", "table": "t", "column": "price"}, {"type": "freshness", "table": "t", "column": "at", "hours": 24}, {"type": "freshness", "table": "t", "column": "at", "hours": -24}, {"type": "strange", "table": "t"}, {"type": "unique", "table": "t", "column": "zz"}, {"type": "not_null", "table": "gone", "column": "a"}]
    specs = specs[:3] + specs[4:]
    got = {(r["table_name"], r["check_type"], r["column_name"]): (r["failed"], r["passed"], r["severity"]) for r in Q.run_checks(spark, specs, {"t": stamped}, ts("2026-01-01 12:00:00")).collect()}
    assert got["t", "not_null", "n"] == (2, False, "fail") and got["t", "not_null", "price"] == (2, False, "fail")
    assert got["t", "strange", ""][1:] == (True, "warn") and got["t", "unique", "zz"][1:] == (False, "fail") and got["gone", "not_null", "a"][1] is False
    assert got["t", "freshness", "at"][0] == 1
    two = Q.run_checks(spark, [{"type": "range", "table": "t", "column": "price"}], {"t": df}, ts("2026-01-01")).first()
    assert not two["passed"] and "bound" in two["message"]
    with pytest.raises(ValueError, match="gate"):
        Q.gate(Q.run_checks(spark, specs[:1], {"t": df}, ts("2026-01-01")))
    assert Q.gate(Q.run_checks(spark, [specs[2]], {"t": df}, ts("2026-01-01"))).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        Q.assert_grain(df, ["id"])
    with pytest.raises(ValueError, match="became"):
        Q.assert_no_fanout(df, df.union(df))


def test_reconcile_categories_are_symmetric(spark):
    a = spark.createDataFrame([("p", 100), ("w", 103), ("f", 120), ("only", 11), ("little", 5)], "k string, qty int")
    b = spark.createDataFrame([("p", 101), ("w", 100), ("f", 100), ("there", 12)], "k string, qty int")
    of = lambda x, y: {r["k"]: r["status"] for r in C.reconcile(x, y, ["k"]).collect()}
    assert of(a, b) == {"p": "PASS", "w": "WARN", "f": "FAIL", "only": "MISSING_OLD", "there": "MISSING_NEW", "little": "FAIL"}
    turn = {"MISSING_OLD": "MISSING_NEW", "MISSING_NEW": "MISSING_OLD"}
    assert {k: turn.get(v, v) for k, v in of(b, a).items()} == of(a, b)


def test_metrics_bind_values(spark):
    s = L.Star(spark, SF)
    s.register()
    with pytest.raises(KeyError):
        M.query_metric(spark, "nope", 1, 2)
    with pytest.raises(ValueError, match="before"):
        M.query_metric(spark, "revenue_by_day", 20000101, 19990101)
    with pytest.raises(ValueError, match="unknown filters"):
        M.query_metric(spark, "revenue_by_day", 1, 2, channels=["x"])
    one = lambda **f: M.query_metric(spark, "quantity_by_style_channel_week", 19980101, 19980331, **f).count()
    assert one(channels=["x') OR 1=1 --"]) == 0
    assert one(channels=[]) == one(channels=None) == one() > one(channels=["bing"]) > 0
    assert M.FILTERS["statuses"] == ["amazon_fba_receiving_by_sku"]


def test_flagship_plan_is_pruned(spark):
    plan = L.Star(spark, SF).metric._jdf.queryExecution().toString()
    assert "l_tax" not in plan.split("== Optimized Logical Plan ==")[1].split("ReadSchema", 1)[-1] and "CartesianProduct" not in plan


def test_full_build_equals_incremental_replay(spark, tmp_path):
    s = L.Star(spark, SF)
    full = s.fact
    table = T.KeyedTable.create(full.where("order_updated_at < timestamp '1999-01-01'"), str(tmp_path / "fact"), ["shopify_line_id"], 20)
    for since in ("1999-01-01", "2000-06-01"):
        table.upsert(L.build_fact(s.v, s.dates, s.products, s.channels, since, s.v.metafield))
    done = table.read().select(*full.columns)
    assert done.exceptAll(full).count() == 0 and full.exceptAll(done).count() == 0


def test_watermarks(spark, tmp_path):
    path = str(tmp_path / "marks")
    assert L.watermark_read(spark, path, "fact") is None
    orders = Views(spark, SF).order
    L.watermark_advance(spark, path, "fact", orders.limit(0), "updated_at")
    assert L.watermark_read(spark, path, "fact") is None
    L.watermark_advance(spark, path, "fact", orders, "updated_at")
    top = L.watermark_read(spark, path, "fact")
    L.watermark_advance(spark, path, "other", orders.where("id < 10"), "updated_at")
    L.watermark_advance(spark, path, "fact", orders.limit(0), "updated_at")
    assert L.watermark_read(spark, path, "fact") == top == orders.agg(F.max("updated_at")).first()[0].strftime("%Y-%m-%d %H:%M:%S")


def test_daily_run(spark, tmp_path):
    specs = [{"type": "unique", "table": "fact_orders_line", "column": "shopify_line_id"}, {"type": "range", "table": "fact_orders_line", "column": "quantity", "min": 1, "max": 3}]
    out = str(tmp_path / "run")
    digest = L.daily_run(spark, SF, out, specs).collect()
    assert [(r["delta"], r["dq_summary"]) for r in digest] == [(0, "1/2")]
    fact = T.KeyedTable(spark, f"{out}/fact_orders_line").read()
    again = L.success_digest(spark, out, fact, Q.run_checks(spark, specs, {"fact_orders_line": fact}, ts("2001-01-01")))
    assert again.count() == 1
    assert T.KeyedTable(spark, f"{out}/quantity_by_style_channel_week").read().count() == L.Star(spark, SF).metric.count()
    with pytest.raises(ValueError, match="gate"):
        L.daily_run(spark, SF, str(tmp_path / "bad"), [{"type": "range", "table": "fact_orders_line", "column": "quantity", "max": 1, "severity": "fail"}])
    assert T.KeyedTable(spark, f"{tmp_path}/bad/fact_orders_line").read().count() > 0 and R.table_or_default(spark, f"{tmp_path}/bad/page_view") is None


def test_second_run_rewrites_touched_weeks_only(spark, tmp_path):
    out, specs = str(tmp_path / "run"), [{"type": "unique", "table": "fact_orders_line", "column": "shopify_line_id"}]
    L.daily_run(spark, SF, out, specs, "1999-12-31", "2000-01-01")
    tables = {n: T.KeyedTable(spark, f"{out}/{n}") for n in ("fact_orders_line", "quantity_by_style_channel_week")}
    before = {n: t.manifest() for n, t in tables.items()}
    digest = L.daily_run(spark, SF, out, specs).orderBy("run_date").collect()
    full = L.Star(spark, SF)
    assert [r["run_date"] for r in digest] == ["1999-12-31", L.END] and digest[1]["fact_row_count"] == full.fact.count() == digest[0]["fact_row_count"] + digest[1]["delta"]
    for n, want in (("fact_orders_line", full.fact), ("quantity_by_style_channel_week", full.metric)):
        want = want.drop("_ingested_at")
        got = tables[n].read().select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    changed = full.fact.where("order_updated_at >= timestamp '1999-12-29'").selectExpr(L.WEEK).distinct().collect()
    (new,) = set(tables["fact_orders_line"].manifest()["folders"]) - set(before["fact_orders_line"]["folders"])
    assert set(tables["fact_orders_line"].manifest()["folders"][new]) == {r[0] for r in changed}
    for n, state in before.items():
        left = {b for f, own in tables[n].manifest()["folders"].items() if f in state["folders"] for b in own}
        assert left == tables[n].buckets(state) - {r[0] for r in changed} and left


def test_failed_run_is_made_up(spark, tmp_path):
    out, bad = str(tmp_path / "run"), [{"type": "range", "table": "fact_orders_line", "column": "quantity", "max": 1, "severity": "fail"}]
    L.daily_run(spark, SF, out, [], "1999-12-31", "2000-01-01")
    with pytest.raises(ValueError, match="gate"):
        L.daily_run(spark, SF, out, bad)
    L.daily_run(spark, SF, out, [])
    got, want = T.KeyedTable(spark, f"{out}/quantity_by_style_channel_week").read(), L.Star(spark, SF).metric
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_product_keys_stay(spark, tmp_path):
    raw = Views(spark, SF).product(1)
    path = str(tmp_path / "dim")
    first = {r["sku"]: r["product_key"] for r in L.refresh_dim_product(raw.where("sku > '3'"), path).collect()}
    second = {r["sku"]: r["product_key"] for r in L.refresh_dim_product(raw, path).collect()}
    assert first.items() < second.items() and len(set(second.values())) == len(second) and second.keys() == {r["sku"] for r in L.build_dim_product(raw).collect()}


def test_unique_keys_in_one_pass(spark, monkeypatch):
    rows = [(k % 50, k % 7, None if k % 3 else "x", k) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int")
    lists = [["a"], ["a", "b"], ["c"], ["d"], ["c", "d"]]
    plain = lambda k: sum(n for n in Counter(tuple(r["abcd".index(c)] for c in k) for r in rows).values() if n > 1)
    assert Q.check_unique_keys(df, lists) == [(300, plain(k)) for k in lists]
    collide = F.xxhash64
    monkeypatch.setattr(Q.F, "xxhash64", lambda *c: F.pmod(collide(*c), F.lit(5)))
    assert Q.check_unique_keys(df, lists) == [(300, plain(k)) for k in lists]


def test_long_chains_and_cycles(spark):
    n = 10_000
    chain = spark.range(n).select(F.format_string("n%05d", "id").alias("source"), F.format_string("n%05d", F.col("id") + 1).alias("target"))
    ring = spark.range(50).select(F.format_string("r%d", "id").alias("source"), F.format_string("r%d", (F.col("id") + 1) % 50).alias("target"))
    edges = chain.union(ring).union(spark.createDataFrame([("n00000", "n00000")], "source string, target string")).coalesce(2)
    assert LG._closure(edges, "n00000", "source", "target").count() == n + 1
    assert LG.connected(edges, "r7").count() == 50 and LG.connected(edges, "alone").count() == 1


def test_report_and_presets(spark, tmp_path):
    path = K.write_json_report(spark.createDataFrame([("a", 1)], "x string, n int"), str(tmp_path / "r"), "7")
    assert path.endswith("r-7") and spark.read.json(path).count() == 1
    assert V.date_preset("7d", dt.date(2026, 1, 7))[0] == dt.date(2026, 1, 1)
    assert V.date_preset("month", dt.date(2026, 1, 7))[0] == dt.date(2026, 1, 1)


def test_order_marks_equal_two_joins(spark):
    v = Views(spark, SF)
    lines = v.line.select("id", "order_id", "sku", "quantity")
    marked = J.with_order_marks(lines, v.refund)
    kept = marked.where("not is_refunded").select("id", "order_quantity")
    want = J.exclude_matched(lines.join(A.order_total_qty(lines), "order_id"), A.refunded_keys(lines, v.refund)).select("id", "order_quantity")
    assert kept.exceptAll(want).count() == 0 and want.exceptAll(kept).count() == 0 and marked.count() == lines.count() > kept.count()
    rows = spark.createDataFrame([("a", 1, None, 2), ("b", 1, None, 3), ("c", 2, "s", 1)], "id string, order_id int, sku string, quantity int")
    back = spark.createDataFrame([("a",), ("a",), ("c",)], "order_line_id string")
    assert sorted(map(tuple, J.with_order_marks(rows, back).select("id", "order_quantity", "is_refunded").collect())) == [("a", 5, False), ("b", 5, False), ("c", 1, True)]


def test_metrics_build_what_they_read_only(spark, monkeypatch):
    assert {m: M.views_of(m) for m in ("revenue_by_day", "channel_health", "page_view_by_product")} == {"revenue_by_day": ["sales_day"], "channel_health": ["channel_gold"], "page_view_by_product": ["page_view"]}
    assert M.views_of("units_dollars_by_sku_channel_week") == ["fact", "dim_date", "dim_product", "dim_channel"] and set(M.VIEWS) == set(L.Star.VIEWS)

    def never(*args, **kwargs):
        raise AssertionError("the fact is built")

    monkeypatch.setattr(L, "_WRITTEN", {})
    monkeypatch.setattr(L, "build_fact", never)
    for name in ("m1_revenue_by_day", "m1_cohort_retention_matrix", "m2_channel_health", "u1_unknown_member", "q13_no_fanout"):
        assert QUERIES[name](spark, SF).count() > 0


def test_full_build_joins_by_line_and_sku_before_orders(spark):
    """The last join of a full build is that with the orders, so that no shuffle by line or sku carries the order's columns."""
    plan = L.Star(spark, SF).new_fact(L.Star(spark, SF).products)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "order_id" in top, top


def test_basket_counts_distinct_values_without_copies_of_lines(spark):
    rows = [("d", 1, 2, "a", "x", 10), ("d", 1, 1, "a", "y", 10), ("d", 1, 1, None, None, 10), ("d", 2, 1, None, "x", 5), ("e", 3, 1, "b", None, 7), ("e", 3, 1, "c", None, 7)]
    out = A.daily_basket_metrics(spark.createDataFrame(rows, "day string, order_id int, quantity int, sku string, style string, net_line_cents bigint"))
    assert sorted(map(tuple, out.collect())) == [("d", 2, 2.5, 0.5, 1.5, 0.175), ("e", 1, 2.0, 2.0, 0.0, 0.14)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reconciled_sides_are_summed_once_by_style(spark):
    s = L.Star(spark, SF)
    sides = queries._sides(s)
    assert all("item_description" not in x._jdf.queryExecution().toString() and "channel" not in x._jdf.queryExecution().toString() for x in sides)
    assert sides[0].count() > 0


def test_page_view_shuffles_lines_by_order_only(spark):
    """Refunds that name their order and sku mark its lines as those looked up by line do; the page view shuffles no line's id."""
    v = Views(spark, SF)
    lines = v.line.select("id", "order_id", "sku", "quantity")
    by_order, by_line = (J.with_order_marks(lines, r).select("id", "order_quantity", "is_refunded") for r in (v.refund, v.refund.select("order_line_id")))
    assert by_order.exceptAll(by_line).count() == 0 and by_line.exceptAll(by_order).count() == 0 and by_order.count() == lines.count()
    rows = spark.createDataFrame([("a", 1, None, 2), ("b", 1, "s", 3), ("c", 1, "s", 1), ("d", 2, "s", 4), ("e", None, "s", 5)], "id string, order_id int, sku string, quantity int")
    back = spark.createDataFrame([("b", 1, "s", 9), ("b", 1, "s", 9), ("a", 1, None, 9), ("e", None, "s", 9), ("z", 3, "s", 9)], "order_line_id string, order_id int, sku string, units int")
    marked = J.with_order_marks(rows, back)
    assert marked.columns == ["id", "order_id", "sku", "quantity", "order_quantity", "is_refunded"]
    assert sorted(map(tuple, marked.select("id", "order_quantity", "is_refunded").collect())) == [("a", 6, False), ("b", 6, True), ("c", 6, True), ("d", 4, False), ("e", 5, False)]
    plan = L.Star(spark, SF).page_view._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" not in plan and "l_shipdate" not in plan, plan


def test_page_views_read_no_line_id(spark):
    for name in ("a3_page_view_by_product", "m1_page_view"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "l_linenumber" not in plan and "Window" in plan, name


def test_page_view_deals_texts_by_sku_only(spark):
    """Orders are counted by marked lines before the products are looked up, so no description is dealt by order, and no dimension is written for it."""
    rows = [("d", "p", 1, "a", 2, 10), ("d", "p", 1, "b", 1, 5), ("d", "p", 2, None, 1, 7), ("d", "q", 1, "z", 4, 1), ("e", "p", 1, "a", 1, 3), ("d", "r", None, "a", 1, 1)]
    sales = spark.createDataFrame(rows, "date string, page string, order_id int, sku string, quantity int, net_line_cents bigint")
    marked = A.first_of_order(sales)
    assert marked.drop("is_first").exceptAll(sales).count() == 0 and marked.count() == len(rows)
    raw = spark.createDataFrame([(2, " a ", "old", " g1 "), (3, "a", "new", "g2"), (1, "b", None, "g9"), (4, " ", "no key", "g0"), (5, None, "no key", "g0")], "key int, sku string, item_description string, group_name string")
    clean = L.clean_products(raw.withColumns({c: F.lit("x") for c in L.TEXTS if c not in raw.columns}))
    assert sorted(map(tuple, clean.select("sku", "key", "item_description", "group_name").collect())) == [("a", 3, "new", "g2"), ("b", 1, "UNKNOWN", "g9")]
    out = A.shopify_page_agg(marked.join(clean, "sku", "left")).select("date", "page", "unique_orders", "unique_sold", "net_cents", "category", "descr")
    assert sorted(map(tuple, out.collect())) == [("d", "p", 2, 4, 22, "g9", "new"), ("d", "q", 1, 4, 1, None, None), ("d", "r", 0, 1, 1, "g2", "new"), ("e", "p", 1, 1, 3, "g2", "new")]
    plan = QUERIES["a3_page_view_by_product"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "dim_product" not in plan and "distinct" not in plan, plan


def test_refunds_are_netted_where_lines_are_dealt_by_order(spark):
    """Refunds that name their order are counted as those looked up by line are, and neither lines nor refunds are shuffled by line."""
    v = Views(spark, SF)
    lines = v.line.select("id", F.col("order_id").cast("string").alias("order_id"), "sku", "quantity")
    by_order, by_line = (J.net_refunds(lines, r) for r in (v.refund, v.refund.drop("order_id")))
    assert by_order.columns == by_line.columns and by_order.schema["refunded_quantity"].dataType == by_line.schema["refunded_quantity"].dataType
    assert by_order.exceptAll(by_line).count() == 0 and by_line.exceptAll(by_order).count() == 0 and by_order.where("refunded_quantity > 0").count() > 0
    rows = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 2, None), ("d", None, 4), (None, 1, 5)], "id string, order_id int, quantity int")
    back = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", 1, None), ("d", None, 2), ("z", 9, 7), (None, 1, 3)], "order_line_id string, order_id bigint, quantity int")
    for refunds in (back, back.drop("order_id")):
        assert sorted(map(tuple, J.net_refunds(rows, refunds).collect()), key=repr) == sorted([("a", 1, 2, 2), ("b", 1, 3, 0), ("c", 2, None, 0), ("d", None, 4, 2), (None, 1, 5, 0)], key=repr)
    s = L.Star(spark, SF)
    plan = s.new_fact(s.products)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "hashpartitioning(order_line_id#" not in plan, plan


def test_fact_of_a_few_columns(spark):
    """Any columns of the fact are those of the whole, and what only others come from is not in the plan."""
    s = L.Star(spark, SF)
    assert s.new_fact(s.products).columns == list(L.FACT) == s.fact.columns
    for columns in (["shopify_line_id", "product_key"], ["product_key", "is_exc_order"], ["channel_key", "iso_week", "quantity", "refunded_quantity"], ["shopify_line_id", "sku_raw", "order_updated_at", "ad_id"]):
        got, want = s.fact_of(*columns), s.fact
        want = want.select(*got.columns)
        assert set(got.columns) == set(columns) and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = s.fact_of("quantity", "date_key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan, plan


@pytest.mark.parametrize("name", ["a30_order_vs_line_grain", "r5_itemize_residual", "a15_channel_group_rollup", "a21_reconciliation_side", "v1_kpi_totals", "q5_run_checks", "snk2_overwrite_partitioned", "g11_fact_of_two_batches", "m3_metric_refresh"])
def test_query_takes_its_columns_without_writing_the_fact(spark, monkeypatch, name):
    def never(self, name, *args):
        if name == "fact":
            raise AssertionError("the fact is written")
        return stored(self, name, *args)

    stored = L.Star._stored
    monkeypatch.setattr(L.Star, "_stored", never)
    assert QUERIES[name](spark, SF).count() > 0


def test_repeated_hashes_only_are_written(spark, monkeypatch):
    """Of the hashes of unique keys, those that occur once are one row of a task."""
    written = []
    monkeypatch.setattr(Q, "stored", lambda df, name: written.append(K.stored(df, name)) or written[-1])
    df = spark.range(1000).selectExpr("id", "id % 990 AS other", "if(id > 0, id, null) AS with_null")
    assert Q.check_unique_keys(df, [["id"], ["other"], ["with_null"]]) == [(1000, 0), (1000, 20), (1000, 0)]
    assert written[0].where("h is not null").count() == 10 and written[0].where("h is null").count() <= 3 * 8
    assert Q.check_unique_keys(df.limit(0), [["id"]]) == [(0, 0)]
    assert Q.columns_of(queries.SPECS, "fact") == ["shopify_line_id", "sku_raw", "shopify_order_id", "quantity", "pre_tax_price", "date_key", "financial_status"]


def test_one_week_is_built_from_its_orders(spark):
    plan = queries._week(L.Star(spark, SF), 1998, 28)._jdf.queryExecution().optimizedPlan().toString()
    assert "1998-07-06" in plan and "channel" not in plan, plan


def test_batch_meets_its_orders_columns_last(spark):
    """Of a batch, lines are looked up by sku while they are narrow, and nothing is shuffled by line."""
    s = L.Star(spark, SF)
    execution = L.build_fact(s.v, s.dates, s.products, s.channels, "2000-01-01", s.v.metafield)._jdf.queryExecution()
    top = next(line for line in execution.optimizedPlan().toString().splitlines() if "Join" in line)
    assert "order_id" in top and "hashpartitioning(id#" not in execution.executedPlan().toString(), top


def test_daily_run_writes_its_batch_once(spark, tmp_path, monkeypatch):
    """The batch goes into the fact only, and the watermark is its newest change all the same."""
    out, names, stored = str(tmp_path / "run"), [], K.stored
    monkeypatch.setattr(L.K, "stored", lambda df, name: names.append(name) or stored(df, name))
    L.daily_run(spark, SF, out, [], "1999-12-31", "2000-01-01")
    newest = L.Star(spark, SF).fact.where("order_updated_at < timestamp '2000-01-01'").agg(F.date_format(F.max("order_updated_at"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert "batch" not in names and L.watermark_read(spark, f"{out}/watermarks", "fact_orders_line") == newest
