"""Registered queries that write, stream or keep state first, and return what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions import scalars as S
from tradewind.operators import aggregates as A
from tradewind.operators import quality as Q
from tradewind.operators import reconcile as C
from tradewind.operators import windows as W
from tradewind.plans import metrics as M
from tradewind.plans import pipelines as L
from tradewind.plans.pipelines import Star
from tradewind.plans.queries import FLAGS, GRAIN, HISTORY, NOW, WINDOWS, _ranking, _sides, ts
from tradewind.plans.registry import query
from tradewind.sources import readers as R
from tradewind.sources import sinks as K
from tradewind.sources.tables import Folder, LoggedTable
from tradewind.streaming import streams as ST

ORDER = "id:i financial_status total_cents:i"
ORDER_SQL = "SELECT id, financial_status, total_cents FROM f_order"
_order = lambda s: s.v.order.select("id", "financial_status", "total_cents")


def _written(s: Star, write, read=None):
    path = K.scratch(s.spark, "table")
    write(path)
    return (read or s.spark.read.parquet)(path)


def _csv(s: Star):
    raw = s.v.product(1).select(F.col("sku").alias("SKU"), F.col("vend_id").alias("Style#"), F.concat(F.lit('say "'), F.coalesce("item_description", F.lit("none")), F.lit('",\nnow')).alias("Item Description"), F.col("season").alias("Season"))
    back = _written(s, lambda p: K.export_csv(raw, p, {c: c for c in raw.columns}), lambda p: R.read_csv_folder(s.spark, p))
    return back.select(F.col("SKU").cast("string").alias("sku"), F.col("`Style#`").alias("vend_id"), F.col("`Item Description`").alias("item_description"), F.col("Season").alias("season"))


query("src2_csv_folder", _csv, "sku vend_id item_description season", "SELECT sku, vend_id, 'say \"' || coalesce(item_description, 'none') || '\",' || chr(10) || 'now' AS item_description, season FROM f_product_1")
query("snk15_export_csv", _csv, "sku vend_id item_description season", "SELECT sku, vend_id, 'say \"' || coalesce(item_description, 'none') || '\",' || chr(10) || 'now' AS item_description, season FROM f_product_1")
query("src4_optional_table_missing", lambda s: A.breakdown(L.build_fact(s.v, s.dates, s.products, s.channels, metafield=R.table_or_default(s.spark, f"{s.v.sf_dir}/order_metafield.parquet")), FLAGS), " ".join(FLAGS) + " rows:i", "SELECT is_exc_order, false AS is_replacement_order, NOT is_exc_order AS is_sales_attributable, count(*) AS rows FROM fact GROUP BY 1, 3")
query("src5_require_columns", lambda s: R.require_columns(s.fact, ["shopify_line_id", "channel_source_norm"]).agg(F.count("*").alias("rows")), "rows:i", "SELECT count(*) AS rows FROM fact")


def _stream(s: Star):
    """Ads as JSON files, some twice, through the deduplicating stream into a table."""
    src, out, mark = (K.scratch(s.spark, x) for x in ("json", "silver", "mark"))
    ads = s.v.ads_stream
    ads.write.json(src)
    ads.where("spend_cents % 5 = 0").write.mode("append").json(src)
    ST.stream_to_table(ST.dedup_stream(R.stream_json(s.spark, src, ads.schema), "ad_event_id", "1 day"), out, mark).awaitTermination()
    return s.spark.read.schema(ads.schema).parquet(out)


ADS = "ad_event_id order_id channel spend_cents:i event_time:t"
query("src6_stream_json", _stream, ADS, "SELECT * FROM f_ads_stream")
query("snk13_stream_to_table", lambda s: A.ad_channel_summary(_stream(s)), "channel ads:i spend:f attributed:i", "SELECT channel, count(*) AS ads, round(CAST(sum(spend_cents) AS DOUBLE) / 100, 2) AS spend, count(order_id) AS attributed FROM f_ads_stream GROUP BY 1")


def _middle(df, column: str) -> str:
    """The full hour at the middle of a time column."""
    return df.agg(F.expr(f"date_format(date_trunc('HOUR', min({column}) + (max({column}) - min({column})) / 2), 'yyyy-MM-dd HH:mm:ss')")).first()[0]


def _stream_windows(s: Star):
    """The attributed table as a stream, windowed, upserted into gold; the table is compacted between two runs."""
    src, gold, mark = (K.scratch(s.spark, x) for x in ("attributed", "gold", "mark"))
    rows = K.stored(s.attributed, "attributed")
    middle = ts(_middle(rows, "event_time"))
    table = LoggedTable.create(s.spark, src, rows.schema)
    for part in (F.col("event_time") < middle, F.col("event_time") >= middle):
        table.append(rows.where(part))
        ST.stream_to_gold(ST.windowed_roas(R.stream_table(s.spark, src)), gold, mark, ts("2030-01-01 00:00:00")).awaitTermination()
        table.compact()
    return s.spark.read.parquet(gold)


query("src7_stream_table", _stream_windows, WINDOWS, "SELECT * FROM windows")


def _anomalies(s: Star):
    """The windows of the ad stream in two batches, the second held against the last hour of the first, and replayed."""
    path, windows = K.scratch(s.spark, "gold"), K.stored(s.windows, "windows")
    middle = _middle(windows, "window_start")
    write = ST.gold_upserter(path, ts(middle))
    for n, part in enumerate((F.col("window_start") < ts(middle), F.col("window_start") >= ts(middle))):
        for _ in range(n + 1):
            write(windows.where(part), n)
    return s.spark.read.parquet(path)


MIDDLE = "WITH mid AS (SELECT date_trunc('hour', min(window_start) + (max(window_start) - min(window_start)) / 2) AS t FROM windows), base AS (SELECT channel, avg(roas) AS b, count(*) AS n FROM windows, mid WHERE window_start < t AND window_start >= t - INTERVAL 60 MINUTE GROUP BY 1)"
FLAGGED = f"{MIDDLE} SELECT w.*, w.window_start >= t AND coalesce(w.spend_cents >= 2000 AND n >= 3 AND w.roas < b * 0.5, false) AS is_anomaly, t AS last_updated FROM windows w CROSS JOIN mid LEFT JOIN base USING (channel)"
query("snk14_foreach_batch_upsert", _anomalies, WINDOWS + " is_anomaly", FLAGGED)
query("g10_stream_anomaly", _anomalies, WINDOWS + " is_anomaly last_updated:t", FLAGGED)
query("snk1_overwrite_table", lambda s: _written(s, lambda p: (K.overwrite_table(s.v.freight, p), K.overwrite_table(_order(s), p))), ORDER, ORDER_SQL)
query("snk2_overwrite_partitioned", lambda s: _written(s, lambda p: K.overwrite_partitioned(s.new_fact(s.products), p, ["iso_year", "iso_week"])).groupBy("iso_year", "iso_week").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units")), "iso_year:i iso_week:i rows:i units:i", "SELECT iso_year, iso_week, count(*) AS rows, sum(quantity) AS units FROM fact GROUP BY 1, 2")
query("snk3_append_raw", lambda s: _written(s, lambda p: (K.append_raw(_order(s), p), K.append_raw(_order(s).withColumn("extra", F.lit("x")), p)), lambda p: K.read_merged(s.spark, p)), ORDER + " extra", f"SELECT *, NULL AS extra FROM ({ORDER_SQL}) UNION ALL SELECT *, 'x' FROM ({ORDER_SQL})")


def _replaced(s: Star):
    rows = s.v.order.select("id", "status")
    return _written(s, lambda p: (K.replace_where(rows, p, "status"), K.replace_where(rows.where("status = 'O' and id % 2 = 0"), p, "status")))


query("snk8_replace_where", _replaced, "id:i status", "SELECT id, status FROM f_order WHERE status <> 'O' OR id % 2 = 0")


def _view(s: Star):
    K.create_view(s.v.order, "orders_seen")
    return s.spark.sql("SELECT status, count(*) AS rows FROM orders_seen GROUP BY status")


query("snk12_create_view", _view, "status rows:i", "SELECT status, count(*) AS rows FROM f_order GROUP BY 1")


def _ctas(s: Star):
    K.create_view(s.v.order, "orders_seen")
    return K.ctas(s.spark, "orders_by_priority", "SELECT priority, count(*) AS rows FROM orders_seen GROUP BY priority")


query("snk11_ctas", _ctas, "priority rows:i", "SELECT priority, count(*) AS rows FROM f_order GROUP BY 1")
_results = lambda s: Q.run_checks(s.spark, [{"type": "range", "table": "fact", "column": "quantity", "min": 1, "max": 9}, {"type": "range", "table": "fact", "column": "quantity", "max": 5}], {"fact": s.fact}, ts(NOW))
CHECKED = "SELECT 'quantity' AS column_name, count(*) AS checked, sum((quantity < 1 OR quantity > 9)::INT) AS failed FROM fact UNION ALL SELECT 'quantity', count(*), sum((quantity > 5)::INT) FROM fact"
query("snk16_json_report", lambda s: s.spark.read.json(K.write_json_report(_results(s), K.scratch(s.spark, "report"), "1")), "column_name checked:i failed:i", CHECKED)
query("q3_check_range", _results, "column_name checked:i failed:i", CHECKED)
query("q4_check_freshness", lambda s: Q.run_checks(s.spark, [{"type": "freshness", "table": "fact", "column": "order_updated_at", "hours": h} for h in (1, 1_000_000)], {"fact": s.fact}, ts("2024-01-01 00:00:00")), "checked:i failed:i passed", "SELECT count(*) AS checked, 1 AS failed, false AS passed FROM fact UNION ALL SELECT count(*), 0, true FROM fact")
query("q6_gate", lambda s: Q.gate(_results(s)), "column_name checked:i failed:i", CHECKED)
query("q9_assert_grain", lambda s: s.spark.range(1).select(F.lit(Q.assert_grain(s.fact, ["shopify_line_id"])).alias("rows")), "rows:i", "SELECT count(*) AS rows FROM fact")
query("q12_row_count", lambda s: Q.run_checks(s.spark, [{"type": "row_count", "table": "fact", "min": 1}, {"type": "row_count", "table": "fact", "max": 10}], {"fact": s.fact}, ts(NOW)), "checked:i failed:i", "SELECT count(*) AS checked, 0 AS failed FROM fact UNION ALL SELECT count(*), 1 FROM fact")
query("m3_materialize_metric", lambda s: (s.register(M.views_of("revenue_by_day")), M.materialize_metric(s.spark, "revenue_by_day", 19980101, 19981231, K.scratch(s.spark, "metric")))[1], "day:d value:f", "SELECT day, round(CAST(revenue_cents AS DOUBLE) / 100, 2) AS value FROM sales_day WHERE date_key BETWEEN 19980101 AND 19981231")
query("r3_categorize", lambda s: C.full_outer_compare(*_sides(s), GRAIN).select(*GRAIN, C.categorize(F.col("new_qty"), F.col("old_qty")).alias("status")), "iso_year:i iso_week:i vend_id status", "SELECT iso_year, iso_week, vend_id, status FROM reconciled")
query("d7_build_dim_product", lambda s: L.build_dim_product(s.v.product(1).unionByName(s.v.product(1).withColumn("key", F.col("key") - 1000000).withColumn("season", F.lit("old")))).select("product_key", "sku", "season", "group_name"), "product_key:i sku season group_name", "SELECT product_key, sku, season, group_name FROM dim_product")


def _watermark(s: Star):
    path = K.scratch(s.spark, "marks")
    for batch in (s.fact.where("order_updated_at < timestamp '1999-01-01'"), s.fact.limit(0), s.fact):
        L.watermark_advance(s.spark, path, "fact", batch, "order_updated_at")
    return s.spark.range(1).select(F.lit(L.watermark_read(s.spark, path, "fact")).alias("watermark"))


query("d8_watermark", _watermark, "watermark", "SELECT strftime(max(order_updated_at), '%Y-%m-%d %H:%M:%S') AS watermark FROM fact")
query("d10_late_refund_capture", lambda s: L.build_fact(s.v, s.dates, s.products, s.channels, "2000-01-01", s.v.metafield).where("date_key < 20000101").select("shopify_line_id", "refunded_quantity"), "shopify_line_id refunded_quantity:i", "SELECT shopify_line_id, refunded_quantity FROM fact WHERE order_updated_at >= TIMESTAMP '1999-12-30' AND date_key < 20000101")


def _report(s: Star):
    texts = s.v.web_page.groupBy("date", "page_path").agg(F.sum("event_count").alias("n"), F.sum("add_to_carts").alias("c"))
    texts = texts.select(F.date_format("date", "yyyyMMdd").alias("date"), F.col("page_path").alias("pagePath"), F.col("n").cast("string").alias("screenPageViews"), F.col("c").cast("string").alias("addToCarts"))
    first = L.ingest_web_report(None, texts.withColumn("screenPageViews", F.lit("bad")), "page")
    return L.ingest_web_report(first, texts.where("pagePath <> '/cart'"), "page")


query("g7_ingest_web_report", _report, "date:d page_path event_count:i add_to_carts:i", "SELECT date, page_path, CASE WHEN page_path <> '/cart' THEN sum(event_count) END AS event_count, sum(add_to_carts) AS add_to_carts FROM f_web_page GROUP BY 1, 2")


def _snapshots(s: Star):
    path, ranks = K.scratch(s.spark, "ranks"), _ranking(s)
    for day in ("2026-01-01", "2026-01-02", "2026-01-01"):
        K.replace_where(ranks.withColumn("snapshot_date", F.lit(day)), path, "snapshot_date")
    return s.spark.read.parquet(path).groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date"), "collection").agg(F.count("*").alias("rows"), F.max("position").alias("last"))


query("g8_snapshot_rankings", _snapshots, "snapshot_date collection rows:i last:i", "SELECT d AS snapshot_date, season AS collection, count(*) AS rows, count(*) AS last FROM f_product_1, (VALUES ('2026-01-01'), ('2026-01-02')) t(d) GROUP BY 1, 2")


def _digest(s: Star):
    out, half = K.scratch(s.spark, "digest"), s.fact.where("date_key < 19980101")
    for day, fact in (("2026-01-01", half), ("2026-01-02", half), ("2026-01-02", s.fact)):
        digest = L.success_digest(s.spark, out, fact, _results(s), day)
    return digest


query("g9_success_digest", _digest, "run_date fact_row_count:i delta:i", "SELECT '2026-01-01' AS run_date, count(*) FILTER (date_key < 19980101) AS fact_row_count, 0 AS delta FROM fact UNION ALL SELECT '2026-01-02', count(*), count(*) - count(*) FILTER (date_key < 19980101) FROM fact")
query("st2_trigger_backfill", lambda s: _stream(s).agg(F.count("*").alias("rows"), F.countDistinct("ad_event_id").alias("ids")), "rows:i ids:i", "SELECT count(*) AS rows, count(*) AS ids FROM f_ads_stream")
query("st4_attribute_ads", lambda s: A.breakdown(s.attributed, ["channel", "is_attributed"]), "channel is_attributed:i rows:i", "SELECT channel, is_attributed, count(*) AS rows FROM attributed GROUP BY 1, 2")
query("st8_upsert_gold", lambda s: _anomalies(s).groupBy("channel").agg(F.count("*").alias("windows"), F.sum(F.col("is_anomaly").cast("int")).alias("anomalies"), F.max_by("spend_cents", "window_start").alias("spend_cents")), "channel windows:i anomalies:i spend_cents:i", f"SELECT channel, count(*) AS windows, sum(is_anomaly::INT) AS anomalies, arg_max(spend_cents, window_start) AS spend_cents FROM ({FLAGGED}) GROUP BY 1")
query("st10_stream_status", lambda s: A.dedup_check(_stream(s), "ad_event_id"), "rows:i distinct_keys:i", "SELECT count(*) AS rows, count(DISTINCT ad_event_id) AS distinct_keys FROM f_ads_stream")
query("f13_f14_names", lambda s: s.v.edges.select(S.short_name(F.col("source")).alias("name")).distinct().withColumn("layer", S.layer(F.col("name"))), "name layer:i", "SELECT DISTINCT substr(source, 5) AS name, CASE WHEN source LIKE 'cat.raw%' THEN 0 ELSE 2 END AS layer FROM f_edges")
query("g4_build_cohort", lambda s: L.build_cohort(s.v.order)[1], "cohort_month:d period_index:i active_customers:i retention_rate:f", "SELECT cohort_month, period_index, active_customers, round(active_customers / cohort_size, 4) AS retention_rate FROM retention")


#: Rows of a file of the ads that come in micro-batches, at least, once a part has more.
FILE_ROWS = 20_000


def _late_query(s: Star):
    """Ads in three micro-batches; of the third, those two hours older than the newest of the first are too late (a batch
    holds its rows against the watermark before the last one's). The table and the query that wrote it.

    A batch is as many files as each part has, which grows with the ads; a part has at least FILE_ROWS rows a file, and rows
    dealt in turn leave no file empty."""
    src, out, mark = (K.scratch(s.spark, x) for x in ("json", "silver", "mark"))
    ads = K.stored(s.v.ads_stream, "ads")
    parts = [ads.where(f"spend_cents % 3 = {n}") for n in range(3)]
    files = max(1, min(part.count() for part in parts) // FILE_ROWS)
    for n, part in enumerate(parts):
        part.repartition(files).write.mode("append").option("maxRecordsPerFile", 0).json(src)
        if (there := sum(x.endswith(".json") for x in Folder(s.spark, src).names())) != (n + 1) * files:
            raise RuntimeError(f"{there} files of {n + 1} parts, expected {files} of each")
    stream = s.spark.readStream.schema(ads.schema).option("maxFilesPerTrigger", files).json(src)
    run = ST.stream_to_table(ST.dedup_stream(stream, "ad_event_id", "2 hours"), out, mark)
    run.awaitTermination()
    return s.spark.read.schema(ads.schema).parquet(out), run


_late = lambda s: _late_query(s)[0]
query("st10_stream_progress", lambda s: ST.stream_progress(s.spark, _late_query(s)[1]).where("input_rows > 0").select("batch", "input_rows", "late_rows"), "batch:i input_rows:i late_rows:i", "SELECT spend_cents % 3 AS batch, count(*) AS input_rows, count(*) FILTER (spend_cents % 3 = 2 AND event_time <= w) AS late_rows FROM f_ads_stream, (SELECT max(event_time) - INTERVAL 2 HOUR AS w FROM f_ads_stream WHERE spend_cents % 3 = 0) GROUP BY 1")
query("st9_late_events", _late, ADS, "SELECT a.* FROM f_ads_stream a, (SELECT max(event_time) - INTERVAL 2 HOUR AS w FROM f_ads_stream WHERE spend_cents % 3 = 0) WHERE spend_cents % 3 < 2 OR event_time > w")
query("st3_event_time_watermark", lambda s: A.ad_channel_summary(_late(s)), "channel ads:i spend:f attributed:i", "SELECT channel, count(*) AS ads, round(CAST(sum(spend_cents) AS DOUBLE) / 100, 2) AS spend, count(order_id) AS attributed FROM f_ads_stream a, (SELECT max(event_time) - INTERVAL 2 HOUR AS w FROM f_ads_stream WHERE spend_cents % 3 = 0) WHERE spend_cents % 3 < 2 OR event_time > w GROUP BY 1")


def _product_history(s: Star):
    """The product dimension with history, built from two deliveries."""
    path = K.scratch(s.spark, "products")
    L.build_dim_product_scd2(s.v.product(1), path, ts("1996-01-01 00:00:00"))
    return L.build_dim_product_scd2(s.v.product(2), path, ts("1998-06-01 00:00:00")).where("product_key > 0")


query("g2_build_dim_product_scd2", _product_history, HISTORY, "SELECT * FROM history_2")
RUN_SPECS = [{"type": "unique", "table": "fact_orders_line", "column": "shopify_line_id"}, {"type": "row_count", "table": "fact_orders_line", "min": 1}]


def _two_days(s: Star):
    """A first daily run before 2000, then one over all: the second builds what changed since."""
    out = K.scratch(s.spark, "daily")
    for day, before in (("1999-12-31", "2000-01-01"), (L.END, None)):
        digest = L.daily_run(s.spark, s.v.sf_dir, out, RUN_SPECS, day, before)
    return digest


query("g11_daily_run", _two_days, "run_date fact_row_count:i dq_summary delta:i", "SELECT '1999-12-31' AS run_date, count(*) FILTER (order_updated_at < TIMESTAMP '2000-01-01') AS fact_row_count, '2/2' AS dq_summary, 0 AS delta FROM fact UNION ALL SELECT '2000-12-31', count(*), '2/2', count(*) - count(*) FILTER (order_updated_at < TIMESTAMP '2000-01-01') FROM fact")
def _refreshed(s: Star, metric: bool = True):
    """The metric, or the fact, in tables by ISO week after a build of the orders changed before 2000 and a batch of what changed since."""
    path, dims = K.scratch(s.spark, "weeks"), [s.dates, s.products, s.channels]
    since = L.build_fact(s.v, *dims, "2000-01-01", s.v.metafield)
    for batch in (s.new_fact(s.products).where("order_updated_at < timestamp '2000-01-01'"), since):  # each is written once, in its place
        fact, weeks = L.refresh_fact(batch, f"{path}/fact")
        table = L.refresh_metric(fact, weeks, dims, f"{path}/metric") if metric else fact
    return table.read()


query("m3_metric_refresh", lambda s: _refreshed(s), "iso_year:i iso_week:i vend_id item_description season channel_source channel_group value:i", "SELECT * FROM metric")
query("g11_fact_of_two_batches", lambda s: _refreshed(s, metric=False).groupBy("iso_year", "iso_week").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units"), F.sum("refunded_quantity").alias("refunded"), F.max("order_updated_at").alias("last")), "iso_year:i iso_week:i rows:i units:i refunded:i last:t", "SELECT iso_year, iso_week, count(*) AS rows, sum(quantity) AS units, sum(refunded_quantity) AS refunded, max(order_updated_at) AS last FROM fact GROUP BY 1, 2")
KEY_LISTS = [["shopify_line_id"], ["shopify_order_id", "sku_raw"], ["date_key", "channel_key"], ["product_key"], ["tw_order_id", "quantity"]]
query("q5_unique_keys", lambda s: s.spark.createDataFrame([(",".join(k), *found) for k, found in zip(KEY_LISTS, Q.check_unique_keys(s.fact, KEY_LISTS), strict=True)], "keys string, checked bigint, failed bigint"), "keys checked:i failed:i", " UNION ALL ".join(f"SELECT '{','.join(k)}' AS keys, sum(n) AS checked, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS failed FROM (SELECT count(*) AS n FROM fact GROUP BY {', '.join(k)})" for k in KEY_LISTS))


def _all_dates(s: Star):
    """The fact over all days that the orders have, not only those of the star's calendar."""
    day = F.to_date(S.business_time(F.col("processed_at")))
    first, last = (str(x) for x in s.v.order.agg(F.min(day), F.max(day)).first())
    return L.build_fact(s.v, R.generate_calendar(s.spark, first, last), s.products, s.channels, metafield=s.v.metafield, start=first, end=last)


query("g1_fact_of_all_dates", lambda s: _all_dates(s).groupBy("iso_year", "channel_source_norm").agg(F.count("*").alias("rows"), F.sum("quantity").alias("units"), F.sum("refunded_quantity").alias("refunded"), F.sum(F.col("is_sales_attributable").cast("int")).alias("attributable")), "iso_year:i channel_source_norm rows:i units:i refunded:i attributable:i",
      "SELECT CAST(isoyear((o.processed_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS INTEGER) AS iso_year, t.channel_source_norm, count(*) AS rows, sum(l.quantity) AS units, sum(CAST(coalesce(round(r.q), 0) AS INTEGER)) AS refunded, sum((NOT (coalesce(o.name LIKE '%EXC%', false) OR o.id IN (SELECT order_id FROM f_metafield WHERE replace_refund = 'Replace')))::INT) AS attributable FROM f_line l JOIN f_order o ON l.order_id = o.id LEFT JOIN refund_1 r ON r.order_line_id = l.id LEFT JOIN touch_1 t ON t.order_id = CAST(o.id AS VARCHAR) GROUP BY 1, 2")
