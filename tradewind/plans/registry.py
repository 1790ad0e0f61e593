"""All queries of the retail operators, each with the SQL that DuckDB runs on the same tables.

Results have simple types only, so that both engines agree: dates and times are texts, counts bigint, money double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.fixtures import CTES
from tradewind.plans.pipelines import Star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TEXT = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}

#: The star schema as common table expressions, over those of the views.
STAR = """
dim_date AS (SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date_actual, CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(week(d) AS INTEGER) AS iso_week, CAST(isodow(d) AS INTEGER) AS iso_day_of_week, CAST(year(d) AS INTEGER) AS cal_year, CAST(month(d) AS INTEGER) AS cal_month, CAST(day(d) AS INTEGER) AS cal_day, CAST(quarter(d) AS INTEGER) AS cal_quarter, monthname(d) AS month_name, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend
  FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2000-12-31', INTERVAL 1 DAY) t(d)),
dim_product AS (SELECT CAST(row_number() OVER (ORDER BY sku) AS INTEGER) AS product_key, sku, trim(vend_id) AS vend_id, coalesce(trim(item_description), 'UNKNOWN') AS item_description, season, group_name, gender, class_name, coalesce(master_style, 'UNKNOWN') AS master_style, cost, retail, item_description IS NOT NULL AS is_complete, TIMESTAMP '2000-12-31 06:00:00' AS _ingested_at FROM f_product_1 WHERE sku IS NOT NULL AND trim(sku) <> ''
  UNION ALL SELECT 0, 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', NULL, NULL, false, TIMESTAMP '2000-12-31 06:00:00'),
dim_channel(channel_key, channel_source, channel_group, is_paid, is_meta) AS (VALUES {channels}),
touch_1 AS (SELECT *, CASE WHEN regexp_matches(trim(source), '(?i)^google%') THEN 'google-ads' WHEN lower(trim(source)) = 'emarsys' THEN 'Emarsys' ELSE trim(source) END AS channel_source_norm
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY position DESC NULLS LAST, click_date DESC NULLS LAST, tie_1 DESC, tie_2 DESC) AS n FROM f_touch) WHERE n = 1),
refund_1 AS (SELECT order_line_id, sum(quantity) AS q FROM f_refund GROUP BY 1),
fact AS (SELECT coalesce(c.channel_key, 0) AS channel_key, coalesce(p.product_key, 0) AS product_key, x.date_key, CAST(x.order_id AS VARCHAR) AS shopify_order_id, x.name AS shopify_order_name, t.order_id AS tw_order_id, x.id AS shopify_line_id, x.sku AS sku_raw, x.quantity, CAST(coalesce(round(r.q), 0) AS INTEGER) AS refunded_quantity, x.price AS pre_tax_price, t.source AS tw_channel_source, t.channel_source_norm, t.click_date AS tw_touch_ts, t.attribution_model, t.position, t.campaign_id, t.adset_id, t.ad_id, x.financial_status, x.is_exc_order, x.is_replacement_order, NOT (x.is_exc_order OR x.is_replacement_order) AS is_sales_attributable, d.iso_year, d.iso_week, x.updated_at AS order_updated_at, TIMESTAMP '2000-12-31 06:00:00' AS _ingested_at
  FROM (SELECT l.*, o.name, o.financial_status, o.updated_at, CAST(strftime((o.processed_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y%m%d') AS INTEGER) AS date_key, coalesce(o.name LIKE '%EXC%', false) AS is_exc_order, o.id IN (SELECT order_id FROM f_metafield WHERE replace_refund = 'Replace') AS is_replacement_order FROM f_line l JOIN f_order o ON l.order_id = o.id) x
  LEFT JOIN refund_1 r ON r.order_line_id = x.id LEFT JOIN touch_1 t ON t.order_id = CAST(x.order_id AS VARCHAR) LEFT JOIN dim_date d ON d.date_key = x.date_key
  LEFT JOIN dim_product p ON p.sku = x.sku LEFT JOIN dim_channel c ON c.channel_source = t.channel_source_norm WHERE x.date_key BETWEEN 19960101 AND 20001231),
star AS (SELECT f.* EXCLUDE (iso_year, iso_week), d.* EXCLUDE (date_key), p.* EXCLUDE (product_key, sku, _ingested_at), p.sku AS product_sku, c.* EXCLUDE (channel_key) FROM fact f JOIN dim_date d USING (date_key) JOIN dim_product p USING (product_key) JOIN dim_channel c USING (channel_key)),
metric AS (SELECT iso_year, iso_week, vend_id, item_description, season, channel_source, channel_group, sum(quantity - refunded_quantity) AS value FROM star WHERE is_sales_attributable AND vend_id IS NOT NULL GROUP BY ALL),
valid_order AS (SELECT * FROM f_order WHERE customer_id IS NOT NULL AND created_at IS NOT NULL AND cancelled_at IS NULL AND NOT coalesce(test, false) AND NOT coalesce(deleted, false) AND coalesce(financial_status, '') NOT IN ('refunded', 'voided')),
seq AS (SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS order_month, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS order_seq, CAST(min(date_trunc('month', created_at)) OVER (PARTITION BY customer_id) AS DATE) AS cohort_month FROM valid_order),
monthly AS (SELECT order_month, count(CASE WHEN order_seq = 1 THEN 1 END) AS new_orders, count(CASE WHEN order_seq > 1 THEN 1 END) AS returning_orders, coalesce(sum(CASE WHEN order_seq = 1 THEN total_cents END), 0) AS new_cents, coalesce(sum(CASE WHEN order_seq > 1 THEN total_cents END), 0) AS returning_cents FROM seq GROUP BY 1),
activity AS (SELECT DISTINCT customer_id, cohort_month, datediff('month', cohort_month, order_month) AS period_index FROM seq),
retention AS (SELECT a.cohort_month, a.period_index, count(*) AS active_customers, s.cohort_size FROM activity a JOIN (SELECT cohort_month, count(*) AS cohort_size FROM activity WHERE period_index = 0 GROUP BY 1) s USING (cohort_month) GROUP BY 1, 2, 4),
net_line AS (SELECT *, coalesce(price_cents, 0) * quantity - coalesce(discount_cents, 0) AS net_line_cents FROM f_line),
page_sales AS (SELECT CAST(o.processed_at - INTERVAL 5 HOURS AS DATE) AS date, l.order_id, l.sku, l.quantity, l.net_line_cents, '/products/' || p.handle AS page
  FROM net_line l JOIN f_order o ON o.id = l.order_id AND NOT coalesce(o.deleted, false) JOIN (SELECT order_id, sum(quantity) AS q FROM f_line GROUP BY 1) t USING (order_id) JOIN f_product_page p ON p.id = l.product_id
  WHERE l.net_line_cents <> 0 AND t.q <= 30 AND p.handle IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f_refund r JOIN f_line x ON x.id = r.order_line_id WHERE x.order_id = l.order_id AND x.sku = l.sku)),
page_agg AS (SELECT date, page, count(DISTINCT order_id) AS unique_orders, sum(quantity) AS unique_sold, sum(net_line_cents) AS net_cents, max(group_name) AS category, max(gender) AS gender, max(item_description) AS descr FROM page_sales LEFT JOIN (SELECT * FROM dim_product WHERE product_key > 0) USING (sku) GROUP BY 1, 2),
web_agg AS (SELECT date, regexp_extract(page_path, '(/products/[^/?#]+)', 1) AS page, sum(event_count) AS event_count, sum(add_to_carts) AS add_to_cart FROM f_web_page WHERE regexp_extract(page_path, '(/products/[^/?#]+)', 1) <> '' GROUP BY 1, 2),
traffic AS (SELECT date, regexp_extract(landing_page, '(/products/[^/?#]+)', 1) AS page, {pivot} FROM f_web_traffic WHERE regexp_extract(landing_page, '(/products/[^/?#]+)', 1) <> '' GROUP BY 1, 2),
page_view AS (SELECT a.*, coalesce(w.event_count, 0) AS event_count, coalesce(w.add_to_cart, 0) AS add_to_cart, {filled} FROM page_agg a LEFT JOIN web_agg w USING (date, page) LEFT JOIN traffic t USING (date, page)),
active AS (SELECT DISTINCT shipment_id FROM f_shipment_item WHERE loaded_at >= (SELECT max(loaded_at) FROM f_shipment_item) - INTERVAL 8 DAY),
receiving AS (SELECT i.*, s.* EXCLUDE (shipment_id), quantity_shipped - quantity_received AS receiving_gap, coalesce(CAST(try_strptime(nullif(regexp_extract(shipment_name, '(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), ''), '%m/%d/%Y') AS DATE), CAST(try_strptime(nullif(regexp_extract(shipment_name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d') AS DATE)) AS created_date
  FROM (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id, seller_sku ORDER BY loaded_at DESC, load_id DESC) AS n FROM f_shipment_item WHERE shipment_id IN (FROM active)) WHERE n = 1) i LEFT JOIN f_shipment s USING (shipment_id)),
sales_day AS (SELECT CAST(processed_at AS DATE) AS day, sum(total_cents) AS revenue_cents, count(*) AS orders, CAST(strftime(CAST(processed_at AS DATE), '%Y%m%d') AS INTEGER) AS date_key FROM valid_order GROUP BY 1, 4),
attributed AS (SELECT a.ad_event_id, a.order_id, a.channel, a.spend_cents, a.event_time, coalesce(o.amount_cents, 0) AS revenue_cents, CASE WHEN o.order_id IS NULL THEN 0 ELSE 1 END AS is_attributed FROM f_ads_stream a LEFT JOIN f_orders_stream o ON a.order_id = o.order_id AND a.event_time BETWEEN o.event_time - INTERVAL 2 MINUTE AND o.event_time + INTERVAL 2 MINUTE),
windows AS (SELECT date_trunc('minute', event_time) - to_minutes(k) AS window_start, date_trunc('minute', event_time) - to_minutes(k) + INTERVAL 5 MINUTE AS window_end, channel, sum(spend_cents) AS spend_cents, sum(revenue_cents) AS revenue_cents, round(sum(revenue_cents) / nullif(CAST(sum(spend_cents) AS DOUBLE), 0), 2) AS roas, sum(is_attributed) AS order_count FROM attributed, range(5) t(k) GROUP BY 1, 2, 3),
channel_gold AS (SELECT w.*, coalesce(w.spend_cents >= 2000 AND b.n >= 3 AND w.roas < b.r * 0.5, false) AS is_anomaly FROM windows w LEFT JOIN (SELECT channel, avg(roas) AS r, count(*) AS n FROM windows GROUP BY 1) b USING (channel)),
ads_day AS (SELECT CAST(event_time AS DATE) AS day, channel, sum(spend_cents) AS spend_cents, sum(revenue_cents) AS revenue_cents, sum(is_attributed) AS new_customers, CAST(strftime(CAST(event_time AS DATE), '%Y%m%d') AS INTEGER) AS date_key FROM attributed GROUP BY 1, 2, 6),
history_1 AS (SELECT CAST(row_number() OVER (ORDER BY sku) AS INTEGER) AS product_key, sku, season, retail, sha256(concat_ws('||', coalesce(season, '<NULL>'), coalesce(CAST(retail AS VARCHAR), '<NULL>'))) AS row_hash, TIMESTAMP '1996-01-01' AS effective_from, TIMESTAMP '9999-12-31' AS effective_to, true AS is_current FROM f_product_1),
change_2 AS (SELECT p.sku, p.season, p.retail, sha256(concat_ws('||', coalesce(p.season, '<NULL>'), coalesce(CAST(p.retail AS VARCHAR), '<NULL>'))) AS row_hash, CASE WHEN h.sku IS NULL THEN 'new' WHEN h.row_hash <> sha256(concat_ws('||', coalesce(p.season, '<NULL>'), coalesce(CAST(p.retail AS VARCHAR), '<NULL>'))) THEN 'changed' ELSE 'unchanged' END AS change FROM f_product_2 p LEFT JOIN history_1 h USING (sku)),
history_2 AS (SELECT h.product_key, h.sku, h.season, h.retail, h.row_hash, h.effective_from, CASE WHEN c.change = 'changed' THEN TIMESTAMP '1998-06-01' ELSE h.effective_to END AS effective_to, coalesce(c.change, '') <> 'changed' AS is_current FROM history_1 h LEFT JOIN change_2 c USING (sku)
  UNION ALL SELECT (SELECT max(product_key) FROM history_1) + CAST(row_number() OVER (ORDER BY sku) AS INTEGER), sku, season, retail, row_hash, TIMESTAMP '1998-06-01', TIMESTAMP '9999-12-31', true FROM change_2 WHERE change <> 'unchanged'),
legacy AS (SELECT iso_year, iso_week, vend_id, CASE WHEN CAST(replace(vend_id, 'Brand#', '') AS INTEGER) % 3 = 1 THEN q * 103 // 100 WHEN CAST(replace(vend_id, 'Brand#', '') AS INTEGER) % 3 = 2 THEN q * 110 // 100 ELSE q END AS qty FROM (SELECT iso_year, iso_week, vend_id, CAST(sum(value) AS BIGINT) AS q FROM metric WHERE vend_id <> 'UNKNOWN' GROUP BY ALL) WHERE (iso_year * 53 + iso_week + CAST(replace(vend_id, 'Brand#', '') AS INTEGER)) % 17 <> 0),
ours AS (SELECT iso_year, iso_week, vend_id, CAST(sum(value) AS BIGINT) AS qty FROM metric WHERE vend_id <> 'UNKNOWN' AND (iso_year * 53 + iso_week + CAST(replace(vend_id, 'Brand#', '') AS INTEGER)) % 19 <> 0 GROUP BY ALL),
compared AS (SELECT coalesce(a.iso_year, b.iso_year) AS iso_year, coalesce(a.iso_week, b.iso_week) AS iso_week, coalesce(a.vend_id, b.vend_id) AS vend_id, coalesce(a.qty, 0) AS new_qty, coalesce(b.qty, 0) AS old_qty FROM ours a FULL JOIN legacy b ON a.iso_year = b.iso_year AND a.iso_week = b.iso_week AND a.vend_id = b.vend_id),
reconciled AS (SELECT *, new_qty - old_qty AS diff, round(CAST(abs(new_qty - old_qty) AS DOUBLE) / greatest(new_qty, old_qty, 1), 4) AS pct, CASE WHEN old_qty = 0 AND new_qty > 10 THEN 'MISSING_OLD' WHEN new_qty = 0 AND old_qty > 10 THEN 'MISSING_NEW' WHEN CAST(abs(new_qty - old_qty) AS DOUBLE) / greatest(new_qty, old_qty, 1) < 0.02 THEN 'PASS' WHEN CAST(abs(new_qty - old_qty) AS DOUBLE) / greatest(new_qty, old_qty, 1) < 0.05 THEN 'WARN' ELSE 'FAIL' END AS status FROM compared)
"""


def _star_sql() -> str:
    from tradewind.fixtures import GROUPS
    from tradewind.operators.aggregates import column_of
    from tradewind.sources.readers import CHANNELS

    channels = ", ".join(str(row) for row in CHANNELS)
    pivot = ", ".join(f"sum(CASE WHEN channel_group = '{g}' THEN sessions ELSE 0 END) AS {column_of(g)}" for g in GROUPS)
    filled = ", ".join(f"coalesce(t.{column_of(g)}, 0) AS {column_of(g)}" for g in GROUPS)
    return STAR.format(channels=channels, pivot=pivot, filled=filled)


PREFIX = f"WITH {CTES.strip()},\n{_star_sql().strip()}\n"


def simple(df: DataFrame) -> DataFrame:
    """Dates and times as texts, whole numbers as bigint, decimals as double."""
    from pyspark.sql import functions as F

    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in _TEXT:
            c = F.date_format(c, _TEXT[kind])
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def simple_sql(sql: str, columns: dict[str, str]) -> str:
    """The same for DuckDB: d date, t time, i bigint, f double, anything else as it is."""
    cast = {"d": "strftime({0}, '%Y-%m-%d')", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "i": "CAST({0} AS BIGINT)", "f": "CAST({0} AS DOUBLE)"}
    listed = ", ".join(f"{cast.get(k, '{0}').format(c)} AS {c}" for c, k in columns.items())
    return f"{PREFIX}SELECT {listed} FROM ({sql})"


def query(name: str, make: Callable[[Star], DataFrame], columns: str, sql: str | None = None) -> None:
    """Registers a query. columns: 'name:kind name ...' of the result, in the oracle's kinds."""
    kinds = dict((c.split(":") + [""])[:2] for c in columns.split())
    QUERIES[name] = lambda spark, sf_dir: simple(make(Star(spark, sf_dir))).select(*kinds)
    if sql is not None:
        ORACLES[name] = simple_sql(sql, kinds)
