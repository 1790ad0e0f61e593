"""The metric layer: named, parameterized SQL over the star's temp views, run with bound parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NET = "quantity - refunded_quantity"
_FILTERS = """
  AND (cast(:channels AS array<string>) IS NULL OR array_contains(cast(:channels AS array<string>), c.channel_source))
  AND (cast(:seasons AS array<string>) IS NULL OR array_contains(cast(:seasons AS array<string>), p.season))
  AND (cast(:styles AS array<string>) IS NULL OR array_contains(cast(:styles AS array<string>), p.vend_id))"""
_STAR = "fact f JOIN dim_date d ON f.date_key = d.date_key JOIN dim_product p ON f.product_key = p.product_key JOIN dim_channel c ON f.channel_key = c.channel_key"
_DAYS = "f.date_key BETWEEN :start AND :end AND d.date_key BETWEEN :start AND :end AND f.is_sales_attributable"

VIEWS = ("fact", "dim_date", "dim_product", "dim_channel", "page_view", "receiving", "sales_day", "ads_day", "cohort_monthly", "cohort_retention", "channel_gold")
#: id -> (SQL, filters), over these views.
METRICS: dict[str, tuple[str, tuple[str, ...]]] = {
    "quantity_by_style_channel_week": (
        f"SELECT d.iso_year, d.iso_week, p.vend_id, p.item_description, p.season, c.channel_source, c.channel_group, sum({_NET}) AS value FROM {_STAR} WHERE {_DAYS} AND p.vend_id IS NOT NULL {_FILTERS} GROUP BY ALL",
        ("channels", "seasons", "styles"),
    ),
    "units_dollars_by_sku_channel_week": (
        f"SELECT date_add(d.date_actual, 7 - d.iso_day_of_week) AS week_ending_date, p.sku, c.channel_source AS channel, sum({_NET}) AS units_sold, cast(round(sum(({_NET}) * pre_tax_price), 2) AS double) AS dollar_sales FROM {_STAR} WHERE {_DAYS} AND p.sku IS NOT NULL {_FILTERS} GROUP BY ALL HAVING units_sold <> 0",
        ("channels", "seasons", "styles"),
    ),
    "page_view_by_product": ("SELECT page, sum(unique_orders) AS unique_orders, sum(unique_sold) AS unique_sold, round(sum(net_cents) / 100D, 2) AS net_sales, max(category) AS category FROM page_view WHERE date BETWEEN to_date(cast(:start AS string), 'yyyyMMdd') AND to_date(cast(:end AS string), 'yyyyMMdd') GROUP BY page", ()),
    "revenue_by_day": ("SELECT day, round(sum(revenue_cents) / 100D, 2) AS value FROM sales_day WHERE date_key BETWEEN :start AND :end GROUP BY day", ()),
    "aov_by_day": ("SELECT day, round(sum(revenue_cents) / 100D / nullif(sum(orders), 0), 4) AS value FROM sales_day WHERE date_key BETWEEN :start AND :end GROUP BY day", ()),
    "order_count_by_day": ("SELECT day, sum(orders) AS value FROM sales_day WHERE date_key BETWEEN :start AND :end GROUP BY day", ()),
    "ad_spend_by_day": ("SELECT day, channel, round(sum(spend_cents) / 100D, 2) AS value FROM ads_day WHERE date_key BETWEEN :start AND :end GROUP BY day, channel", ()),
    "roas_by_channel": ("SELECT channel, round(sum(revenue_cents) / nullif(cast(sum(spend_cents) AS double), 0), 4) AS value FROM ads_day WHERE date_key BETWEEN :start AND :end GROUP BY channel", ()),
    "cohort_new_vs_returning_by_month": ("SELECT * FROM cohort_monthly WHERE cast(date_format(order_month, 'yyyyMMdd') AS int) BETWEEN :start AND :end", ()),
    "cohort_retention_matrix": ("SELECT * FROM cohort_retention WHERE cast(date_format(cohort_month, 'yyyyMMdd') AS int) BETWEEN :start AND :end", ()),
    "cac_by_channel": ("SELECT channel, round(sum(spend_cents) / 100D / nullif(sum(new_customers), 0), 4) AS value FROM ads_day WHERE date_key BETWEEN :start AND :end GROUP BY channel", ()),
}
SNAPSHOTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "amazon_fba_receiving_by_sku": (
        "SELECT * FROM receiving WHERE (cast(:statuses AS array<string>) IS NULL OR array_contains(cast(:statuses AS array<string>), shipment_status)) AND (cast(:fcs AS array<string>) IS NULL OR array_contains(cast(:fcs AS array<string>), destination_fc_id))",
        ("statuses", "fcs"),
    ),
    "channel_health": ("SELECT channel, count(*) AS windows, sum(cast(is_anomaly AS bigint)) AS anomalies FROM channel_gold GROUP BY channel", ()),
}
#: Filters of the portal: label and the metrics that take them.
FILTERS = {name: [m for m, (_, f) in (METRICS | SNAPSHOTS).items() if name in f] for name in ("channels", "seasons", "styles", "statuses", "fcs")}


def views_of(metric: str) -> list[str]:
    """The views that a metric or snapshot reads; a caller needs to register no others."""
    sql = (METRICS | SNAPSHOTS)[metric][0]
    return [v for v in VIEWS if re.search(rf"\b(FROM|JOIN) {v}\b", sql)]


def _values(given: dict, known: tuple[str, ...]) -> dict:
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown filters: {unknown}")
    return {k: given.get(k) or None for k in known}


def query_metric(spark: SparkSession, metric: str, start: int, end: int, **filters: list[str] | None) -> DataFrame:
    """A metric over an inclusive yyyyMMdd range; None or an empty list is no filter. Values are bound, never pasted."""
    if metric not in METRICS:
        raise KeyError(f"unknown metric {metric}")
    if end < start:
        raise ValueError(f"the range ends at {end}, before {start}")
    sql, known = METRICS[metric]
    return spark.sql(sql, args={"start": start, "end": end} | _values(filters, known))


def query_snapshot(spark: SparkSession, metric: str, **filters: list[str] | None) -> DataFrame:
    if metric not in SNAPSHOTS:
        raise KeyError(f"unknown snapshot {metric}")
    sql, known = SNAPSHOTS[metric]
    return spark.sql(sql, args=_values(filters, known))


def materialize_metric(spark: SparkSession, metric: str, start: int, end: int, path: str) -> DataFrame:
    query_metric(spark, metric, start, end).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
