"""Dashboard figures as DataFrame operators over metric results."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kpi_totals(metric: DataFrame) -> DataFrame:
    return metric.agg(F.sum("value").alias("units"), F.countDistinct("vend_id").alias("styles"), F.countDistinct("channel_source").alias("channels"), F.countDistinct("iso_year", "iso_week").alias("weeks"))


def weekly_series(metric: DataFrame) -> DataFrame:
    """Units of each channel in each week that any channel has, 0 where it sold nothing."""
    sums = metric.groupBy("iso_year", "iso_week", "channel_source").agg(F.sum("value").alias("value"))
    weeks, channels = metric.select("iso_year", "iso_week").distinct(), metric.select("channel_source").distinct()
    return weeks.crossJoin(channels).join(sums, ["iso_year", "iso_week", "channel_source"], "left").fillna(0, ["value"])


def style_channel_matrix(metric: DataFrame, channels: list[str]) -> DataFrame:
    """Units of each style in a column for each channel, and their total."""
    wide = metric.groupBy("vend_id").pivot("channel_source", channels).agg(F.sum("value"))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in channels]
    return wide.select("vend_id", *[x.alias(f"c{n}") for n, x in enumerate(cells)], sum(cells[1:], cells[0]).alias("total"))


def facets(metric: DataFrame, columns: list[str]) -> DataFrame:
    return metric.select(*columns).distinct().orderBy(*columns)


def by_group(metric: DataFrame, group: str) -> DataFrame:
    """Units by a group column; blanks are '(ungrouped)'."""
    name = F.coalesce(F.nullif(F.trim(F.col(group)), F.lit("")), F.lit("(ungrouped)"))
    return metric.groupBy(name.alias("channel")).agg(F.sum("value").alias("value"))


def cohort_kpi(retention: DataFrame, monthly: DataFrame) -> DataFrame:
    """Share of customers who came again, share of returning orders in the latest month, number of cohorts."""
    later = retention.where("period_index > 0").groupBy("cohort_month").agg(F.max("active_customers").alias("again"), F.max("cohort_size").alias("size"))
    a = later.agg(F.round(100.0 * F.sum("again") / F.sum("size"), 2).alias("repurchase_pct"))
    last = monthly.agg(F.max_by(F.struct("new_orders", "returning_orders"), "order_month").alias("x"))
    b = last.select(F.round(100.0 * F.col("x.returning_orders") / (F.col("x.new_orders") + F.col("x.returning_orders")), 2).alias("latest_returning_pct"))
    return a.crossJoin(b).crossJoin(retention.agg(F.countDistinct("cohort_month").alias("cohorts")))


def retention_heatmap(retention: DataFrame, cohorts: int = 18, months: int = 12) -> DataFrame:
    """The last cohorts in rows, months since the first order in columns, percent."""
    last = retention.select("cohort_month").distinct().orderBy(F.desc("cohort_month")).limit(cohorts)
    rows = retention.where(F.col("period_index") <= months).join(last, "cohort_month", "left_semi")
    wide = rows.groupBy("cohort_month").pivot("period_index", list(range(months + 1))).agg(F.max(F.round(F.col("active_customers") * 100 / F.col("cohort_size"), 1)))
    return wide.select("cohort_month", *[F.col(f"`{m}`").alias(f"m{m}") for m in range(months + 1)])


def receiving_kpi(gold: DataFrame) -> DataFrame:
    return gold.agg(F.countDistinct("shipment_id").alias("shipments"), F.countDistinct("seller_sku").alias("skus"), F.sum("quantity_shipped").alias("shipped"), F.sum("receiving_gap").alias("gap"))


def revenue_30_days(daily: DataFrame, last: str) -> DataFrame:
    """Total revenue, mean order value and the latest day of the 30 days up to last. Columns day, revenue_cents, orders."""
    rows = daily.where(F.col("day").between(F.date_sub(F.lit(last).cast("date"), 29), F.lit(last).cast("date")))
    aov = F.col("revenue_cents").cast("double") / F.col("orders") / 100
    return rows.agg(F.round(F.sum("revenue_cents").cast("double") / 100, 2).alias("revenue"), F.round(F.avg(aov), 3).alias("mean_aov"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest_day"))


def spend_matrix(ads: DataFrame, channels: list[str]) -> DataFrame:
    wide = ads.groupBy("day").pivot("channel", channels).agg(F.sum("spend_cents"))
    return wide.select("day", *[F.round(F.coalesce(F.col(c), F.lit(0)).cast("double") / 100, 2).alias(c) for c in channels])


def date_preset(name: str, today: date) -> tuple[date, date]:
    """First and last day of a named range that ends yesterday or today."""
    back = {"7d": 6, "4w": 27, "90d": 89}
    return (today.replace(day=1), today) if name == "month" else (today - timedelta(days=back[name]), today)


def page_of(df: DataFrame, order: list, page: int, size: int = 25) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)
