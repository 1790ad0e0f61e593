"""Filters, projections and cleaning steps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import UNKNOWN


def filter_since(df: DataFrame, column: str, watermark: str | None, lookback_days: int = 2) -> DataFrame:
    """Rows changed since the watermark less a lookback; all rows without a watermark."""
    return df if watermark is None else df.where(F.col(column) >= F.lit(watermark).cast("timestamp") - F.make_dt_interval(days=F.lit(lookback_days)))


def filter_window(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_missing_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != ""))


def fill_sentinels(df: DataFrame, columns: list[str], sentinel: str = UNKNOWN) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.trim(F.col(c)), F.lit(sentinel)) for c in columns})


def completeness_flag(df: DataFrame, columns: list[str], sentinel: str = UNKNOWN) -> DataFrame:
    return df.withColumn("is_complete", ~reduce(or_, [F.col(c) == sentinel for c in columns]))


def bad_numeric_to_null(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast({c} as {kind})") for c in columns})


def exclusion_flags(df: DataFrame, name: str = "order_name", replaced: str = "is_replacement_order") -> DataFrame:
    """is_exc_order by name, and is_sales_attributable: neither excluded nor a replacement."""
    df = df.withColumn("is_exc_order", F.coalesce(F.col(name).like("%EXC%"), F.lit(False)))
    return df.withColumn("is_sales_attributable", ~(F.col("is_exc_order") | F.col(replaced)))


def valid_orders(df: DataFrame) -> DataFrame:
    """Orders of a known customer and time that were not cancelled, tests, deleted, refunded or voided."""
    live = F.col("customer_id").isNotNull() & F.col("created_at").isNotNull() & F.col("cancelled_at").isNull()
    real = ~F.coalesce("test", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    return df.where(live & real & ~F.coalesce("financial_status", F.lit("")).isin("refunded", "voided"))


def soft_delete_filter(df: DataFrame, column: str = "deleted") -> DataFrame:
    return df.where(~F.coalesce(F.col(column), F.lit(False)))


def sales_line_filter(df: DataFrame, most: int = 30) -> DataFrame:
    """Lines with a net value and a page, of orders that are no bulk orders. Columns net_line_cents, order_quantity, handle."""
    return df.where((F.col("net_line_cents") != 0) & (F.col("order_quantity") <= most) & F.col("handle").isNotNull())


def optional_in(df: DataFrame, column: str, values: list | None) -> DataFrame:
    return df.where(F.col(column).isin(values)) if values else df


def date_between(df: DataFrame, column: str, start: int, end: int) -> DataFrame:
    """A yyyyMMdd range on an int key, or on a date column."""
    if df.schema[column].dataType.simpleString() == "date":
        day = lambda k: F.to_date(F.lit(str(k)), "yyyyMMdd")
        return df.where(F.col(column).between(day(start), day(end)))
    return df.where(F.col(column).between(start, end))


def recent_windows(df: DataFrame, minutes: int, now: Column) -> DataFrame:
    return df.where(F.col("window_start") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def self_edge_filter(df: DataFrame, schema: str) -> DataFrame:
    """Edges with two different ends, one of them in the schema."""
    inside = F.col("source").contains(schema) | F.col("target").contains(schema)
    return df.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target")) & inside)


def prefix_columns(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def derived_measures(lines: DataFrame) -> DataFrame:
    """Net value of each line in cents; a missing price or discount counts as 0."""
    net = F.coalesce("price_cents", F.lit(0)) * F.col("quantity") - F.coalesce("discount_cents", F.lit(0))
    return lines.withColumn("net_line_cents", net.cast("bigint"))


def order_journey(touches: DataFrame, order_id: str | None = None, model: str | None = None) -> DataFrame:
    """Touches in order of position, of one order or model if given."""
    rows = touches if order_id is None else touches.where(F.col("order_id") == order_id)
    rows = rows if model is None else rows.where(F.col("attribution_model") == model)
    return rows.orderBy("order_id", "position", "click_date", "tie_1", "tie_2")
