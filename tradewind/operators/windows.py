"""Window operators: latest rows, sequences, surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ranges import numbered, numbered_whole


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by the order columns, nulls first; the limit on the number is pushed into the sort."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_touch(touches: DataFrame, model: str | None = None) -> DataFrame:
    """The last touch of each order: highest position, then latest click; ids break ties. All models, or one."""
    rows = touches if model is None else touches.where(F.col("attribution_model") == model)
    return latest_by_key(rows, ["order_id"], ["position", "click_date", "tie_1", "tie_2"])


def surrogate_key(df: DataFrame, order: str, name: str, above: int | Column = 0) -> DataFrame:
    """Numbers from above + 1 in the order of a unique column, as bigint: ranges are numbered apart, their counts are the offsets."""
    return numbered_whole(df, [order], name, above)


def order_sequence(orders: DataFrame) -> DataFrame:
    """order_seq within the customer, and cohort_month: the month of the first order. A customer with very many orders is cut into ranges of time."""
    month = F.to_date(F.date_trunc("MONTH", F.col("created_at")))
    return numbered(orders.withColumn("order_month", month), ["customer_id"], ["created_at", "id"], "order_seq", {"cohort_month": "order_month"})


def latest_snapshot_by_update(df: DataFrame, day: str, updated: str) -> DataFrame:
    """All rows of each day's last update; a source restates whole days."""
    last = df.groupBy(day).agg(F.max(updated).alias(updated))
    return df.join(last, [day, updated], "left_semi")


def day_over_day_delta(history: DataFrame, day: str, count: str) -> DataFrame:
    """Change against the run before; 0 for the first. History has one row a run."""
    before = F.lag(count, 1).over(Window.orderBy(day))
    return history.withColumn("delta", F.coalesce(F.col(count) - before, F.lit(0)))


def latest_window_per_channel(gold: DataFrame) -> DataFrame:
    return gold.groupBy("channel").agg(F.max_by(F.struct(*[c for c in gold.columns if c != "channel"]), "window_start").alias("x")).select("channel", "x.*")
