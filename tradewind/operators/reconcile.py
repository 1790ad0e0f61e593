"""Reconciliation of two systems at a common grain, and customer classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.joins import full_outer_compare

WARN, FAIL, SMALL = 0.02, 0.05, 10


def normalize_side(df: DataFrame, keys: list[str], style: str, qty: str) -> DataFrame:
    """Int keys, trimmed style, and quantity; a quantity that is no number is 0."""
    return df.select(*[F.expr(f"try_cast({k} as int)").alias(k) for k in keys], F.trim(style).alias(style), F.coalesce(F.expr(f"try_cast({qty} as bigint)"), F.lit(0)).alias("qty"))


def categorize(new: Column, old: Column) -> Column:
    """MISSING_OLD or MISSING_NEW where one side has nothing and the other more than a little, else by the relative gap."""
    gap = F.abs(new - old) / F.greatest(new, old, F.lit(1))
    one_sided = F.when((old == 0) & (new > SMALL), "MISSING_OLD").when((new == 0) & (old > SMALL), "MISSING_NEW")
    return one_sided.when(gap < WARN, "PASS").when(gap < FAIL, "WARN").otherwise("FAIL")


def reconcile(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    a, b = F.col("new_qty"), F.col("old_qty")
    both = full_outer_compare(new, old, keys)
    return both.withColumns({"diff": a - b, "pct": F.round(F.abs(a - b) / F.greatest(a, b, F.lit(1)), 4), "status": categorize(a, b)})


def summary(compared: DataFrame) -> DataFrame:
    total = F.sum("old_qty")
    per = compared.groupBy("status").agg(F.count("*").alias("rows"), F.sum("new_qty").alias("new_qty"), total.alias("old_qty"), F.sum(F.abs("diff")).alias("abs_diff"))
    return per


def worst(compared: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    bad = compared.where("status in ('FAIL', 'MISSING_OLD', 'MISSING_NEW')")
    return bad.orderBy(F.desc("pct"), F.desc(F.abs("diff")), *keys).limit(n)


def itemize_residual(compared: DataFrame, reasons: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each differing row with the first reason whose keys it is among, or 'unexplained'."""
    rows = compared.where("diff <> 0")
    reason = F.lit("unexplained")
    for n, (name, df) in reversed(list(enumerate(reasons.items()))):
        rows = rows.join(df.select(*keys).distinct().withColumn(f"__r{n}", F.lit(True)), keys, "left")
        reason = F.when(F.col(f"__r{n}"), name).otherwise(reason)
    return rows.withColumn("reason", reason).drop(*[f"__r{n}" for n in range(len(reasons))])


def day_by_day_parity(a: DataFrame, b: DataFrame, day: str = "day") -> DataFrame:
    return full_outer_compare(a, b, [day]).withColumn("delta", F.col("new_qty") - F.col("old_qty"))


def left_censoring_curve(orders: DataFrame, cutoffs: list[str]) -> DataFrame:
    """Share of orders that look like a customer's first when history starts at each cut-off date."""
    starts = F.explode(F.array(*[F.lit(c).cast("date") for c in cutoffs]))
    seen = orders.where("customer_id is not null").select("customer_id", "id", F.to_date("created_at").alias("day"), "created_at", starts.alias("cutoff")).where("day >= cutoff")
    # the first of each customer and cut-off is one; no order needs to be numbered
    per = seen.groupBy("cutoff", "customer_id").agg(F.count("*").alias("n"))
    return per.groupBy("cutoff").agg(F.sum("n").alias("orders"), F.count("*").alias("first_orders"), F.round(100.0 * F.count("*") / F.sum("n"), 4).alias("pct_first"))


def customer_classification(orders: DataFrame, gap_days: int = 365) -> DataFrame:
    """First-time, Returning or Re-engaged (more than gap_days since the order before) for each order."""
    w = Window.partitionBy("customer_id").orderBy("created_at", "id")
    before = F.lag("created_at").over(w)
    days = F.datediff(F.to_date("created_at"), F.to_date(before))
    kind = F.when(before.isNull(), "First-time").when(days > gap_days, "Re-engaged").otherwise("Returning")
    return orders.where("customer_id is not null").withColumn("customer_type", kind)
