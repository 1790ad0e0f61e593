"""Slowly changing dimensions: classification, merge, integrity and point-in-time views of a version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.scalars import row_hash
from tradewind.operators.windows import surrogate_key

OPEN_END = "9999-12-31 00:00:00"
FIRST_START = "1900-01-01 00:00:00"


def seed_history(snapshot: DataFrame, key: str, tracked: list[str], at: Column, surrogate: str = "product_key") -> DataFrame:
    """Version history of a first snapshot: every key open from the given time."""
    rows = snapshot.select(key, *tracked).withColumn("row_hash", row_hash(tracked))
    rows = rows.withColumns({"effective_from": at, "effective_to": F.lit(OPEN_END).cast("timestamp"), "is_current": F.lit(True)})
    return surrogate_key(rows, key, surrogate)


def seed_unknown(history: DataFrame, key: str, surrogate: str = "product_key") -> DataFrame:
    """Adds the unknown member, key 0, open from the start of time, where it isn't there."""
    if history.where(F.col(surrogate) == 0).limit(1).count():
        return history
    values = {surrogate: F.lit(0), key: F.lit("UNKNOWN"), "effective_from": F.lit(FIRST_START).cast("timestamp"), "effective_to": F.lit(OPEN_END).cast("timestamp"), "is_current": F.lit(True)}
    row = history.sparkSession.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in history.schema])
    return history.unionByName(row)


def classify(snapshot: DataFrame, history: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """The snapshot's rows with change: new, changed or unchanged against the live versions."""
    live = history.where("is_current").select(F.col(key).alias("__k"), F.col("row_hash").alias("__h"))
    rows = snapshot.select(key, *tracked).withColumn("row_hash", row_hash(tracked)).join(live, F.col(key) == F.col("__k"), "left")
    change = F.when(F.col("__k").isNull(), "new").when(F.col("__h") != F.col("row_hash"), "changed").otherwise("unchanged")
    return rows.withColumn("change", change).drop("__k", "__h")


def merge(history: DataFrame, snapshot: DataFrame, key: str, tracked: list[str], run_at: Column, surrogate: str = "product_key") -> DataFrame:
    """The history after the snapshot: changed live versions end at run_at, their successors and new keys open there.

    Keys that the snapshot lacks stay current. An unchanged snapshot changes nothing.
    """
    rows = classify(snapshot, history, key, tracked)
    fresh = rows.where("change <> 'unchanged'").drop("change")
    top = history.agg(F.max(surrogate)).first()[0] or 0
    opened = fresh.withColumns({"effective_from": run_at, "effective_to": F.lit(OPEN_END).cast("timestamp"), "is_current": F.lit(True)})
    opened = surrogate_key(opened, key, surrogate, top)
    ended = rows.where("change = 'changed'").select(F.col(key).alias("__k"))
    marked = history.join(ended, F.col("is_current") & (F.col(key) == F.col("__k")), "left")
    over = F.col("__k").isNotNull()
    kept = marked.withColumns({"effective_to": F.when(over, run_at).otherwise(F.col("effective_to")), "is_current": F.col("is_current") & ~over}).drop("__k")
    return kept.unionByName(opened)


def integrity(history: DataFrame, key: str, surrogate: str = "product_key") -> DataFrame:
    """Counts of violations in one row: several current or open versions of a key, repeated surrogate keys."""
    per_key = history.groupBy(key).agg(F.sum(F.col("is_current").cast("int")).alias("current"), F.sum((F.col("effective_to") == F.lit(OPEN_END).cast("timestamp")).cast("int")).alias("open"))
    keys = per_key.agg(F.count("*").alias("keys"), F.sum((F.col("current") > 1).cast("int")).alias("several_current"), F.sum((F.col("open") != 1).cast("int")).alias("not_one_open"))
    numbers = history.agg((F.count("*") - F.countDistinct(surrogate)).alias("repeated_surrogates"), F.count("*").alias("versions"))
    return keys.crossJoin(numbers)


def current_view(history: DataFrame) -> DataFrame:
    return history.where("is_current")
