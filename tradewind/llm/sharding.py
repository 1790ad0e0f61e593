"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, and overfull ranges are subdivided.

Shards differ in bytes by the size of their border documents, so with few and very unequal documents they are less equal.

Defined results: a null text counts as empty, a null id sorts first, repeated rows are separate rows with slots of
their own, and rows equal in all that is kept may lie in several ranges; very long texts only count by their size; an
empty table gives an empty result, other columns are carried only on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import constant, last_at_or_below, stored

RANGES_PER_SHARD = 64
#: A range has about so many rows, where RANGES_PER_SHARD would leave it more.
ROWS_PER_RANGE = 1 << 20
SAMPLES_PER_RANGE = 16
ROUNDS = 4


Splitter = tuple[int, int, int]


def _sample(rows: DataFrame, n: int) -> list[Splitter]:
    """n keys drawn without replacement with chances in proportion to size: the n smallest of exponential draws over size."""
    u = (F.pmod(F.xxhash64("__key", "__sub", "__row", F.lit(9)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = rows.select("__key", "__sub", "__row", (-F.log(u) / F.col("__size")).alias("p")).orderBy("p", "__key", "__sub", "__row").limit(n)
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _range(bounds: list[Splitter]) -> Column:
    splitters = [{"k": k, "s": s, "r": r} for k, s, r in bounds]
    at = F.struct(F.col("__key").alias("k"), F.col("__sub").alias("s"), F.col("__row").alias("r"))
    return last_at_or_below(splitters, "struct<k:bigint,s:bigint,r:bigint>", at)


def split_ranges(rows: DataFrame, n_ranges: int) -> list[Splitter]:
    """Quantile boundaries of (__key, __sub, __row) by bytes. A range above twice the mean in bytes or rows is sampled again inside."""
    sample = _sample(rows, n_ranges * SAMPLES_PER_RANGE)
    bounds = sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)}) if sample else []
    for _ in range(ROUNDS):
        by_range = rows.withColumn("__range", _range(bounds))
        stats = by_range.groupBy("__range").agg(
            F.sum("__size").alias("size"),
            F.count("*").alias("n"),
            F.min(F.struct("__key", "__sub", "__row")).alias("low"),
            F.max(F.struct("__key", "__sub", "__row")).alias("high"),
        ).collect()
        size, n = sum(r["size"] for r in stats) / n_ranges, sum(r["n"] for r in stats) / n_ranges
        over = [r["__range"] for r in stats if r["low"] != r["high"] and r["n"] > 2 and (r["size"] > 2 * size or r["n"] > 2 * n)]
        if not over:
            break
        inside = by_range.where(F.array_contains(constant(over, "int"), F.col("__range")))
        more = _sample(inside, max(1, len(over)) * SAMPLES_PER_RANGE)
        step = max(1, SAMPLES_PER_RANGE // 4)
        added = set(more[::step]) - set(bounds)
        if not added:
            break
        bounds = sorted({*bounds, *added})
    return bounds


def assign_shards(df: DataFrame, n_shards: int, key: Column, tie: list[Column], size: Column, keep: list[Column]) -> DataFrame:
    """keep columns, size, shard and slot of each row; shards are runs of rows in key order with near equal sums of size.

    key orders the rows, tie (such as the id) orders rows of one key, and lets a hot key be cut into several ranges.
    Bytes differ between shards by no more than the largest row.
    """
    rows = df.select(*keep, size.cast("bigint").alias("__size"), F.xxhash64(key).alias("__key"), F.xxhash64(*tie, F.lit(1)).alias("__sub"))
    # a number of the row, which the table keeps, lets rows that are equal in all else be cut apart
    rows = stored(rows.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())), "keys")
    bounds = split_ranges(rows, max(n_shards * RANGES_PER_SHARD, -(-rows.count() // ROWS_PER_RANGE)))
    ranged = rows.withColumn("__range", _range(bounds))
    stats = {r[0]: (r[1], r[2]) for r in ranged.groupBy("__range").agg(F.sum("__size"), F.count("*")).collect()}
    bytes_before, rows_before, b, n = [], [], 0, 0
    for k in range(len(bounds) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + stats.get(k, (0, 0))[0], n + stats.get(k, (0, 0))[1]
    names = [c for c in rows.columns if not c.startswith("__")]
    w = Window.partitionBy("__range").orderBy("__key", "__sub", *names, "__row")
    ends = F.get(constant(bytes_before, "bigint"), F.col("__range")) + F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.get(constant(rows_before, "bigint"), F.col("__range")) + F.row_number().over(w) - 1
    middle = F.col("__end") - F.col("__size") / 2
    placed = ranged.withColumns({"__end": ends, "__at": at}).select(
        *names, F.col("__size").alias("size"), "__at", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / max(b, 1))).cast("int").alias("shard")
    )
    placed = stored(placed, "placed")
    first = dict(placed.groupBy("shard").agg(F.min("__at")).collect())
    start = F.get(constant([first.get(k, 0) for k in range(n_shards)], "bigint"), F.col("shard"))
    return placed.withColumn("slot", F.col("__at") - start).drop("__at")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, text_crc32, size, shard, slot. Equal texts are neighbours in key order, so they share a shard unless a border cuts them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return assign_shards(docs, n_shards, text, [F.col("doc_id")], F.octet_length(text) + 1, [F.col("doc_id"), F.crc32(text).alias("text_crc32")])
