"""Helpers that several operators share: the shared folder, written tables, a global row number."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, as a Java character class; the task fixes it.
SPACE = r"[\x20\x09-\x0D]"


_OWN: dict[str, str] = {}
#: Paths of the tables that `stored` wrote, for each `intermediates` that is open.
_WRITTEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and Spark is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(_OWN[app])
        root = _OWN[app]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder; this cuts the lineage, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, name)
    for paths in _WRITTEN[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `stored` writes inside once the block ends: what reads them has to be written by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            remove(spark, path)


def constant(values: list, kind: str) -> Column:
    """A bounded list from the driver as one array constant of the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def last_at_or_below(bounds: list, kind: str, key: Column, strictly: bool = False) -> Column:
    """How many of the sorted bounds are <= key (or < key), by binary search inside the expression."""
    if not bounds:
        return F.lit(0)
    steps, array = [1 << k for k in reversed(range(len(bounds).bit_length()))], constant(bounds, kind)
    reached = lambda x: x < key if strictly else x <= key
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda a, s: F.when(a + s > len(bounds), a).when(reached(F.get(array, a + s - 1)), a + s).otherwise(a),
    )


def _ranges(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """The rows as a table of sorted ranges, with the number of the range (__part) and the place in it (__at)."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumns({"__part": F.spark_partition_id(), "__at": low.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")


def _before(totals: dict[int, int]) -> Column:
    """The sum over the ranges before a row's; one number for each range reaches the driver and the plan."""
    base, total = [], 0
    for part in range(max(totals, default=-1) + 1):
        base.append(total)
        total += totals.get(part) or 0
    return F.get(constant(base, "bigint"), F.col("__part")) if base else F.lit(0).cast("bigint")


def with_global_index(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position in the given order: ranges are sorted apart, and only a count per range reaches the driver."""
    table = _ranges(df, order, partitions)
    counts = dict(table.groupBy("__part").count().collect())
    return table.withColumn(name, _before(counts) + F.col("__at")).drop("__part", "__at")


def with_running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows before a row in the given order; a window spans one sorted range, never a whole key."""
    table = _ranges(df, order)
    sums = dict(table.groupBy("__part").agg(F.sum(value)).collect())
    earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn(name, _before(sums) + F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop("__part", "__at")
