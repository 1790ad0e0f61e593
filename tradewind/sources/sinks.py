"""Write modes over plain Parquet: overwrite, append, upserts by key, retention, reports.

Tables that are read while they change are keyed tables with versions, see tables.py.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Compression of the tables that are written; the fact takes about a third less than by Spark's default.
CODEC = "zstd"


def overwrite_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)


def overwrite_partitioned(df: DataFrame, path: str, columns: list[str], parts: int | None = None) -> None:
    """Full replacement partitioned by columns; rows of a partition are brought together, so that files stay few, and those
    of a large one are split over tasks."""
    df = df.repartition(parts, *columns) if parts else df.hint("rebalance", *columns)
    df.write.mode("overwrite").option("compression", CODEC).partitionBy(*columns).parquet(path)


def append_raw(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """An appended table whose files may differ in columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"the source has several rows for a key of {keys}")


def _on(keys: list[str], null_safe: bool) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) if null_safe else F.col(f"t.{k}") == F.col(f"s.{k}")
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str], null_safe: bool = False, check: bool = True) -> DataFrame:
    """The target with the source's rows in place of those of the same key, and its new ones added."""
    if check:
        assert_unique(source, keys)
    kept = target.alias("t").join(source.select(*keys).alias("s"), _on(keys, null_safe), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def merge_edges(target: DataFrame, source: DataFrame) -> DataFrame:
    """Edges of both with the later time last seen; one aggregation, no join."""
    return target.unionByName(source).groupBy("source", "target").agg(F.max("last_seen").alias("last_seen"))


def replace_where(df: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_key(target: DataFrame, key: str, value, row: DataFrame) -> DataFrame:
    return target.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(row)


def retention_delete(df: DataFrame, column: str, days: int, today: Column) -> DataFrame:
    """Rows of the last days."""
    return df.where(F.col(column) >= F.date_sub(today, days))


def ctas(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """Creates or replaces a table of a query's rows in the warehouse."""
    spark.sql(sql).write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def export_csv(df: DataFrame, path: str, headers: dict[str, str]) -> None:
    """CSV files, one a partition, each with exact headers in this order and RFC 4180 quotes."""
    renamed = df.select(*[F.col(c).alias(h) for c, h in headers.items()])
    renamed.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_report(results: DataFrame, path: str, run_id: str) -> str:
    out = f"{path}-{run_id}"
    results.coalesce(1).write.mode("overwrite").json(out)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, below the
    warehouse, for a local Spark only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that `stored` wrote, for each `intermediates` that is open.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    for paths in _OPEN[-1:]:
        paths.append(path)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `stored` writes inside once the block ends: what reads them has to be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)
