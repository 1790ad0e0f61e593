"""Keyed tables over Parquet: rows in buckets, immutable folders, and a manifest that says which bucket is where.

Buckets are hashes of the key, or values of an expression such as a week (then a key may move from one to another).

An upsert writes its rows into a new folder, copies there what else the buckets that they touch have, and then publishes a new
manifest; readers see one version or the next, and nothing is renamed or overwritten. A second writer that started from the
same version fails to publish. Folders that no kept manifest names are removed by vacuum.

Number of buckets: so many that a bucket fits a task (about 128 MB); it is fixed when the table is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window  # noqa: F401  a test takes Window away
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.sources.sinks import CODEC, stored

BUCKET = "__bucket"
#: Hashed buckets up to which each task writes its rows of all of them, so that whole rows aren't shuffled by bucket.
DIRECT = 16
#: Replaced keys up to which they are sent to the tasks that copy the rows beside them.
REPLACED = 500_000


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A row's bucket; nulls are values like others."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Folder:
    """Small files of a folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.spark, self.fs = spark, self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self.fs.exists(self.at(name)):
            return []
        return sorted(n for n in (x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if n[0] not in "._" or "=" in n)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file under another name and renames it; fails where the name is taken."""
        draft = self.at(f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(text.encode())
        stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self.at(name), none)
        except Exception as e:
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer published {name} first; start again from its version") from e

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class VersionedTable:
    """What a table's versions have in common: a manifest each, of which the last counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def exists(self) -> bool:
        return bool(self.folder.names("versions"))

    def manifest(self) -> dict:
        return json.loads(self.folder.read(f"versions/{self.folder.names('versions')[-1]}"))

    def _commit(self, state: dict) -> None:
        self.folder.fs.mkdirs(self.folder.at("versions"))
        self.folder.publish(f"versions/{state['version']:012d}.json", json.dumps(state))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last versions and the folders that none of these names; for times without readers of older ones."""
        names = self.folder.names("versions")
        used = {f for v in names[-keep:] for f in json.loads(self.folder.read(f"versions/{v}"))["folders"]}
        gone = [f for f in self.folder.names("data") if f not in used]
        for name in [*(f"versions/{v}" for v in names[:-keep]), *(f"data/{f}" for f in gone)]:
            self.folder.remove(name)
        return gone


class KeyedTable(VersionedTable):
    """A table of unique keys; nulls in keys are equal to each other. Manifest: keys, buckets or by, schema, and the buckets that are valid in each folder."""

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int = 64, by: str | None = None) -> KeyedTable:
        """A new table of df's rows, whose keys have to be unique. by: an SQL expression of whole numbers in place of the hash."""
        table = cls(df.sparkSession, path)
        if table.exists():
            raise ValueError(f"{path} is a table already")
        empty = {"version": 0, "keys": keys, "buckets": buckets, "by": by, "schema": df.schema.jsonValue(), "folders": {}}
        table._commit(table._merged(empty, df)[0] | {"version": 1})
        return table

    def buckets(self, state: dict | None = None) -> set[int]:
        return {b for own in (state or self.manifest())["folders"].values() for b in own}

    def paths(self, state: dict, buckets: set[int] | None = None) -> list[str]:
        return [f"{self.folder.path}/data/{f}/{BUCKET}={b}" for f, own in state["folders"].items() for b in own if buckets is None or b in buckets]

    def read(self, state: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, or the buckets asked for."""
        state = state or self.manifest()
        schema, paths = StructType.fromJson(state["schema"]), self.paths(state, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, state: dict) -> Column:
        return F.coalesce(F.expr(state["by"]), F.lit(-1)).cast("int") if state.get("by") else bucket_of(state["keys"], state["buckets"])

    def _there(self, name: str) -> list[int]:
        """The buckets that a folder has."""
        return sorted(int(x.split("=")[1]) for x in self.folder.names(f"data/{name}"))

    def _next(self, state: dict, name: str, schema: StructType, touched: set[int]) -> dict:
        """The next version, in which a new folder has all rows of the touched buckets."""
        folders = {f: kept for f, own in state["folders"].items() if (kept := [b for b in own if b not in touched])}
        there = self._there(name)
        return state | {"version": state["version"] + 1, "schema": schema.jsonValue(), "folders": folders | ({name: there} if there else {})}

    def _write(self, state: dict, rows: DataFrame, name: str) -> None:
        """Adds rows to a folder, a file or a few a bucket: of few buckets each task writes its own, of more they are dealt by bucket first."""
        rows = rows.withColumn(BUCKET, self._bucket(state))
        few = not state.get("by") and state["buckets"] <= DIRECT
        (rows if few else rows.hint("rebalance", BUCKET)).write.mode("append").option("compression", CODEC).partitionBy(BUCKET).parquet(f"{self.folder.path}/data/{name}")

    def _merged(self, state: dict, source: DataFrame) -> tuple[dict, set[int]]:
        """The next version with the source's rows in place of those of their keys, and which buckets were rewritten.

        The source is computed once and written where it stays. Of its keys and the table's only hashes are shuffled, to see
        which rows it repeats or replaces. The other rows of the touched buckets are copied by the tasks that read them; where
        more than REPLACED keys are replaced, they are joined with these by Spark's choice, which may shuffle them.
        """
        keys, name = state["keys"], uuid.uuid4().hex
        rows = self.read(state).limit(0).unionByName(source, allowMissingColumns=True) if state["folders"] else source  # columns of both
        self._write(state, rows, name)
        touched = set(self._there(name))
        if not touched:
            self.folder.remove(f"data/{name}")
            return state, touched
        fresh = self.spark.read.schema(rows.schema).parquet(*[f"{self.folder.path}/data/{name}/{BUCKET}={b}" for b in sorted(touched)])
        h = F.xxhash64(*keys).alias("__h")
        twice = fresh.select(h).groupBy("__h").count().where("count > 1")
        if twice.limit(1).count() and fresh.join(twice, h == F.col("__h"), "left_semi").groupBy(*keys).count().where("count > 1").limit(1).count():
            self.folder.remove(f"data/{name}")
            raise ValueError(f"the source has several rows for a key of {keys}")
        if state["folders"]:
            known = self.read(state, None if state.get("by") else touched)  # a key's bucket is the same, or may be any where it is by an expression
            hits = stored(known.select(h, self._bucket(state).alias(BUCKET)).join(fresh.select(h), "__h", "left_semi").distinct(), "hits")
            touched |= {r[0] for r in hits.select(BUCKET).distinct().collect()}
            replaced = stored(fresh.select(*[F.col(k).alias(f"__s_{k}") for k in keys], h).join(hits.select("__h"), "__h", "left_semi").drop("__h"), "replaced")
            few = replaced.count() <= REPLACED
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys])
            old = self.read(state, touched).join(F.broadcast(replaced) if few else replaced, same, "left_anti")
            old = old.unionByName(fresh.limit(0), allowMissingColumns=True).withColumn(BUCKET, self._bucket(state))
            old.write.mode("append").option("compression", CODEC).partitionBy(BUCKET).parquet(f"{self.folder.path}/data/{name}")
        return self._next(state, name, rows.schema, touched), touched

    def replace(self, source: DataFrame, buckets: set[int]) -> None:
        """Makes the source's rows all that the given buckets have; it has none of other buckets."""
        state, name = self.manifest(), uuid.uuid4().hex
        self._write(state, source, name)
        self._commit(self._next(state, name, source.schema, set(buckets)))

    def upsert(self, source: DataFrame) -> set[int]:
        """Puts the source's rows in; returns the buckets rewritten. New columns are added, missing ones become null."""
        state, touched = self._merged(self.manifest(), source)
        if touched:
            self._commit(state)
        return touched


class LoggedTable(VersionedTable):
    """Rows that are appended, and rewritten now and then (compacted, corrected); streams read what was appended only.

    An append is a folder of its own name, a rewrite another, and the manifest says which of them are the table. A stream
    follows the names of appends, so that a rewritten row never comes twice; vacuum removes replaced appends, which a stream
    must have read by then.
    """

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType) -> LoggedTable:
        table = cls(spark, path)
        if not table.exists():
            table._commit({"version": 1, "schema": schema.jsonValue(), "folders": []})
            table.folder.fs.mkdirs(table.folder.at("data"))
        return table

    def read(self) -> DataFrame:
        state = self.manifest()
        schema, paths = StructType.fromJson(state["schema"]), [f"{self.folder.path}/data/{f}" for f in state["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame) -> None:
        """Streams see the rows when the folder gets its name; other writers don't stand in the way."""
        name = uuid.uuid4().hex
        df.select(*StructType.fromJson(self.manifest()["schema"]).names).write.parquet(f"{self.folder.path}/data/_{name}")
        self.folder.fs.rename(self.folder.at(f"data/_{name}"), self.folder.at(f"data/append-{name}"))
        for _ in range(100):
            state = self.manifest()
            with suppress(RuntimeError):
                return self._commit(state | {"version": state["version"] + 1, "folders": [*state["folders"], f"append-{name}"]})
        raise RuntimeError(f"append-{name} is written but not published")

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the table by what change makes of it; fails where another writer publishes meanwhile."""
        state, name = self.manifest(), f"rewrite-{uuid.uuid4().hex}"
        change(self.read()).select(*StructType.fromJson(state["schema"]).names).write.parquet(f"{self.folder.path}/data/{name}")
        self._commit(state | {"version": state["version"] + 1, "folders": [name]})

    def compact(self, files: int = 1) -> None:
        """The same rows in fewer files."""
        self.rewrite(lambda df: df.repartition(files))

    def stream(self) -> DataFrame:
        """Appended rows as they come, each once, whatever is rewritten."""
        return self.spark.readStream.schema(StructType.fromJson(self.manifest()["schema"])).parquet(f"{self.folder.path}/data/append-*")


def upsert_row(spark: SparkSession, path: str, key: str, row: DataFrame) -> DataFrame:
    """Puts one row into a small state table of one bucket, which it makes if need be; returns the table."""
    table = KeyedTable(spark, path)
    if table.exists():
        table.upsert(row)
    else:
        table = KeyedTable.create(row, path, [key], 1)
    return table.read()


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """A state table, or None before it is made."""
    table = KeyedTable(spark, path)
    return table.read() if table.exists() else None
