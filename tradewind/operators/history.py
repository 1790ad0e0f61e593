"""A version history kept in two parts: live versions in a keyed table of buckets, closed ones in folders that are never written again.

A merge classifies the snapshot against the live part, appends the versions that end to a new closed folder, puts the new
live versions into the buckets that they touch, and publishes both in one manifest. What it costs follows the live part and
the changes, not the versions ever kept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators import scd
from tradewind.sources.sinks import stored
from tradewind.sources.tables import KeyedTable


class History(KeyedTable):
    """The history of one key's tracked columns; all_versions and live are tables to read."""

    @classmethod
    def begin(cls, snapshot: DataFrame, path: str, key: str, tracked: list[str], at: Column, buckets: int = 64, surrogate: str = "product_key", unknown: bool = False) -> History:
        """Every key of a first snapshot open from the given time; on request with the unknown member, key 0."""
        table = cls(snapshot.sparkSession, path)
        if table.exists():
            raise ValueError(f"{path} is a table already")
        seeded = scd.seed_history(snapshot, key, tracked, at, surrogate)
        seeded = stored(scd.seed_unknown(seeded, key, surrogate) if unknown else seeded, "seeded")
        top = seeded.agg(F.max(surrogate)).first()[0] or 0
        empty = {"version": 0, "keys": [key], "buckets": buckets, "by": None, "schema": seeded.schema.jsonValue(), "folders": {}, "tracked": tracked, "surrogate": surrogate, "top": top, "closed": []}
        state = table._merged(empty, seeded)[0]
        table._commit(state | {"version": 1})
        return table

    def live(self) -> DataFrame:
        return self.read()

    def closed(self, state: dict | None = None) -> DataFrame:
        state = state or self.manifest()
        schema, paths = StructType.fromJson(state["schema"]), [f"{self.folder.path}/closed/{f}" for f in state["closed"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def all_versions(self) -> DataFrame:
        """Live and closed versions of one manifest."""
        state = self.manifest()
        return self.read(state).unionByName(self.closed(state))

    def merge(self, snapshot: DataFrame, run_at: Column) -> set[int]:
        """Changed live versions end at run_at, their successors and new keys open there; returns the live buckets rewritten.

        Keys that the snapshot lacks stay live; an unchanged snapshot publishes nothing.
        """
        state = self.manifest()
        (key,), surrogate = state["keys"], state["surrogate"]
        live = self.read(state)
        rows = stored(scd.classify(snapshot, live, key, state["tracked"]).where("change <> 'unchanged'"), "changes")
        opened = rows.drop("change").withColumns({"effective_from": run_at, "effective_to": F.lit(scd.OPEN_END).cast("timestamp"), "is_current": F.lit(True)})
        opened = stored(scd.surrogate_key(opened, key, surrogate, state["top"]), "opened")
        after, touched = self._merged(state, opened.select(*live.columns))
        if not touched:
            return touched
        ended = self.read(state, touched).join(rows.where("change = 'changed'").select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")
        name = uuid.uuid4().hex
        ended.withColumns({"effective_to": run_at, "is_current": F.lit(False)}).write.parquet(f"{self.folder.path}/closed/{name}")
        self._commit(after | {"top": state["top"] + opened.count(), "closed": [*state["closed"], name]})
        return touched

    def vacuum(self, keep: int = 1) -> list[str]:
        """As of a keyed table; closed folders of merges that were never published go too."""
        used = {f for v in self.folder.names("versions") for f in json.loads(self.folder.read(f"versions/{v}"))["closed"]}
        for f in self.folder.names("closed"):
            if f not in used:
                self.folder.remove(f"closed/{f}")
        return super().vacuum(keep)


def open_history(spark: SparkSession, path: str) -> History | None:
    """The history at a path, or None before its first delivery."""
    table = History(spark, path)
    return table if table.exists() else None
