"""Lineage graphs: nodes, overlays, and what lies up- and downstream of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions import scalars as S
from tradewind.sources.sinks import stored


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct ends with their short names and layers."""
    full = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    name = S.short_name(F.col("node"))
    return full.select("node", name.alias("name"), S.layer(name).alias("layer"))


def overlay(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with those of the mapping (table, node) whose table is in the graph."""
    known = edges.select(F.col("source").alias("table")).union(edges.select("target")).distinct()
    more = mapping.join(known, "table", "left_semi").select(F.col("table").alias("source"), F.col("node").alias("target"))
    return edges.select("source", "target").union(more).distinct()


def _closure(edges: DataFrame, start: str, come: str, go: str) -> DataFrame:
    """Nodes reachable from start, by path doubling: after round k all within 2^k - 1 edges are seen, so rounds grow with
    the logarithm of the longest way. A jump joins the ends of 2^k edges in a row; both tables are written each round."""
    seen = edges.sparkSession.createDataFrame([(start,)], "node string")
    jumps, n = edges.select(F.col(come).alias("low"), F.col(go).alias("high")).where("low <> high").distinct(), 1
    while True:
        seen = stored(seen.union(seen.join(jumps, F.col("node") == F.col("low")).select("high")).distinct(), "seen")
        if n == (n := seen.count()):
            return seen
        again = jumps.select(F.col("low").alias("middle"), F.col("high").alias("end"))
        jumps = stored(jumps.join(again, F.col("high") == F.col("middle")).select("low", F.col("end").alias("high")).distinct(), "jumps")


def connected(edges: DataFrame, node: str) -> DataFrame:
    """Everything upstream and everything downstream of the node, and itself. Meant for graphs of tables: jumps are pairs of nodes."""
    return _closure(edges, node, "target", "source").union(_closure(edges, node, "source", "target")).distinct()


def build_edges(events: DataFrame, schema: str) -> DataFrame:
    """Last time seen of each edge between two tables, one of them in the schema. Columns source, target, event_time."""
    from tradewind.operators.filters import self_edge_filter

    return self_edge_filter(events, schema).groupBy("source", "target").agg(F.max("event_time").alias("last_seen"))
