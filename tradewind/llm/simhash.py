"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie that prunes node pairs by Hamming distance.

TURNS tries are walked, over the fingerprints turned by a multiple of 64 / TURNS bits each. Of two fingerprints within
so many bits there is a turn in which, for each n, the first n of the TURNS parts have n / TURNS of these bits at most (if
every turn had too many somewhere, going round from each such place would count more than there are). So in each trie
node pairs with more differing bits than that go: with 4 bits and 8 parts, the first part must be equal. The top of the
tries is walked as tables of node pairs, one bit a level; a pair with few fingerprints below it
leaves the tables, and its subtrees are walked inside a task, which returns a spanning forest of the links it found.
A pair of large nodes goes down another level instead, so that one large group of near copies is spread over tasks.

Defined results: texts without words (or null) have fingerprint zero and are linked like any other; repeated rows are
in the component of their fingerprint; ties can't arise, as a component has its smallest id; an id that is null never becomes a component's id unless all its ids are null;
an empty table gives an empty result; other columns don't matter to the groups, and texts of any length are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import stored

WORDS = 4
BITS = 4
TURNS = 8
#: A node pair with so many fingerprints at most is finished inside one task.
PAIR = 4096
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    of = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist(), strict=True))
    for low in range(0, n, 1 << 14):
        hashes = np.array([of(joined[a:b], 42) for a, b in spans[low : low + (1 << 14)]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(sum(1 << k for k in range(64) if 2 * counts[k] > n))


@F.pandas_udf(T.LongType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], dtype=np.uint64).view(np.int64))


def _budget(depth: int, bits: int) -> int:
    """The most bits in which prefixes of so many bits may differ."""
    return -(-depth * TURNS // 64) * bits // TURNS


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Union-find over positions, by whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            order = np.lexsort((low, high))
            low, high = low[order], high[order]
            first = np.concatenate(([True], high[1:] != high[:-1]))
            self.root[high[first]] = low[first]
            while (up := self.root[self.root]) is not None and (up != self.root).any():
                self.root = up
            a, b = a[apart], b[apart]


def trie_links(left: np.ndarray, right: np.ndarray, depth: int, bits: int, link) -> None:
    """Calls link(i, j) with positions in the sorted arrays left and right of values within so many bits.

    Node pairs are ranges of the two arrays that share a prefix each; they are split at the next bit, all pairs of a
    level at once, and pruned by the differing bits of their prefixes. Long frontiers are walked piece by piece.
    """
    stack = [(depth, np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]))]
    one = np.uint64(1)
    while stack:
        at, a0, a1, b0, b1 = stack.pop()
        if len(a0) > CHUNK:
            for k in range(0, len(a0), CHUNK):
                stack.append((at, *(x[k : k + CHUNK] for x in (a0, a1, b0, b1))))
            continue
        small = (a1 - a0) * (b1 - b0) <= (16 if at < 64 else 1 << 62)
        if small.any():
            n = ((a1 - a0) * (b1 - b0))[small]
            pair = np.repeat(np.flatnonzero(small), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (b1 - b0)[pair]
            i, j = a0[pair] + k // wide, b0[pair] + k % wide
            near = _count(left[i] ^ right[j]) <= bits
            if near.any():
                link(i[near], j[near])
            a0, a1, b0, b1 = (x[~small] for x in (a0, a1, b0, b1))
        if not len(a0):
            continue
        bit = np.uint64(63 - at)
        halves = []
        for values, low, high in ((left, a0, a1), (right, b0, b1)):
            border = ((values[low] >> bit) | one) << bit
            middle = np.clip(np.searchsorted(values, border), low, high)
            halves.append(((low, middle), (middle, high)))
        parts = []
        for x0, x1 in halves[0]:
            for y0, y1 in halves[1]:
                some = (x1 > x0) & (y1 > y0)
                p, q, r, s = x0[some], x1[some], y0[some], y1[some]
                near = _count((left[p] ^ right[r]) >> bit) <= _budget(at + 1, bits)
                parts.append((p[near], q[near], r[near], s[near]))
        stack.append((at + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _back(values: np.ndarray, turn: int) -> np.ndarray:
    """The fingerprints whose bits were turned to the left by so many parts."""
    n = np.uint64(turn * 64 // TURNS)
    return (values >> n) | (values << (np.uint64(64) - n)) if turn else values


def _walk(bits: int):
    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turn, depth, node = (int(x) for x in key)
        values = np.unique(pdf["turned"].to_numpy().view(np.uint64))
        own = np.arange(len(values))
        if depth:
            own = np.flatnonzero((values >> np.uint64(64 - depth)) == np.uint64(node))
        forest = Forest(len(values))
        if len(own):
            trie_links(values[own], values, depth if len(own) == len(values) else 0, bits, lambda i, j: forest.link(own[i], j))
        out = np.flatnonzero(forest.root != np.arange(len(values)))
        plain = _back(values, turn).view(np.int64)
        return pd.DataFrame({"a": plain[out], "b": plain[forest.root[out]]})

    return walk


def near_links(prints: DataFrame, bits: int = BITS, pair: int = PAIR) -> DataFrame:
    """(a, b): links between the distinct values of column print whose components are those of all links within bits."""
    left = lambda n: F.shiftleft("print", n).bitwiseOR(F.shiftrightunsigned("print", 64 - n)) if n else F.col("print")
    turned = [F.struct(F.lit(t).alias("turn"), left(t * 64 // TURNS).alias("turned")) for t in range(TURNS)]
    both = stored(prints.select(F.explode(F.array(*turned)).alias("x")).select("x.*"), "turned")
    at = lambda depth, c="turned": F.shiftrightunsigned(c, 64 - depth) if depth else F.lit(0).cast("bigint")
    pairs = both.groupBy("turn").count().select("turn", F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("count").alias("na"), F.col("count").alias("nb"))
    done, depth = [], 0
    while True:
        pairs = stored(pairs, "pairs")
        large = (F.col("na") + F.col("nb") > pair) if depth < 64 else F.lit(False)
        light = pairs.where(~large)
        members = both.withColumn("b", at(depth))
        asked = light.select("turn", "a", "b").union(light.where("a != b").select("turn", "a", F.col("a").alias("b"))).distinct()
        done.append(members.join(asked, ["turn", "b"]).select("turn", F.lit(depth).alias("depth"), "a", "turned"))
        heavy = pairs.where(large)
        if depth == 64 or not heavy.limit(1).count():
            break
        depth += 1
        nodes = both.groupBy("turn", at(depth).alias("node")).agg(F.count("*").alias("n"))
        up = F.shiftrightunsigned("node", 1)
        side = lambda c: nodes.select("turn", up.alias(c), F.col("node").alias(f"{c}2"), F.col("n").alias(f"n{c}2"))  # noqa: E731,B023
        down = heavy.select("turn", "a", "b").join(side("a"), ["turn", "a"]).join(side("b"), ["turn", "b"])
        down = down.where((F.col("a2") <= F.col("b2")) & (F.bit_count(F.col("a2").bitwiseXOR(F.col("b2"))) <= _budget(depth, bits)))
        pairs = down.select("turn", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("na2").alias("na"), F.col("nb2").alias("nb"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    return rows.groupBy("turn", "depth", "a").applyInPandas(_walk(bits), "a bigint, b bigint")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, id): nodes has node and id; a linked component gets its smallest id. Labels go along links and jump to their label's label."""
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("node"))
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).where("x != y").distinct(), "edges")
    linked = nodes.join(edges.select(F.col("x").alias("node")).distinct(), "node", "left_semi")
    labels = stored(linked.select("node", first.alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = step.withColumn("via", F.col("label.node")).join(jump, "via").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("old")).alias("moved"))
        step = stored(step, "labels")
        labels = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    found = labels.select("node", F.col("label.id").alias("__new"), F.lit(True).alias("__linked"))
    return nodes.join(found, "node", "left").select("node", F.when(F.col("__linked"), F.col("__new")).otherwise(F.col("id")).alias("id"))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, th (hash of the text), print (the fingerprint as a signed long) and component_id for each row of docs."""
    prints = stored(docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint_of("text").alias("print")), "prints")
    nodes = stored(prints.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("id")), "nodes")
    links = stored(near_links(nodes.select(F.col("node").alias("print")), bits), "links")
    # a table of its own, so that Spark may split the rows of a fingerprint that very many documents have
    found = stored(components(nodes, links).select(F.col("node").alias("print"), F.col("id").alias("component_id")), "found")
    return prints.join(found, "print").select("doc_id", "th", "print", "component_id")


def keep_one_of_each(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of docs whose id is their component's, one row an id; rows without id stay where no id is in their component."""
    found = stored(near_duplicates(docs, bits), "components")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept"), F.col("th").alias("__th")).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.xxhash64("text") == F.col("__th")), "left_semi")
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1 or doc_id is null").drop("__n")
