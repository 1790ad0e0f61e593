"""Periodic runs of words: stretches that repeat with a period, found by the Lyndon roots of a text and extended both ways.

A run of period q is maximal and at least LEAST words and TIMES periods long. Every run holds, under the order of words
or its reverse, a longest Lyndon word of length q at some of its positions (its root). So for either order the longest
Lyndon word at each position is a candidate, and how far its repetition reaches to the right and left are two longest
common extensions: depths of lowest common ancestors in the suffix trees (Ukkonen) of the words and of their reversal.
An Euler tour gives the shallowest node between neighbouring leaves, and a table of minima over it answers in constant time.

Only stretches covered by windows of LEAST * (TIMES - 1) / TIMES words that occur twice go into a tree: a run without its
last period, and without its first, is covered by such windows, and the two overlap, so no run is cut; most texts have none.

Defined results: a null or empty text has no runs and collapses to an empty text; a null id is kept; repeated rows get
equal results; white space between words doesn't matter and becomes one space; runs are ordered by start, then period; a
very long text is held by one task, in memory linear in its repeating words (about 1 KB each); an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and periods, that a run has at least.
LEAST = 24
TIMES = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """Ukkonen's tree of symbols whose last occurs once: where the label of each node's edge begins and ends (-1: a leaf's, at
    the end of the text), children by node * width + first symbol, and width. Node 0 is the root; leaves are made in the order of their suffixes."""
    width, n = max(s) + 1, len(s)
    begin, end, link, child = [0], [0], [0], {}
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        before = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(begin)
                begin.append(i)
                end.append(-1)
                link.append(0)
                if before:
                    link[before] = node
                before = 0
            else:
                at = begin[below]
                size = (i + 1 if end[below] < 0 else end[below]) - at
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[at + length] == c:
                    length += 1
                    if before:
                        link[before] = node
                    break
                split = len(begin)
                begin += (at, i)
                end += (at + length, -1)
                link += (0, 0)
                child[key] = split
                begin[below] = at + length
                child[split * width + s[at + length]] = below
                child[split * width + c] = split + 1
                if before:
                    link[before] = split
                before = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return begin, end, child, width


class Extensions:
    """Longest common extensions of suffixes of words by their suffix tree; the words are numbers from 1."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        self.begin, self.end, self.child, self.width = suffix_tree([*words.tolist(), 0])
        keys = np.sort(np.fromiter(self.child, np.int64, len(self.child)))
        self.below = [self.child[k] for k in keys.tolist()]
        self.first = np.searchsorted(keys // self.width, np.arange(len(self.begin) + 1)).tolist()
        suffixes = count()
        self.suffix = [next(suffixes) if e < 0 else -1 for e in self.end]
        del self.child
        leaves, depths = self._tour(False)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[leaves] = np.arange(self.n + 1)
        self.least = [np.array(depths[1:], np.int32)]  # between a leaf and the next
        while 1 << len(self.least) <= self.n:
            x, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(x[:-step], x[step:]))

    def _tour(self, turned: bool) -> tuple[list[int], list[int]]:
        """Suffixes in the order of an Euler tour, and the depth of the shallowest node since the leaf before. Turned: symbols in
        falling order, but the end of the text still first."""
        leaves, depths, depth, shallow = [], [], [0] * len(self.begin), 0
        stack = [(0, 0)]
        while stack:
            node, up = stack.pop()
            if up >= 0:
                shallow = up
            if self.suffix[node] >= 0:
                leaves.append(self.suffix[node])
                depths.append(shallow)
                continue
            here, i, j = depth[node], self.first[node], self.first[node + 1]
            below = self.below[i:j]
            if turned:
                # the end of the text is the lowest symbol: a leaf whose edge holds nothing else
                ended = self.begin[below[0]] == self.n
                below = below[:1] + below[:0:-1] if ended else below[::-1]
            for x in below:
                if self.end[x] >= 0:
                    depth[x] = here + self.end[x] - self.begin[x]
            stack += [(x, here) for x in below[:0:-1]]
            stack.append((below[0], -1))
        return leaves, depths

    def turned_rank(self) -> np.ndarray:
        """Ranks of the suffixes when the order of words is reversed."""
        rank = np.empty(self.n + 1, np.int64)
        rank[self._tour(True)[0]] = np.arange(self.n + 1)
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes from i and j, which differ, have in common: one table look-up of two overlapping spans each."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each position ends: at the next suffix of lower rank; the last, empty, suffix has the lowest."""
    out, open_, ranks = [0] * (len(rank) - 1), [], rank.tolist()
    for k, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = k
        open_.append(k)
    return np.array(out, np.int64)


def runs_of(words: np.ndarray) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of numbers."""
    n = len(words)
    words = np.unique(words, return_inverse=True)[1] + 1
    right, left = Extensions(words), Extensions(words[::-1])
    found = set()
    for rank in (right.rank, right.turned_rank()):
        ends = lyndon_ends(rank)
        i = np.arange(n)[TIMES * (ends - np.arange(n)) <= n]
        j = ends[i]
        high = j + right.common(i, j)
        low = i.copy()
        inner = i > 0
        low[inner] -= left.common(n - i[inner], n - j[inner])
        keep = high - low >= np.maximum(LEAST, TIMES * (j - i))
        found.update(zip(low[keep].tolist(), (high - low)[keep].tolist(), (j - i)[keep].tolist(), strict=True))
    return found


def recurring(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that can hold runs: overlapping windows of the size that every run repeats, that occur twice in the given words (or whose hashes, rarely, collide)."""
    size = -(-LEAST * (TIMES - 1) // TIMES)
    if len(words) < LEAST:
        return []
    with np.errstate(over="ignore"):
        hashes = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        hashes ^= hashes >> np.uint64(29)
        step = 1
        while step < size:
            more = min(step, size - step)
            hashes = hashes[:-more] * (_MIX + np.uint64(2 * step)) + hashes[more:]
            step += more
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(hashes, twice))
    cuts = np.flatnonzero(np.diff(at) >= size) + 1
    spans = [(int(x[0]), int(x[-1]) + size) for x in np.split(at, cuts)]
    return [(i, j) for i, j in spans if j - i >= LEAST]


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found, spans = set(), recurring(words)
    while spans:
        i, j = spans.pop()
        inner = recurring(words[i:j])
        if inner == [(0, j - i)]:
            found.update((i + start, length, period) for start, length, period in runs_of(words[i:j]))
        else:
            spans += [(i + x, i + y) for x, y in inner]
    return sorted(found, key=lambda r: (r[0], r[2]))


_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        sizes, runs, texts = [], [], []
        for text in batch["text"]:
            words = (text.as_py() or b"").split()  # bytes split at the six white-space characters of ASCII only
            seen: dict[bytes, int] = {}
            found = find_runs(np.array(list(map(seen.setdefault, words, range(len(words)))), np.int64)) if len(words) >= LEAST else []
            if found:
                keep = np.ones(len(words), bool)
                for start, length, period in found:
                    keep[start + period : start + length] = False
                words_left = [words[k] for k in np.flatnonzero(keep).tolist()]
            else:
                words_left = words
            sizes.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(b" ".join(words_left))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(runs, run), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed: the words outside runs and in their first period."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scan, _SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))
