"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut into groups at the offsets where both end.

Inside a task the ends of a chunk of documents are two sorted lists, and diagonal binary searches cut their merge into
pieces of PIECE ends (merge path). A piece needs nothing of another: it emits the overlaps of its own ends, and a common
end that falls on a border is emitted by the piece on its left only. Every end of either list closes exactly one overlap,
so links are ends, and groups are runs between common ends, numbered through over all pieces.

Counts of id pairs over the corpus are sums over chunks of their distinct pairs; they go back to the chunks by a join on
the pair and a cogroup by chunk, whose size CHUNK_BYTES bounds, so that no list of all pairs is held anywhere.

Ids are those of whole texts. The libraries take about 320 and 470 CPU seconds for a GB of text, so a worker encodes
each word once where the tokenizer files show that no token crosses the start of a word; otherwise whole texts go to them.

Defined results: texts that are null, empty, or not given back by the joined tokens of either side have no tokens and
zeros; a null id is kept; repeated rows get equal results and count as often as they occur; of pairs of equal counts all
are best; a very long text is a chunk of its own, in memory linear in its length; an empty table gives no rows; other
columns don't matter.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import stored

#: Bytes of text, about, whose documents are aligned at once; pairs are counted in a chunk first.
CHUNK_BYTES = 4 << 20
#: Merged ends of a piece of the merge path.
PIECE = 1 << 16
#: Words, and characters of words, above which a worker starts anew; words that go to a tokenizer in one call.
CACHED = 500_000
CACHED_BYTES = 1 << 24
TOGETHER = 256
META = "▁"
#: Splits a text before the merges of a byte-level file that names no pattern of its own.
_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The last white space before a word starts a token on either side, unless it is one of several spaces.
_CUT = re.compile(r"(?<! )(?= \S)|(?=\n\S)")
_UNEVEN = re.compile(r"^\s|[ \n](?:\s|$)")


class ByteLevel:
    """Side A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        from tradewind.llm.sstable import _byte_letters

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        byte = {c: b for b, c in _byte_letters().items()}
        special = {x["content"] for x in parts["added_tokens"]}
        vocab, model, pre = parts["model"]["vocab"], parts["model"], parts["pre_tokenizer"]
        self.bytes = [b""] * (1 + max(vocab.values()))
        for token, k in vocab.items():
            if token not in special:
                self.bytes[k] = bytes(map(byte.__getitem__, token))
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ordered = all(vocab[m] == 256 + k for k, m in enumerate(pairs)) and len(vocab) - len(special & set(vocab)) == 256 + len(pairs)
        #: A token never holds the space before a word and anything before that space.
        self.by_word = ordered and parts["normalizer"] is None and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if self.by_word:
            ranks = {x: k for k, x in enumerate(self.bytes) if x}
            self.fast = tiktoken.Encoding("own", pat_str=_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a space and the text."""
        return self.fast.encode_ordinary(" " + text) if self.by_word else self.whole.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Side B: a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [b"" if self.model.is_control(k) or self.model.is_unknown(k) else bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace(META, " ").encode() for k, x in enumerate(names)]
        self.by_word = not any(re.search(f"[^{META}]{META}|\n", x) for x in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Tokens:
    """Ids of the words of one side, one after the other in the order in which they were learned; a word that its tokens don't give back has the id `bad`."""

    def __init__(self, side: ByteLevel | Pieces) -> None:
        self.side = side
        self.kind = np.dtype("<u2" if len(side.bytes) < 0xFFFF else "<u4")
        self.bad = int(np.iinfo(self.kind).max)
        self.sizes = np.array([*map(len, side.bytes)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.flat, self.starts = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _encode(self, text: str) -> list[int] | None:
        """Ids of a text that starts with its white space, if they give it back: the side puts a space before, which goes again."""
        ids = self.side.encode(text[1:] if text[:1] == " " else text)
        if text[:1] != " ":
            if not ids or self.side.bytes[ids[0]] != b" ":
                return None
            ids = ids[1:]
        return ids if b"".join(map(self.side.bytes.__getitem__, ids)) == text.encode() else None

    def _together(self, texts: list[str], at: list[int], found: list[bytes | None]) -> None:
        """Texts that can stand side by side go in one call, and their bytes cut its tokens apart."""
        ids = self._encode("".join(texts)) if texts and self.side.by_word else None
        if ids:
            width, raw = self.kind.itemsize, np.array(ids, self.kind).tobytes()
            ends = np.cumsum([*map(len, map(str.encode, texts))])
            cuts = [0, *(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()]
            for k, i, j in zip(at, cuts, cuts[1:], strict=False):
                found[k] = raw[width * i : width * j]

    def learn(self, texts: list[str]) -> None:
        found: list[bytes | None] = [None] * len(texts)
        plain = [k for k, w in enumerate(texts) if META not in w and not w[-1].isspace() and not w[1].isspace()]
        for start in (" ", "\n"):
            alike = [k for k in plain if texts[k][0] == start]
            for n in range(0, len(alike), TOGETHER):
                block = alike[n : n + TOGETHER]
                self._together([texts[k] for k in block], block, found)
        for k, x in enumerate(found):
            if x is None:
                ids = self._encode(texts[k])
                found[k] = np.array([self.bad] if ids is None else ids, self.kind).tobytes()
        ends = self.starts[-1] + np.cumsum([len(x) // self.kind.itemsize for x in found], dtype=np.int64)
        self.flat, self.starts = np.concatenate([self.flat, np.frombuffer(b"".join(found), self.kind)]), np.concatenate([self.starts, ends])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and where each word's ids end."""
        n = self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[numbers] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64), ends


class Words(dict):
    """Numbers of the words that a worker knows on both sides: a word that follows a space, or what starts with other white space, with it."""

    def __init__(self, a: str, b: str) -> None:
        self.sides = (Tokens(ByteLevel(a)), Tokens(Pieces(b)))
        self.by_word = all(s.side.by_word for s in self.sides)
        self.new, self.held = [], 0

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """On each side the ids of all texts and the numbers of each text's; none for a text that either side doesn't give back."""
        if len(self) > CACHED or self.held > CACHED_BYTES:
            self.clear()
            self.held = 0
            for s in self.sides:
                s.forget()
        split = [(split_words(t) if self.by_word else [" " + t]) if t else [] for t in texts]
        numbers = np.array(list(map(self.__getitem__, chain.from_iterable(split))), np.int64)
        words = [w if w[0].isspace() else " " + w for w in self.new]
        self.new, self.held = [], self.held + sum(map(len, words))
        for s in self.sides:
            s.learn(words)
        last = np.cumsum([*map(len, split)], dtype=np.int64)
        found = [(ids, np.diff(np.concatenate([[0], ends])[last], prepend=0)) for ids, ends in (s.of(numbers) for s in self.sides)]
        doc = [np.repeat(np.arange(len(texts)), n) for _, n in found]
        good = np.ones(len(texts), bool)
        for s, d, (ids, _) in zip(self.sides, doc, found, strict=True):
            good[d[ids == s.bad]] = False
        return [(ids[good[d]], np.where(good, n, 0)) for d, (ids, n) in zip(doc, found, strict=True)]


@functools.lru_cache(maxsize=2)
def _words(a: str, b: str) -> Words:
    """One for each Python worker, which serves many tasks."""
    return Words(a, b)


def split_words(text: str) -> list[str]:
    """Parts of a space and the text that begin where tokens of either side begin, as Words has them."""
    if not _UNEVEN.search(text):
        return text.replace("\n", " \n").split(" ")
    parts = [w for w in _CUT.split(" " + text) if w]
    if parts[0] == " ":
        parts[:2] = ["".join(parts[:2])]
    return [w[1:] if w[0] == " " and w[1:] and not w[1].isspace() else w for w in parts]


def cross(a: np.ndarray, b: np.ndarray, d: int) -> int:
    """Where diagonal d crosses the merge path of two sorted lists: how many of its first d values are of a; a goes first of equal ones."""
    low, high = max(0, d - len(b)), min(d, len(a))
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if a[mid] <= b[d - mid - 1] else (low, mid)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, ...]:
    """Links (indexes in a, in b) of one piece of the merge path, and the indexes of those a and b that end together."""
    x, y = a[i0:i1], b[j0:j1]
    at_b = j0 + np.searchsorted(y, x)
    met = b[at_b] == x
    at_a = i0 + np.searchsorted(x, y)
    own = np.ones(len(y), bool)
    inside = at_a < i1
    own[inside] = a[at_a[inside]] != y[inside]
    if i0 and j1 > j0 and a[i0 - 1] == y[0]:
        own[0] = False  # the piece on the left has it
    return np.concatenate([np.arange(i0, i1), at_a[own]]), np.concatenate([at_b, np.arange(j0, j1)[own]]), i0 + np.flatnonzero(met), at_b[met]


def merge_path(a: np.ndarray, b: np.ndarray, work: int = 0) -> tuple[np.ndarray, ...]:
    """Links and common ends, as in overlaps, of two lists of ends of which the last are equal, by pieces of equal work."""
    total = len(a) + len(b)
    marks = [*range(0, total, work or PIECE), total]
    rows = [cross(a, b, d) for d in marks]
    found = [overlaps(a, b, i0, i1, d0 - i0, d1 - i1) for (i0, d0), (i1, d1) in zip(zip(rows, marks, strict=True), zip(rows[1:], marks[1:], strict=True), strict=False)]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def _align(texts: list[str], words: Words, marks: list[str]) -> dict[str, list | np.ndarray]:
    """Of each text its numbers of tokens, groups and links, its groups as text, and its distinct pairs; and the pairs of all."""
    (ids_a, n_a), (ids_b, n_b) = words.encode(texts)
    sizes = [s.sizes for s in words.sides]
    at_a, at_b, last_a, last_b = merge_path(np.cumsum(sizes[0][ids_a]), np.cumsum(sizes[1][ids_b]))

    size_a, size_b = map(len, sizes)
    doc = np.repeat(np.arange(len(texts)), n_a)
    code = ids_a[at_a] * size_b + ids_b[at_b]
    # one sort by document and pair: the distinct pairs of each document, with their numbers
    keys = np.sort(doc[at_a] * (size_a * size_b) + code)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times, keys = np.diff(first, append=len(keys)), keys[first]
    codes, at = np.unique(keys % (size_a * size_b), return_inverse=True)
    of = keys // (size_a * size_b) if len(keys) else keys
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))

    ended_a, ended_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    ended_a[last_a], ended_b[last_b] = True, True
    group_a, group_b = np.cumsum(ended_a) - ended_a, np.cumsum(ended_b) - ended_b
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    before_b, up_to_a = np.concatenate([[0], last_b + 1]), last_a + 1
    text[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + size_a * ended_a
    text[np.arange(len(ids_b)) + up_to_a[group_b]] = 2 * size_a + ids_b + size_b * ended_b
    spans = np.concatenate([[0], np.cumsum(n_a + n_b)])
    said = ["".join(map(marks.__getitem__, text[i:j].tolist()))[:-1] for i, j in zip(spans, spans[1:], strict=False)]
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc[last_a], minlength=len(texts)), "n_links": np.bincount(doc[at_a], minlength=len(texts)),
        "groups": said, "at": at.astype(np.int32), "times": times.astype(np.int32), "cuts": cuts, "codes": codes, "counts": np.bincount(at, times, minlength=len(codes)).astype(np.int64),
    }


_SCHEMA = "doc_id bigint, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at array<int>, times array<int>, codes array<bigint>, counts array<bigint>"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Documents by about CHUNK_BYTES, whatever the batches are."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= CHUNK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _aligner(a: str, b: str):
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a, b)
        size_a, size_b = (len(s.sizes) for s in words.sides)
        marks = [f"{k}{end}" for size, ends in ((size_a, ",|"), (size_b, ",;")) for end in ends for k in range(size)]
        part = TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(_chunks(batches)):
            x = _align(texts, words, marks)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(x["cuts"], pa.int32()), pa.array(values, pa.int32()))  # noqa: E731, B023
            rows = [pa.array(ids, pa.int64()), pa.array([part + n] * len(ids), pa.int64()), *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups"], pa.string()), lists(x["at"]), lists(x["times"]), *([pa.nulls(len(ids), pa.list_(pa.int64()))] * 2)]
            names = ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "at", "times", "codes", "counts"]
            docs = pa.RecordBatch.from_arrays(rows, names)
            yield docs
            of_chunk = {"chunk": [part + n], "codes": [x["codes"]], "counts": [x["counts"]]}
            yield pa.RecordBatch.from_arrays([pa.array(of_chunk.get(f.name, [None]), f.type) for f in docs.schema], names)

    return align


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of a chunk's documents; pairs has the count of each of its distinct pairs, and whether it is best."""
    size = pairs.num_rows
    count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    pos = pairs["pos"].to_numpy()
    count[pos], best[pos] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    lists = docs["at"].combine_chunks()
    at, times = lists.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    sums = [np.diff(np.concatenate([[0], np.cumsum(v[at] * times)])[ends]) for v in (best, count)]
    out = docs.drop_columns(["chunk", "at", "times"])
    return out.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, count, best: how many links of the corpus hold each pair of ids, and whether no other pair of its B id has more."""
    counts = aligned.where("codes is not null").select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    counts = stored(counts.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("count")), "pairs")
    b = (F.col("code") % size_b).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a: str, b: str, show: Callable[[], Column] = lambda: F.col("groups")) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum of each document, and its groups, as `a1,a2|b1;a3|b2,b3`, or what show makes of them."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_aligner(a, b), _SCHEMA)
    aligned = stored(rows.withColumn("groups", show()), "aligned")
    scored = stored(pair_counts(aligned, len(Pieces(b).bytes)), "counts")
    pairs = aligned.where("codes is not null").select(F.col("chunk").alias("of"), F.posexplode("codes").alias("pos", "code")).join(scored, "code").select("of", "pos", "count", "best")
    of_docs = aligned.where("codes is null").drop("codes", "counts")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint"
    return of_docs.groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(_score, schema)
