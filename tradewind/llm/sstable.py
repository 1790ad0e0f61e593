"""Token ids in sorted-string-table shards: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

A key is the document's id in 8 bytes that sort as the ids do (nothing for null, which sorts first). A block holds
entries (shared prefix, rest of the key, token ids), restarts with a whole key every RESTART entries, and is compressed
with a checksum. Documents lie in ascending order of id over the shards, so a shard's first token number is the sum of
the shards before it. Shards are cut by the bytes of their texts: as many as there are shuffle partitions, and more where
they would be above SHARD_BYTES; only an id whose documents fill a shard goes on in the next one.

Ids are those of Tokenizer.encode for the whole text. The library's own batch call takes about 850 CPU seconds a GB, so
words are encoded once a worker where the parts of the tokenizer file show that ids of a text are those of its words.

Defined results: a null text has only the end id; repeated ids are entries of their own, in order of their token ids (if
they go on over shards, in order of a hash of the text first); a null id comes first; an empty table makes no shard; a very long text is one entry and block; columns other than doc_id
and text don't matter.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import constant, last_at_or_below, stored, with_running_sum
from tradewind.llm.files import Reader, create

BLOCK_BYTES = 1 << 16
SHARD_BYTES = 1 << 28
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"TOKSST01"
CACHED = 300_000
_FOOT = "<QQQQQI8s"  # index at, length; Bloom at, length; documents; width of an id; magic
SHARD = "shard int, file string, low bigint, high bigint, n_docs bigint, n_tokens bigint, bytes bigint"


#: Parts of a tokenizer file under which the ids of a text are those of its words, and those of a word of letters and a
#: tail of ASCII signs are those of the letters (one pre-token, lower case, as bytes) and of the tail.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_TAIL = ".,;:!?%&*#$|"
#: Characters that case folding of a whole word treats otherwise than character by character.
_ODD = frozenset("\u03a3\u0130")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    out = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    spare = iter(range(256, 512))
    return {b: out.get(b) or chr(next(spare)) for b in range(256)}


class Words(dict):
    """Token ids, as bytes, of the words seen so far; a new word is encoded when it is asked for."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        normal, pre = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        split, level = [*pre.get("pretokenizers", []), {}, {}][:2]
        self.by_word = normal.get("normalizers") == _NORMAL and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and level.get("type") == "ByteLevel" and not level.get("add_prefix_space")
        self.model, self.letters = self.whole.model, _byte_letters()

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self._ids(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self) > CACHED:
            self.clear()
        for c in "\n\t\r\v\f":
            text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        low = _letters(core)
        if core and len(core) < len(word):
            ids = self[core] + self[word[len(core) :]] if low else self._ids(self.whole.encode(word, add_special_tokens=False).ids)
        elif low and _ODD.isdisjoint(core):
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.letters)
            ids = self._ids([x.id for x in self.model.tokenize(low)])
        else:
            ids = self._ids(self.whole.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids


def _letters(word: str) -> str:
    """The word as the tokenizer normalises it; nothing unless it is letters before and after, as some decompose to a letter and a mark."""
    if not word.isalpha():
        return ""
    low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
    return low if low.isalpha() else ""


@functools.lru_cache(maxsize=2)
def _words(path: str) -> Words:
    """One for each Python worker, which serves many tasks."""
    return Words(path)


def _encoder(tokenizer: str, end: int | None):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        tail = b"" if end is None else np.array([end], words.kind).tobytes()
        for batch in batches:
            ids = [words.text(x.as_py() or "") + tail for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(ids, pa.binary()), pa.array([words.kind.itemsize] * len(ids), pa.int32())], ["doc_id", "th", "ids", "width"])

    return encode


def encode_documents(docs: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """doc_id, th (hash of the text), ids (little-endian, width bytes each) of whole texts, with the end id appended."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(_encoder(tokenizer, end), "doc_id bigint, th bigint, ids binary, width int")


def _key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def _id(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _hashes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % (1 << 64) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard; keys come in ascending order."""

    def __init__(self, folder: str, shard: int) -> None:
        self.shard, (self.name, self.out) = shard, create(folder, f"tokens-{shard:06d}.sst")
        self.entries, self.held, self.index, self.keys = [], 0, [], []
        self.at = self.tokens = self.docs = 0
        self.width, self.low, self.high, self.pack = 4, None, None, zstandard.ZstdCompressor(3)

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        key = _key(doc_id)
        self.low = doc_id if not self.docs else self.low
        self.high, self.width = doc_id, width
        self.entries.append((key, ids))
        self.keys.append(key)
        self.docs, self.tokens, self.held = self.docs + 1, self.tokens + len(ids) // width, self.held + len(ids)
        if self.held >= BLOCK_BYTES:
            self._block()

    def _block(self) -> None:
        parts, restarts, size, before = [], [], 0, b""
        for n, (key, ids) in enumerate(self.entries):
            shared = 0
            if n % RESTART:
                while shared < min(len(key), len(before)) and key[shared] == before[shared]:
                    shared += 1
            else:
                restarts.append(size)
            entry = struct.pack("<BBI", shared, len(key) - shared, len(ids)) + key[shared:] + ids
            parts.append(entry)
            size, before = size + len(entry), key
        raw = b"".join(parts) + struct.pack(f"<{len(restarts)}II", *restarts, len(restarts))
        data = self.pack.compress(raw)
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        first = self.entries[0][0]
        self.index.append(struct.pack("<B", len(first)) + first + struct.pack("<QI", self.at, len(data)))
        self.at, self.entries, self.held = self.at + len(data), [], 0

    def close(self) -> dict:
        if self.entries:
            self._block()
        bits = max(64, -(-BLOOM_BITS * self.docs // 8) * 8)
        bloom = np.zeros(bits, dtype=bool)
        for key in set(self.keys):
            bloom[_hashes(key, bits)] = True
        index, filled = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index + filled + struct.pack(_FOOT, self.at, len(index), self.at + len(index), len(filled), self.docs, self.width, MAGIC))
        self.out.close()
        size = self.at + len(index) + len(filled) + struct.calcsize(_FOOT)
        return {"shard": self.shard, "file": self.name, "low": self.low, "high": self.high, "n_docs": self.docs, "n_tokens": self.tokens, "bytes": size}


class ShardReader:
    """One shard: all entries in order, or those of one id by Bloom filter and binary searches."""

    def __init__(self, reader: Reader, name: str) -> None:
        self.reader, self.name = reader, name
        size = reader.size(name)
        at, length, bloom_at, bloom_length, self.docs, self.width, magic = struct.unpack(_FOOT, reader.read(name, size - struct.calcsize(_FOOT), struct.calcsize(_FOOT)))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token shard")
        raw, k, self.index = reader.read(name, at, length), 0, []
        while k < len(raw):
            n = raw[k]
            self.index.append((raw[k + 1 : k + 1 + n], *struct.unpack_from("<QI", raw, k + 1 + n)))
            k += 13 + n
        self.bloom = np.unpackbits(np.frombuffer(reader.read(name, bloom_at, bloom_length), np.uint8))
        self.firsts = [x[0] for x in self.index]

    def _raw(self, k: int) -> tuple[bytes, list[int], int]:
        data = self.reader.read(self.name, *self.index[k][1:])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"{self.name}: damaged block {k}")
        raw = zstandard.ZstdDecompressor().decompress(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, rest, size = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + rest]
            at += 6 + rest + size
            yield key, raw[at - size : at]

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            raw, _, end = self._raw(k)
            for key, ids in self._entries(raw, 0, end):
                yield _id(key), np.frombuffer(ids, f"<u{self.width}")

    def get(self, doc_id: int | None) -> Iterator[np.ndarray]:
        key = _key(doc_id)
        if not self.bloom[_hashes(key, len(self.bloom))].all():
            return
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.index) and self.firsts[k] <= key:
            raw, restarts, end = self._raw(k)
            whole = lambda at: raw[at + 6 : at + 6 + raw[at + 1]]  # noqa: E731,B023
            start = restarts[max(0, bisect.bisect_left(restarts, key, key=whole) - 1)]
            for found, ids in self._entries(raw, start, end):
                if found == key:
                    yield np.frombuffer(ids, f"<u{self.width}")
                elif found > key:
                    return
            k += 1


def _shards(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for shard, doc_id, ids, width in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "ids", "width")), strict=True):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        done.append(writer.close())
                    writer = ShardWriter(folder, shard)
                writer.add(doc_id, ids, width)
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("file", pa.string()), *((c, pa.int64()) for c in ("low", "high", "n_docs", "n_tokens", "bytes"))]))

    return write


_KNOWN, _ID = "doc_id is not null", "coalesce(doc_id, 0)"


def shard_bounds(docs: DataFrame) -> list[dict]:
    """The first (known: the id is not null, id, hash of the text) of each shard but the first, by equal sums of bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    rows = docs.select(F.expr(_KNOWN).cast("int").alias("k"), F.expr(_ID).cast("bigint").alias("i"), F.xxhash64("text").alias("t"), size.alias("size"))
    rows = with_running_sum(rows, [F.col("k"), F.col("i"), F.col("t")], "size", "at")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    firsts = rows.groupBy(F.floor(F.col("at") * F.lit(n).cast("decimal(20,0)") / max(1, total)).alias("shard")).agg(F.min(F.struct("k", "i", "t")).alias("x"))
    bounds = sorted({(r["x"]["k"], r["x"]["i"], r["x"]["t"]) for r in firsts.collect()})[1:]  # one a shard
    # the rows of an id stay together, unless they fill a shard of their own
    whole = [n == 0 or bounds[n - 1][:2] != bounds[n][:2] for n in range(len(bounds))]
    return [{"k": k, "i": i, "t": -(1 << 63) if own else t} for own, (k, i, t) in zip(whole, bounds, strict=True)]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Encodes docs into shards below folder, in ascending order of doc_id; returns the manifest, one row a shard."""
    bounds = shard_bounds(docs)
    at = F.struct(F.expr(_KNOWN).cast("int").alias("k"), F.expr(_ID).alias("i"), F.col("th").alias("t"))
    encoded = encode_documents(docs, tokenizer, end).withColumn("shard", last_at_or_below(bounds, "struct<k:int,i:bigint,t:bigint>", at))
    ordered = encoded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    return stored(ordered.select("shard", "doc_id", "ids", "width").mapInArrow(_shards(folder), SHARD), "manifest")


def _scan(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for name, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                rows = []
                for doc_id, ids in ShardReader(reader, name).scan():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def placed(manifest: DataFrame) -> list[tuple[int, str, int]]:
    """(shard, file, number of the first token) of each shard; the number of shards bounds the list."""
    out, start = [], 0
    for r in manifest.orderBy("shard").collect():
        out.append((r["shard"], r["file"], start))
        start += r["n_tokens"]
    return out


def scan_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the shards."""
    files = placed(manifest)
    rows = spark.createDataFrame(files, "shard int, file string, start bigint")
    return rows.repartitionById(max(1, len(files)), "shard").mapInArrow(_scan(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _get(folder: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard = Reader(folder), None
        for batch in batches:
            rows = []
            for doc_id, name in zip(batch["doc_id"].to_pylist(), batch["file"].to_pylist(), strict=True):
                if shard is None or shard.name != name:
                    shard = ShardReader(reader, name)
                rows += [{"doc_id": doc_id, "ids": x.astype(np.int64).tolist()} for x in shard.get(doc_id)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return read


def get_documents(spark: SparkSession, manifest: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """doc_id and ids of the asked documents (column doc_id), each found by binary searches: for its shards, and in them.
    The manifest has a row for each shard, so the number of shards bounds what reaches the driver and the plan."""
    key = lambda x: {"k": int(x is not None), "i": x or 0}
    shards = sorted(((key(r["low"]), key(r["high"]), r["file"]) for r in manifest.collect()), key=lambda x: (*x[0].values(), *x[1].values()))
    kind = "struct<k:int,i:bigint>"
    at = F.struct(F.expr(_KNOWN).cast("int").alias("k"), F.expr(_ID).cast("bigint").alias("i"))
    # shards follow each other, so a key lies in one shard, or in those over which a repeated id goes on
    to = last_at_or_below([x[0] for x in shards], kind, at) - 1
    below = last_at_or_below([x[1] for x in shards], kind, at, strictly=True)
    asked = ids.select("doc_id").distinct().select("doc_id", F.explode(F.when(below <= to, F.sequence(below, to))).alias("n"))
    files = constant([x[2] for x in shards], "string")
    found = asked.select("doc_id", "n", F.get(files, F.col("n")).alias("file"))
    return found.repartition("file").sortWithinPartitions("file", "doc_id").select("doc_id", "file").mapInArrow(_get(folder), "doc_id bigint, ids array<bigint>")
