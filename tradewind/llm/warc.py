"""WARC archives with a two-level capture index.

Archives are gzip members, one a record. The index holds a line for each capture under its key: the reversed host, the
path and the capture's number. Lines are sorted into compressed blocks; each index file ends in a sparse directory of
its blocks, and the first and last keys of the index files are the upper level. A lookup searches the upper level, then
a directory, then a block, and only then reads the record's byte range.

Defined results: a null html is an empty payload, a null url has the empty key; a null page_id sorts first and never
is the response of others that have one; captures equal in page_id and payload are responses alike; repeated rows
are captures of their own; an empty table makes an empty index; columns other than page_id, url and html don't matter.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import constant, last_at_or_below, stored
from tradewind.llm.files import Reader, create

LEAST_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 512
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"CAPIDX01"
_FOOT = "<QQ8s"
CAPTURE = "key string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def surt(url: Column) -> Column:
    """Reversed host, ')', then path and query: net,example,www)/path. Scheme, user, port and fragment don't matter;
    control characters, which part the lines of the index and their fields, are percent-encoded."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), "[#\n\r].*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, " ", "%20"))
    encoded = key
    for c in (*range(32), 127):
        encoded = F.replace(encoded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.coalesce(F.when(key.rlike(r"[\x00-\x1F\x7F]"), encoded).otherwise(key), F.lit(""))


def capture_key(url: Column, page_id: Column) -> Column:
    """The sort key of a capture: surt, a blank, and page_id in 20 digits from the least long on ('-' for null)."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.concat(surt(url), F.lit(" "), F.coalesce(number, F.lit("-")))


#: First halves of record ids (of UUID version 8): of captures with a page_id, which is the second half, and without.
_KNOWN, _NONE = "8000000000008000", "8000000100008000"


def _urn(page_id: int | None) -> str:
    h = (_NONE if page_id is None else _KNOWN) + f"{(page_id or 0) % (1 << 64):016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _page_of(urn: str) -> int | None:
    h = urn.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    value = int(h[16:], 16)
    return None if h[:16] == _NONE else value - (value >> 63 << 64)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP header block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    body = http if revisit else http + payload
    head += [f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of RECORD from one gzip member; size and digest of a response are those of its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = [x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]]
    fields = {k: (v[0] if v else "") for k, *v in lines}
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != said or len(payload) != length):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": length, "payload_digest": said, "refers_to": refers, "payload": payload}


def _archive(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = None
        at = 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    (name, out), at = create(folder, "capture.warc.gz"), 0
                data = record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["refers_to"], r["revisit"])
                out.write(data)
                found.append((r["key"], name, at, len(data)))
                at += len(data)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes all pages as WARC records below folder; returns the captures (key, file, offset, length)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    large = rows.where(F.col("size") >= LEAST_BYTES)
    first = stored(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"), "responses")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")) & (F.col("size") >= LEAST_BYTES)
    rows = rows.withColumn("revisit", revisit).select("page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", "digest", "refers_to", "revisit", capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return stored(rows.mapInArrow(_archive(folder), CAPTURE), "captures")


def _index(folder: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = None
        directory, lines, at, n, last = [], [], 0, 0, ""

        def block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(k + "\t" + json.dumps(v, separators=(",", ":")) for k, v in lines).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, out = create(folder, "captures.idx")
                lines.append((r["key"], [r["file"], r["offset"], r["length"]]))
                n, last = n + 1, r["key"]
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data + struct.pack(_FOOT, at, len(data), MAGIC))
        out.close()
        yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "last": last, "file": name, "captures": n, "blocks": len(directory)}])

    return write


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures into index files below folder; returns the upper level, one row a file (first, last, file, captures, blocks)."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stored(ordered.mapInArrow(_index(folder), "first string, last string, file string, captures bigint, blocks bigint"), "upper")


class IndexFile:
    """One index file: its directory, and the block read last."""

    def __init__(self, reader: Reader, name: str) -> None:
        self.reader, self.name, self.at, self.lines = reader, name, -1, []
        size = reader.size(name)
        start, length, magic = struct.unpack(_FOOT, reader.read(name, size - struct.calcsize(_FOOT), struct.calcsize(_FOOT)))
        if magic != MAGIC:
            raise ValueError(f"{name} is no index file")
        self.directory = json.loads(zlib.decompress(reader.read(name, start, length)))
        self.firsts = [x[0].encode("utf-8", "surrogatepass") for x in self.directory]

    def _block(self, k: int) -> list[tuple[bytes, list]]:
        if self.at != k:
            text = zlib.decompress(self.reader.read(self.name, *self.directory[k][1:]))
            self.at, self.lines = k, [(x[0], x[1]) for x in (line.split(b"\t") for line in text.split(b"\n"))]
        return self.lines

    def find(self, key: bytes) -> Iterator[list]:
        """(file, offset, length) of each capture of the key."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.directory) and self.firsts[k] <= key:
            lines = self._block(k)
            for i in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                if lines[i][0] != key:
                    return
                yield json.loads(lines[i][1])
            k += 1


def _lookup(folder: str):
    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, index = Reader(folder), None
        for batch in batches:
            found = []
            for key, name in zip(batch["key"].to_pylist(), batch["file"].to_pylist(), strict=True):
                if index is None or index.name != name:
                    index = IndexFile(reader, name)
                found += [(key, *x) for x in index.find(key.encode("utf-8", "surrogatepass"))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "offset", "length"])

    return look


def lookup(spark: SparkSession, upper: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """The captures of the keys (column key, each once). The upper level has a row for each index file, so the number of
    index files bounds what reaches the driver and the plan."""
    files = sorted((r["first"].encode("utf-8", "surrogatepass"), r["last"], r["first"], r["file"]) for r in upper.collect())
    if not files:
        return spark.createDataFrame([], CAPTURE)
    to = last_at_or_below([x[2] for x in files], "string", F.col("key")) - 1
    below = last_at_or_below([x[1] for x in files], "string", F.col("key"), strictly=True)
    asked = keys.select("key", F.explode(F.when(below <= to, F.sequence(below, to))).alias("n")).select("key", "n", F.get(constant([x[3] for x in files], "string"), F.col("n")).alias("file"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartitionByRange(parts, "n", "key").sortWithinPartitions("n", "key").select("key", "file").mapInArrow(_lookup(folder), CAPTURE)


def _records(folder: str, payloads: bool):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            rows, held = [], 0
            for name, offset, length in sorted(zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True)):
                x = parse(reader.read(name, offset, length))
                if not payloads:
                    x["payload"] = None
                rows.append(x)
                held += len(x["payload"] or b"") + 200
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the captures' byte ranges; payload is left null on request."""
    return captures.mapInArrow(_records(folder, payloads), RECORD)
