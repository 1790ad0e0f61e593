import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradewind.llm import sstable, warc
from tradewind.llm.common import new_folder
from tradewind.llm.files import Reader

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PAGES = "page_id bigint, url string, html string, key string"


def _round_trip(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    folder = new_folder(spark, "test-warc")
    captures = warc.write_archives(pages, f"{folder}/a")
    upper = warc.build_index(captures, f"{folder}/i")
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key")).distinct()
    found = warc.lookup(spark, upper, f"{folder}/i", keys)
    return warc.read_records(found, f"{folder}/a").collect(), upper, folder


def test_warc_round_trip_with_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(k, f"http://www.h{k % 3}.example.com/p/{k}?q=1#f", f"page {k}", "clash") for k in range(40)]
    rows += [(50, "https://a.b/", big, ""), (51, "https://a.b/", big, ""), (52, None, big, ""), (52, None, big, ""), (60, "u", other, ""), (None, "https://a.b/", other, ""), (None, None, None, ""), (-5, "http://A.B:80/x y", "", ""), (61, "u", "x" * 999, ""), (62, "u", "x" * 999, ""), (1 << 62, "http://a.b/\n", "nl", "")]
    got, upper, folder = _round_trip(spark, rows)
    assert len(got) == len(rows)
    best = {}
    for p, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and p is not None:
            best[data] = max(best.get(data, p), p)
    want = []
    for p, _, html, _ in rows:
        data = (html or "").encode()
        again = data in best and best[data] != p
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best[data] if again else None, b"" if again else data))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got), key=repr) == sorted(want, key=repr)
    lost = spark.createDataFrame([("com,example)/none 1",), ("",), ("~",)], "key string")
    assert warc.lookup(spark, upper, f"{folder}/i", lost).count() == 0


def test_warc_keys_with_control_characters(spark):
    urls = ["http://a.b/x\ty", "http://a\t.b/", "http://a\nb.c/\tz", "http://a\r\n.c/q\x00\x7f", "\t", "\n", "a\x0bb\x1fc"]
    rows = [(k, u, f"page {k}", "") for k, u in enumerate(urls)]
    assert sorted((r["page_id"], bytes(r["payload"])) for r in _round_trip(spark, rows)[0]) == [(k, f"page {k}".encode()) for k in range(len(urls))]


def test_warc_of_no_pages(spark):
    assert _round_trip(spark, [])[0] == []


def test_surt(spark):
    rows = [("http://www.Example.com/a/b?x=1#y",), ("https://user@h.org:8080",), ("//c.d/e",), (None,), ("nonsense",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(warc.surt(F.col("u"))).collect()]
    assert got == ["com,example,www)/a/b?x=1", "org,h)", "d,c)/e", "", ")nonsense"]


def _want(rows, end=1):
    t, out, start = Tokenizer.from_file(TOKENIZER), [], 0
    coded = [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x in rows]
    coded.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    for d, ids in coded:
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_shards_round_trip(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    r = random.Random(8)
    rows = [(k * 7 - 100, " ".join(r.choice(["The", "cat's", "naïve", "ΣΑΣ,", "12.5%", "x y", "don't!!", "東京", "<|endoftext|>"]) for _ in range(r.randint(0, 40)))) for k in range(200)]
    rows += [(None, "no id"), (5, None), (6, ""), (7, "twice"), (7, "twice"), (7, "other"), (-(1 << 63), "least"), ((1 << 63) - 1, "most"), (8, "long " * 30000), (9, " \n\t")]
    folder = new_folder(spark, "test-sst")
    manifest = sstable.write_shards(make_docs(rows), folder, TOKENIZER)
    got = [tuple(x) for x in sstable.scan_shards(spark, manifest, folder).collect()]
    assert sorted(got, key=lambda x: x[1]) == _want(rows)
    t = Tokenizer.from_file(TOKENIZER)
    ask = spark.createDataFrame([(7,), (None,), (-100,), (4242,), (8,)], "doc_id bigint")
    found = sstable.get_documents(spark, manifest, folder, ask).collect()
    texts = {}
    for d, x in rows:
        texts.setdefault(d, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    assert sorted(((x["doc_id"], x["ids"]) for x in found), key=repr) == sorted(((d, i) for d in (7, None, -100, 8) for i in texts[d]), key=repr)


@pytest.mark.parametrize("form", ["{}", "a{}b", "হ{}", "{}.", "b{}!"])
def test_words_of_every_letter(form):
    words, whole = sstable.Words(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = [form.format(c) for c in map(chr, range(0x110000)) if c.isalpha()]
    assert words.by_word
    want = whole.encode_batch(texts, add_special_tokens=False)
    assert [x for x, y in zip(texts, want, strict=True) if np.frombuffer(words.text(x), words.kind).tolist() != y.ids] == []


def test_words_of_random_texts():
    words, whole, r = sstable.Words(TOKENIZER), Tokenizer.from_file(TOKENIZER), random.Random(14)
    letters = [c for c in map(chr, range(0x3000)) if c.isalpha()]
    marks = [c for c in map(chr, range(0x20, 0x3100)) if not c.isalpha() and c.isprintable()] + list(" \n\t\r\x0b\x0c\x00\x85\xa0\u2028\u200d\ufeff")
    pick = lambda: r.choice(r.choices((letters, marks, "abcdeXYZ", " .,;:!?%&*#$|'", "0123456789"), (3, 2, 8, 4, 1))[0])
    texts = ["".join(pick() for _ in range(r.randint(1, 24))) for _ in range(100_000)] + ["It's I'LL we've <|endoftext|>end", "\u0130. \u03a3\u03a3. \u09ac\u09dc"]
    want = whole.encode_batch(texts, add_special_tokens=False)
    assert [x for x, y in zip(texts, want, strict=True) if np.frombuffer(words.text(x), words.kind).tolist() != y.ids] == []


def test_words_of_the_given_documents():
    words, whole = sstable.Words(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    want = whole.encode_batch(texts, add_special_tokens=False)
    assert [x for x, y in zip(texts, want, strict=True) if np.frombuffer(words.text(x), words.kind).tolist() != y.ids] == []


def test_hot_and_large_ids_over_shards(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 2000)
    rows = [(5, f"hot {k} " + "w " * 100) for k in range(60)] + [(k, f"text {k}") for k in range(40)] + [(None, f"none {k}") for k in range(30)] + [(7, "long " * 3000)]
    folder = new_folder(spark, "test-sst")
    manifest = sstable.write_shards(make_docs(rows), folder, TOKENIZER)
    got = sorted((tuple(x) for x in sstable.scan_shards(spark, manifest, folder).collect()), key=lambda x: x[1])
    assert [x[0] for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, n, c) for d, _, n, c in _want(rows) if d is not None)
    assert manifest.where("low = 5 and high = 5").count() >= 3
    ask = spark.createDataFrame([(5,), (7,), (None,)], "doc_id bigint")
    assert sstable.get_documents(spark, manifest, folder, ask).count() == 60 + 1 + 1 + 1 + 30


def test_damaged_block_is_noticed(spark, make_docs):
    folder = new_folder(spark, "test-sst")
    manifest = sstable.write_shards(make_docs([(1, "some words")]), folder, TOKENIZER)
    name = manifest.first()["file"]
    path = f"{folder.removeprefix('file://')}/{name}"
    data = bytearray(open(path, "rb").read())
    data[3] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.ShardReader(Reader(folder), name).scan())


def test_token_shards_of_no_documents(spark, make_docs):
    folder = new_folder(spark, "test-sst")
    manifest = sstable.write_shards(make_docs([]), folder, TOKENIZER)
    assert manifest.count() == 0 and sstable.scan_shards(spark, manifest, folder).count() == 0


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words, whole = sstable.Words(path), Tokenizer.from_file(path)
    text = "Some text,\n with  spaces é"
    assert not words.by_word
    assert np.frombuffer(words.text(text), words.kind).tolist() == whole.encode(text, add_special_tokens=False).ids
