import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tradewind.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the ", " ", "  ", "\n", "\n\n", "\t", "é", "漢", "🙂", "▁", " ", "'s", "<|endoftext|>", "<s>", "<0x41>", "1", "23", ".", "!!", "\x00", "\x1c", "\r\n", "ing", "ﬁ", "​", " ", "\x85"]


@pytest.fixture(scope="module")
def words():
    return alignment._words(A, B)


def _plain(text, sides):
    """Ids of whole texts from the libraries, then links and groups by comparing all ranges."""
    if not text:
        return 0, 0, 0, 0, "", []
    ids = [sides[0].side.whole.encode(" " + text, add_special_tokens=False).ids, sides[1].side.model.encode(text)]
    raw = [[s.side.bytes[k] for k in x] for s, x in zip(sides, ids, strict=True)]
    if any(b"".join(x) != (" " + text).encode() for x in raw):
        return 0, 0, 0, 0, "", []
    ends = [np.cumsum([*map(len, x)]).tolist() for x in raw]
    (a, b), (ea, eb) = ids, ends
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(raw[0][i]), eb[j] - len(raw[1][j])) < min(ea[i], eb[j])]
    groups, low = [], 0
    for e in sorted({*ea} & {*eb}):
        groups.append("|".join(",".join(str(k) for k, end in zip(x, closes, strict=True) if low < end <= e) for x, closes in ((a, ea), (b, eb))))
        low = e
    return len(a), len(b), len(groups), len(links), ";".join(groups), links


def _texts(n, seed):
    r = random.Random(seed)
    some = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]
    every = lambda: chr(r.choice([r.randint(0, 0x7F), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))
    return some + ["".join(every() for _ in range(r.randint(0, 12))) for _ in range(n // 2)]


@pytest.mark.parametrize("piece", [1 << 16, 7, 1])
def test_alignment_equals_comparing_all_ranges(words, monkeypatch, piece):
    monkeypatch.setattr(alignment, "PIECE", piece)
    sizes = [len(s.sizes) for s in words.sides]
    marks = [f"{k}{end}" for size, ends in zip(sizes, (",|", ",;"), strict=True) for end in ends for k in range(size)]
    texts = _texts(1500, piece)
    x = alignment._align(texts, words, marks)
    for k, text in enumerate(texts):
        want = _plain(text, words.sides)
        assert (x["n_a"][k], x["n_b"][k], x["n_groups"][k], x["n_links"][k], x["groups"][k]) == want[:5], text
        pairs = {int(c): int(n) for c, n in zip(x["codes"][x["at"][x["cuts"][k] : x["cuts"][k + 1]]], x["times"][x["cuts"][k] : x["cuts"][k + 1]], strict=True)}
        assert pairs == Counter(a * sizes[1] + b for a, b in want[5])


def test_words_are_forgotten(words, monkeypatch):
    texts = _texts(60, 9)
    first = words.encode(texts)
    monkeypatch.setattr(alignment, "CACHED", 5)
    assert all(np.array_equal(x, y) and np.array_equal(n, m) for (x, n), (y, m) in zip(first, words.encode(texts), strict=True))


def test_merge_path_of_unequal_lists():
    r = random.Random(2)
    for _ in range(200):
        a, b = (sorted({*r.sample(range(1, 60), r.randint(0, 40)), 60}) for _ in range(2))
        got = alignment.merge_path(np.array(a), np.array(b), r.randint(1, 9))
        ranges = [list(zip([0, *x], x, strict=False)) for x in (a, b)]
        want = {(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (u, v) in enumerate(ranges[1]) if s < v and u < e}
        assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == sorted(want)
        assert [a[i] for i in got[2]] == [b[j] for j in got[3]] == sorted({*a} & {*b})


def test_counts_over_all_documents(spark, make_docs, words, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    texts = [None, "", "▁", "the cat sat on the mat", "the cat sat on the mat", "x" * 5000, *_texts(80, 5)]
    docs = make_docs([*enumerate(texts), (3, "again the cat"), (None, "null id, the cat")]).withColumns({"chunk": F.lit("clash"), "n_a": F.lit(None)}).repartition(3)
    got = alignment.align_documents(docs, A, B).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = [(d, *_plain(t, words.sides)) for d, t in rows]
    count = Counter(pair for x in plain for pair in x[6])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    want = [(d, a, b, g, n, groups, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)) for d, a, b, g, n, groups, links in plain]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_of_no_documents(spark, make_docs):
    assert alignment.align_documents(make_docs([]), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.align_documents(make_docs([(1, None)]), A, B).collect()] == [(0, 0, 0, 0, "", 0, 0)]
