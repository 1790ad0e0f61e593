import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import periodic, queries


def _plain(words):
    """Runs by their definition: for each period the stretches that keep it, unless a smaller period is kept too."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            smaller = any(all(words[x] == words[x + p] for x in range(i, k + q - p)) for p in range(1, q))
            if k + q - i >= max(24, 3 * q) and not smaller:
                out.append((i, k + q - i, q))
            i = k
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random_words(r):
    if r.random() < 0.3:
        return [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 160))]
    n, a, out = r.randint(0, 160), r.randint(1, 4), []
    while len(out) < n:
        unit = [r.randint(1, a) for _ in range(r.randint(1, 12))]
        if r.random() < 0.4:
            unit = unit * r.randint(1, 3) + unit[: r.randint(0, len(unit))]
        out += (unit * r.randint(1, 9))[: r.randint(1, 60)]
        if r.random() < 0.3:
            out.append(r.randint(1, a + 1))
    return out


def test_runs_equal_their_definition():
    r, found = random.Random(1), 0
    for _ in range(1500):
        words = _random_words(r)
        want = _plain(words)
        assert periodic.find_runs(np.array(words, np.int64)) == want, words
        found += len(want)
    assert found > 800


def test_extensions_equal_comparing_words():
    r = random.Random(2)
    for _ in range(100):
        words = np.array([r.randint(1, r.randint(1, 3)) for _ in range(r.randint(2, 40))])
        tree, n = periodic.Extensions(words), len(words)
        i, j = (np.array(x) for x in zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j], strict=True))
        w = [*words.tolist(), 0]
        common = lambda i, j: next(k for k in range(n + 1) if max(i, j) + k >= n or w[i + k] != w[j + k])  # noqa: E731, B023
        assert tree.common(i, j).tolist() == [common(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        ranked = lambda key: sorted(range(n + 1), key=key)
        assert np.argsort(tree.rank).tolist() == ranked(lambda k: w[k:])  # noqa: B023
        assert np.argsort(tree.turned_rank()).tolist() == ranked(lambda k: [-x for x in w[k:-1]])  # noqa: B023


@pytest.mark.parametrize("unit", [1, 7, 4000])
def test_long_runs(unit):
    r = random.Random(unit)
    words = np.array(([r.randint(1, 999) for _ in range(unit)] * 20_000)[:20_000])
    assert periodic.find_runs(np.concatenate([[1000, 1001], words, [1000]])) == [(2, 20_000, unit)]


def _digest(doc_id, text):
    """op12's row by its contract."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _plain(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_by_its_contract(spark, make_docs, monkeypatch):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a " * 23, "a " * 24, "a b " * 30, "é ü " * 30, "x\x1cy z " * 9, "one\x0btwo\x0c\r\nthree " * 12, *[" ".join(map(str, _random_words(r))) for _ in range(300)]]
    rows = [*enumerate(texts), (3, "a " * 24), (None, "b c " * 20), (-7, "w " * 50)]
    docs = make_docs(rows).withColumns({"runs": F.lit("clash"), "h": F.lit(1), "n_words": F.lit("x")})
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    got = queries.op12_periodic_runs(spark, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((_digest(*x) for x in rows), key=repr)
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    monkeypatch.setattr(queries, "_table", lambda *_: docs.limit(0))
    assert queries.op12_periodic_runs(spark, "").count() == 0


def test_collapsed_texts(spark, make_docs):
    text = "start " + "a b c " * 10 + "end"
    row = periodic.periodic_runs(make_docs([(1, text)])).first()
    assert [tuple(x) for x in row["runs"]] == [(1, 30, 3)] and row["collapsed"] == "start a b c end" and row["n_words"] == 32


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"]) < 6000]
    got = {tuple(r)[0]: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert all(got[d] == _digest(d, t) for d, t in rows) and sum(x[1] > 0 for x in got.values()) > 10
