import random
import re
from collections import Counter

import numpy as np
import xxhash

from tradewind.llm import quality, simhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    n = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark, make_docs):
    r = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a b c d e", "a b c d e f", "x " * 5, "x " * 6, "é ü z\n\né ü z\n#*$%&|<>", "one two three four five one two three four five six", "A\x0bB\x0cC\rD", "w " * 5000]
    texts += ["".join(r.choice(["ab ", "c ", "d\n", "e\t", "# ", "AB! "]) for _ in range(r.randint(0, 80))) for _ in range(150)]
    docs = make_docs(list(enumerate(texts)) + [(3, "a"), (None, "null id")])
    for row in quality.statistics(docs).collect():
        assert tuple(row[c] for c in quality.BASE) == (lambda b: (b[0], b[1], b[2], b[3], b[4]))(_brute(row["text"])), row["text"]


def test_rules_learn_planted_junk(spark, make_docs):
    r = random.Random(4)
    good = [" ".join(r.choice("lorem ipsum dolor sit amet elit sed tempor".split()) + str(r.randint(0, 999)) for _ in range(r.randint(20, 60))) for _ in range(120)]
    bad = [" ".join(w + "###" for w in t.split()) for t in good[:60]]
    docs = make_docs(list(enumerate(good + bad)) + [(999, None), (1000, "short")])
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(0, 180, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.judge(docs, labels).collect()}
    assert all(got[k]["kept"] == (k < 120) for k in range(180))
    assert got[999]["base_failed"] and not got[999]["kept"] and not got[1000]["kept"]
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.judge(docs, labels.where("false"))
    assert none.where("not kept and not base_failed").count() == 0


def test_quality_of_no_rows(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.judge(make_docs([]), labels).count() == 0


def _brute_print(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = SPLIT.findall(lowered)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(prints):
    """{position: smallest position linked} by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    r = random.Random(5)
    for text in [None, "", "One", "a b c d", "A b\tC\nd e", "É é À", "x " * 40000] + ["".join(r.choice(["ab ", "C ", "dé\n"]) for _ in range(r.randint(1, 99))) for _ in range(50)]:
        assert simhash.fingerprint(text) == _brute_print(text)


def _planted(seed, n, near):
    r = random.Random(seed)
    prints = [r.getrandbits(64) for _ in range(n)]
    for _ in range(near):
        x = r.choice(prints)
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    return list(dict.fromkeys(prints))


def test_trie_join_finds_all_links(spark):
    prints = _planted(6, 400, 500)
    want = _brute_components(prints)
    for pair in (1 << 20, 64, 4):
        nodes = spark.createDataFrame([(np.array([p], np.uint64).view(np.int64)[0].item(), k) for k, p in enumerate(prints)], "node bigint, id bigint")
        links = simhash.near_links(nodes.selectExpr("node as print"), 4, pair)
        got = {x["node"] % (1 << 64): x["id"] for x in simhash.components(nodes, links).collect()}
        assert [got[p] for p in prints] == want, pair


def test_near_duplicates_end_to_end(spark, make_docs):
    r = random.Random(7)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(80)) for _ in range(30)]
    texts = base + [t + " tail" for t in base[:10]] + base[:5] + [None, "", "zz", "  "]
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, base[0]), (None, "only null"), (1000, base[0])]
    docs = make_docs(rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    prints = [_brute_print(t) for _, t in ids]
    want = Counter((d, p, ids[k][0]) for (d, _), p, k in zip(ids, prints, _brute_components(prints), strict=True))
    assert Counter((x["doc_id"], x["print"] % (1 << 64), x["component_id"]) for x in got) == want
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    heads = {k[2] for k in want if k[2] is not None}
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(heads)
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_labelled_sample_is_bounded_by_rows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 40)
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    docs = make_docs([(1, words(k)) for k in range(500)] + [(k, words(k)) for k in range(2, 60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    first, again = (sorted(map(tuple, quality.labelled_sample(docs, labels).collect())) for _ in range(2))
    assert len(first) == 40 and first == again
