import random
import zlib
from collections import defaultdict

import numpy as np

from tradewind.llm import mixing, sharding

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def _texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randint(0, 60))) for _ in range(n)]


def test_shards_are_near_equal_and_slots_gapless(spark, make_docs):
    texts = _texts(300)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, "the same text in a third of all rows " * 5) for k in range(150)]
    rows += [(None, "no id"), (5000, None), (5001, ""), (7, texts[7]), (7, texts[7])]
    got = sharding.shard_documents(make_docs(rows), 8).collect()
    assert len(got) == len(rows)
    size = {(d, zlib.crc32((t or "").encode())): len((t or "").encode()) + 1 for d, t in rows}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == size[r["doc_id"], r["text_crc32"]]
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(8))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sums = [sum(r["size"] for r in part) for part in by.values()]
    assert max(sums) - min(sums) <= 2 * max(size.values())
    again = sharding.shard_documents(make_docs(rows), 8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_shards_of_empty_and_single(spark, make_docs):
    assert sharding.shard_documents(make_docs([]), 4).count() == 0
    one = sharding.shard_documents(make_docs([(1, "x")]), 4).collect()
    assert [(r["size"], r["slot"]) for r in one] == [(2, 0)] and 0 <= one[0]["shard"] < 4


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(out.tolist()) == list(range(n))


def _brute_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, {s for s in names if sizes[s]}
    out = {s: 0.0 for s in names if not sizes[s]}
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


def test_mix_meets_targets(spark, make_docs):
    rows = [(k, t, "en", ["a", "b", "c", None, "é"][k % 5] if k % 3 else "a", 0) for k, t in enumerate(_texts(200, 2))]
    rows += [(900, None, "en", "empty", 0), (901, "one two", "en", "tiny", 0), (901, "one two", "en", "tiny", 0), (None, "no id here", "en", "b", 0), (902, " ".join(WORDS * 700), "en", "long", 0)]
    got = mixing.mix_documents(make_docs(rows)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got) == sorted((d if d is not None else -1, len((t or "").split())) for d, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = _brute_targets(dict(sizes))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    wanted = defaultdict(int)
    for s, x in want.items():
        wanted[sizes[s], round(x, 6)] += round(x)
    assert dict(taken) == dict(wanted)
    again = mixing.mix_documents(make_docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_text_has_the_taken_words(spark, make_docs):
    rows = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(_texts(40, 5))] + [(77, None, "en", "a", 0), (78, "x\ny", "en", "z", 3)]
    docs = make_docs(rows)
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {d: t for d, t, *_ in rows}
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert " ".join(r["text"].split()) in " ".join(texts[r["doc_id"]].split()) and r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect() if r["taken"]}
    assert dict(words) == taken


def test_permutation_has_an_inverse():
    for n in (1, 2, 3, 100, 4097):
        key = np.full(n, 99, dtype=np.uint64)
        out = mixing.permute(np.arange(n), np.full(n, n), key)
        assert sorted(out) == list(range(n)) and mixing.permute(out, np.full(n, n), key, back=True).tolist() == list(range(n))


def test_shards_have_equal_slots_and_sources_what_they_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 4)
    owned = {k: (k * 37) % 300 + 1 for k in range(11)} | {11: 5000}
    dealt = mixing.deal(spark.createDataFrame(list(owned.items()), "source_id bigint, slots bigint"), 5).collect()
    total, size = sum(owned.values()), -(-sum(owned.values()) // mixing.LEAST_SHARDS)
    slots, shards = defaultdict(list), defaultdict(int)
    for r in dealt:
        slots[r["source_id"]].append(r["slot"])
        shards[r["shard"]] += 1
    assert {k: sorted(x) for k, x in slots.items()} == {k: list(range(n)) for k, n in owned.items()}
    assert sorted(shards.items()) == [(k, min(size, total - k * size)) for k in range(mixing.LEAST_SHARDS)]
    assert mixing.deal(spark.createDataFrame([], "source_id bigint, slots bigint"), 5).count() == 0


def test_mix_of_nothing(spark, make_docs):
    assert mixing.mix_documents(make_docs([])).count() == 0
    assert mixing.take_mix(make_docs([(1, None)])).count() == 0
