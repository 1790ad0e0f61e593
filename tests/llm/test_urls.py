import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tradewind.llm import queries, urls

ODD = [None, "", "nothing", "://", "http://", "HTTP://EXAMPLE.ORG", "http://ORG/", "http://a.b.Org/es/", "http://example.org/es/1", "http://x.example.org/es/1?a", "http://xexample.org/es/1", "http://example.org/en/12", "http://example.org/en/2#/en/1", "http://example.org?x=/es/", "http://com/de/", "http://a.com/fr", "http://a.com/fr/://org/es/", "http://É.com/de/ü", "http://a.com#/de/", "x://y.net/" + "z" * 50_000, "http://a.net/?a=1&&b=2&c#d", "http://user@a.org:80/x"]


def _rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([k for k in map(rest.find, "?#") if k >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_by_their_definition(spark):
    pages = spark.createDataFrame(list(enumerate([*ODD, *ODD])), "page_id bigint, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit(1), "__other": F.lit(2)})
    got = urls.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == 2 * len(ODD) and all(r["__other"] == 2 for r in got)
    for r in got:
        host, path, rule, verdict = _rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_lexical_features(spark):
    rows = spark.createDataFrame([(u,) for u in ODD], "url string").withColumns(urls.url_parts(F.col("url")))
    for r in urls.lexical(rows).collect():
        host, path = r["host"], r["path"]
        plain = lambda s: -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0
        assert math.isclose(r["host_entropy"], plain(host), abs_tol=1e-9) and math.isclose(r["path_entropy"], plain(path), abs_tol=1e-9)
        assert r["depth"] == len([x for x in path.split("/") if x]) and r["labels"] == len([x for x in host.split(".") if x])
        assert r["last_label"] == host.rsplit(".", 1)[-1] and r["last_two_labels"] == ".".join(host.split(".")[-2:])
        assert r["first_segment"] == (path.split("/") + ["", ""])[1] and r["url_length"] == len(host + path + r["query"])
    assert urls.lexical(rows).where("url like '%a=1%'").first()["params"] == 3


def _junk(r, bad):
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(letters) for _ in range(n))
    if bad:
        return f"http://{word(20, 'abcdefghijklmnopqrstuvwxyz0123456789-')}.{r.choice(['xyz', 'com'])}/{word(12, '0123456789')}?{'&'.join(f'{word(2)}={word(6)}' for _ in range(r.randint(3, 6)))}"
    return f"https://www.{word(6)}.{r.choice(['com', 'org'])}/{word(4)}/{word(6)}"


def test_trees_learn_what_junk_looks_like(spark):
    r = random.Random(5)
    made = [(_junk(r, k % 3 == 0), k % 3 == 0) for k in range(900)]
    labelled = spark.createDataFrame([*made[:600], (None, True), (made[1][0], None), *made[:5]], "url string, block boolean")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(made[600:])], "page_id bigint, url string")
    first, again = (sorted(map(tuple, urls.judge_urls(pages, [], labelled).select("page_id", "verdict", "score").collect())) for _ in range(2))
    assert first == again
    assert sum((v == "block") == bad for (_, v, _), (_, bad) in zip(first, made[600:], strict=True)) >= 0.97 * len(first)


def test_held_out_urls_of_the_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").withColumns(urls.url_parts(F.col("url"))).withColumn("found", urls.by_rules(queries.URL_RULES)).where("found is not null")
    known = pages.select("page_id", "url", (F.col("found.verdict") == "block").alias("block"))
    held = urls.judge_urls(known.where("page_id % 4 = 0"), [], known.where("page_id % 4 <> 0"))
    right, n = held.agg(F.sum(((F.col("verdict") == "block") == F.col("block")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.93


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 50)
    r, seen = random.Random(6), []
    rows = [(_junk(r, k % 3 == 0), k % 3 == 0) for k in range(300)]
    keep = urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    hot = spark.createDataFrame([*rows, *[(rows[0][0], True)] * 500], "url string, block boolean")
    assert urls.learn(hot).trees is not None
    assert dict(seen)["sampled-urls"].count() == 50


def test_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://a.org/x")], "page_id bigint, url string")
    assert [r["verdict"] for r in urls.judge_urls(pages, queries.URL_RULES).orderBy("page_id").collect()] == ["allow", "allow"]
    assert urls.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert urls.judge_urls(pages, [("a.net", "", "block"), ("net", "/x", "allow")]).where("page_id = 1").first()["rule"] == "a.net"
