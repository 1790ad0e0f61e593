import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_quality_simhash import _brute_components, _brute_print
from tradewind.llm import queries
from tradewind.llm.common import intermediates, stored

SF = "/root/testdata/sf0.001"


def test_stages_agree_with_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else None)
        docs = stored(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    raw, good, single, clean, mixed = seen
    assert set(good) <= set(raw) and set(single) <= set(good) and set(clean) <= set(single) and set(mixed) <= set(clean)
    ids = sorted(good)
    roots = _brute_components([_brute_print(good[d]) for d in ids])
    assert set(single) == {ids[k] for k in set(roots)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(d, 1) == 1 for d in good)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [d for d in clean if any(x in clean[d] for x in items)]
    t, final = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), docs.collect()
    assert len(final) >= len(mixed)
    start = 0
    for r in sorted(final, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    whole = {(d, zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, x in mixed.items()}
    assert whole & {(r["doc_id"], r["ids_crc32"]) for r in final}


def test_run_is_the_stages_and_leaves_its_result_only(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert left == {"corpus", "token-shards"}


def test_intermediates_go_when_the_work_fails(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    with pytest.raises(ZeroDivisionError), intermediates(spark):
        stored(spark.range(3), "failing")
        with intermediates(spark):
            stored(spark.range(3), "inner")
        assert [x for x in os.listdir(shared) if x.startswith("failing")] and not [x for x in os.listdir(shared) if x.startswith("inner")]
        1 / 0
    assert not [x for x in os.listdir(shared) if x.startswith("failing")]


@pytest.mark.parametrize("name", sorted(queries.PARTS))
def test_parts_equal_their_sql(spark, name, tmp_path):
    full = f"{SF}/documents.parquet"
    docs = spark.read.parquet(full)
    odd = [(900, None, "en", "a", 0), (901, "", "en", "a", 0), (902, "w " * 9000, "en", None, 9), (902, "w " * 9000, "en", None, 9), (903, " \n\n # \u00e9\U0001f600 x\n # \u00e9\U0001f600 x", "en", "\u00e9", 9)]
    docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(docs.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = [None, "", "x", "://", "http://ORG/", "http://a.example.org/en/12?q", "HTTP://EXAMPLE.ORG/es/#/en/1", "http://xexample.org/es/", "http://a.com?/fr/", "http://c.com/fr/\u00e9", "http://org.com/de/"]
    pages.unionByName(spark.createDataFrame([(9000 + k, u, None) for k, u in enumerate(urls)], "page_id bigint, url string, html string").select(pages.columns)).write.parquet(f"{tmp_path}/pages.parquet")
    for folder, files in ((SF, ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        for table in ("documents", "pages"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{files}'")
        found = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in found.description]
        got = queries.PARTS[name](spark, folder).select(columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_all_thirteen_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def test_queries_of_tables_with_clashing_columns(spark, make_docs, monkeypatch):
    clash = {c: F.lit("x") for c in ("size", "slot", "shard", "print", "th", "fingerprint", "component_id", "__key", "law", "n_a", "groups", "runs", "h", "g", "w")}
    docs = make_docs([(k, f"words of document {k} that are long enough") for k in range(6)] + [(None, None), (3, ""), (3, "")]).withColumns(clash)
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    for name in ("op9_sampled_splitters", "op10_simhash_components", "op12_periodic_runs", "op13_align_tokenizers"):
        got = queries.QUERIES[name](spark, "")
        assert got.count() == 9 and len(set(got.columns)) == len(got.columns), name


def test_op8_accuracy(spark):
    got = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97


def test_filters_keep_columns_of_clashing_names(spark, make_docs):
    from tradewind.llm import decontamination, mixing, quality, simhash

    extra = ", th string, rep string, skey string, n_words string, kept string, size string, print string, label string"
    words = "some plain words of one document that are enough to pass the rules of length here"
    rows = [(k, f"{words} {k}", "en", "s", 5, *"abcdefgh") for k in range(3)]
    docs = make_docs(rows, extra)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "another text that is in none of them at all")], "item_id bigint, text string")
    for out in (quality.keep_good(docs, labels), simhash.keep_one_of_each(docs, 0), decontamination.drop_leaks(docs, bench), mixing.take_mix(docs)):
        assert out.columns == docs.columns and out.count() >= 1
        assert {tuple(r)[5:] for r in out.collect()} == {tuple("abcdefgh")}


def test_shared_folder_where_none_is_set(spark, monkeypatch):
    from tradewind.llm import common

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    before = spark.sparkContext.getCheckpointDir()
    assert common.shared_dir(Session()) == common.shared_dir(Session()) != common.shared_dir(spark)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert before


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    full = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    for name, n in (("none", 0), ("odd", 4)):
        folder = f"{tmp_path}/{name}"
        text = "plain words of a document that pass the rules of length as there are enough of them"
        rows = [(None, text + " one", "en", "s", 1), (7, None, None, None, None), (8, "", "en", "s", 0), (9, text + " two others here", None, None, 5)][:n]
        spark.createDataFrame(rows, full["documents"].schema).write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            full[t].limit(0 if n == 0 else 1000).write.parquet(f"{folder}/{t}.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert (got.count() > 0) == (n > 0)
