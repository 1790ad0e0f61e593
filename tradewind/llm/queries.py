"""The queries of this subpackage's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm import warc
    from tradewind.llm.common import new_folder

    pages, folder = _table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    upper = warc.build_index(warc.write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key")).distinct()
    captures = warc.lookup(spark, upper, f"{folder}/index", keys)
    records = warc.read_records(captures, f"{folder}/archives", payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tradewind.llm import sstable
    from tradewind.llm.common import new_folder

    folder = new_folder(spark, "tokens")
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return sstable.scan_shards(spark, manifest, folder)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.extraction import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.quality import judge

    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.decontamination import find_leaks

    leaks = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max("changed").alias("changed"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.sharding import shard_documents

    sharded = shard_documents(_table(spark, sf_dir, "documents"), 16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules of op11's contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.urls import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11's rules decide before its trees do."""
    from tradewind.llm.urls import by_rules, url_parts

    pages = _table(spark, sf_dir, "pages").select("page_id", "url").withColumns(url_parts(F.col("url"))).withColumn("found", by_rules(URL_RULES))
    return pages.select("page_id", "host", "path", "found.rule", "found.verdict")


def planted_periods(docs: DataFrame) -> DataFrame:
    """docs with the periods that op12's contract plants: from word a on, the words a, a + 1, ... a + p - 1 again and again."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    df = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    df = df.withColumn("a", F.when(n > 0, F.col("g") % n))
    df = df.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform("w", lambda _, i: F.get("w", at(i))), " ")
    return df.select("doc_id", F.when(F.col("p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.llm.periodic import periodic_runs

    found = periodic_runs(planted_periods(_table(spark, sf_dir, "documents")))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda y, x: F.when(more(x, y), x).otherwise(y))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n"))))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("said"), "collapsed")
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("said", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tradewind.llm.alignment import align_documents

    groups = lambda: F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 sets each source as its target."""
    from tradewind.llm.mixing import sizes, source_targets

    found = source_targets(sizes(_table(spark, sf_dir, "documents")))
    return found.select("source", F.col("weight").cast("bigint").alias("weight"), F.col("size").alias("source_size"), F.round("target", 3).alias("target"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op6 starts from."""
    from tradewind.llm.quality import BASE, base_failed, statistics

    return statistics(_table(spark, sf_dir, "documents")).select("doc_id", *BASE, base_failed().alias("base_failed"))


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of op9's shards as a whole: nothing lost, slots without gaps, bytes within the largest row of the mean."""
    from tradewind.llm.sharding import shard_documents

    sharded = shard_documents(_table(spark, sf_dir, "documents"), 16)
    last = F.max("slot").alias("last")
    shards = sharded.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.countDistinct("slot").alias("slots"), last)
    total = shards.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest_row"), F.min((F.col("n") == F.col("slots")) & (F.col("last") == F.col("n") - 1)).alias("gapless"), F.max("bytes").alias("most"), F.min("bytes").alias("least"))
    even = (F.col("most") - F.col("bytes") / 16 <= F.col("largest_row")) & (F.col("bytes") / 16 - F.col("least") <= F.col("largest_row"))
    return total.select("rows", "bytes", "largest_row", "gapless", even.alias("even"))


QUERIES = {f.__name__: f for f in (op1_warc_capture_index, op2_token_sstable, op3_line_dedup, op4_extract_main_text, op5_mix_sources, op6_quality_rules, op7_decontaminate, op8_language_id, op9_sampled_splitters, op10_simhash_components, op11_url_filter, op12_periodic_runs, op13_align_tokenizers)}
#: Parts of operators' results that SQL can express where it can't express the whole.
PARTS = {f.__name__: f for f in (mix_targets, quality_base_counts, shard_totals, url_rules)}
WORD = r"[^\x20\x09-\x0D]+"

#: op1: of equal payloads of 1000 bytes or more, the one of the largest page_id is the response.
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to FROM q
"""

#: op3 by its definition: pairs of equal lines on one diagonal of two documents are a run, and a line goes that lies in a
#: run of eight words whose other copy is earlier.
LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '{WORD}')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE regexp_matches(line, '{WORD}')),
pairs AS (SELECT a.doc_id, a.i, a.n, b.doc_id AS other, a.i - b.i AS apart, a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.i - b.i ORDER BY a.i) AS run
  FROM w a JOIN w b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
runs AS (SELECT DISTINCT doc_id, min(i) AS low, max(i) AS high FROM pairs GROUP BY doc_id, other, apart, run HAVING sum(n) >= 8),
gone AS (SELECT DISTINCT w.doc_id, w.pos FROM w JOIN runs r ON w.doc_id = r.doc_id AND w.i BETWEEN r.low AND r.high),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM l LEFT JOIN gone g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY l.doc_id),
all_lines AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(a.n, 0) AS n_lines, coalesce(a.n, 0) - coalesce(k.n, 0) AS n_removed
FROM documents d LEFT JOIN all_lines a USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

#: The targets of op5: by size over weight, the first k sources stop at twice their size, and the rest share what is left;
#: k is the least for which none of the rest is above its own limit.
TARGETS_SQL = f"""
WITH s AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '{WORD}')), 0)) AS size FROM documents GROUP BY 1),
n AS (SELECT source, CAST(size AS BIGINT) AS size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source) AS k, 2.0::DOUBLE * size / weight AS stop FROM n),
c AS (SELECT *, coalesce(sum(2 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
f AS (SELECT min(k) AS k, min_by(level, k) AS level FROM (SELECT k, stop, (1.5::DOUBLE * (SELECT sum(size) FROM n) - capped) / left_weight AS level FROM c) WHERE level <= stop)
SELECT source, CAST(weight AS BIGINT) AS weight, size AS source_size, round(CASE WHEN f.k IS NULL OR o.k < f.k THEN CAST(2 * size AS DOUBLE) ELSE f.level * weight END, 3) AS target FROM o CROSS JOIN f
"""

#: The counts of op6: a word counts once, in however many repeated windows it is.
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d),
t AS (SELECT r, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) > 4),
g AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS part FROM t),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, part) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) x(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY r)
SELECT doc_id, len(words) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  len(words) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(words) AS base_failed
FROM w LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)
"""

SHARDS_SQL = """
WITH s AS (SELECT octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents)
SELECT count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(size) AS BIGINT) AS largest_row, true AS gapless, true AS even FROM s
"""

#: What the rules of op11 decide: of those that fit, the longest.
RULES_SQL = """
WITH r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) x(rule_host, rule_path, verdict)),
p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict FROM u JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, host, path, f.rule, f.verdict FROM u LEFT JOIN f USING (page_id)
"""

ORACLES: dict[str, str] = {"op1_warc_capture_index": WARC_SQL, "op3_line_dedup": LINES_SQL, "mix_targets": TARGETS_SQL, "quality_base_counts": BASE_SQL, "shard_totals": SHARDS_SQL, "url_rules": RULES_SQL}
