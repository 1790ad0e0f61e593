"""URL filters: rules by host and path decide first, and gradient-boosted trees on lexical features judge every other url.

The trees (Spark ML) see what a url looks like: lengths, depth, shares of digits, entropies, numbers of parameters, labels
and marks, and statistics of its suffixes: how many labelled urls end their host in the same label or the same two labels,
or start their path with the same segment, and which share of them is blocked. These statistics count all labelled urls; only
the trees are fitted on a sample of at most SAMPLE distinct labelled urls, those of the smallest hashes. Scoring is one scan:
the statistics are joined on, and Spark broadcasts them while they are small and splits hot suffixes where it shuffles.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; of rules of equal length that
fit, one that blocks wins, then the first by name; without labelled urls of both kinds every url that no rule fits is allowed;
of labels that a url has twice, block counts; repeated rows get equal results; very long urls only cost their length; an empty
table gives no rows; other columns are carried, and those named as a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import stored

#: Distinct labelled urls that the trees are fitted on, at most.
SAMPLE = 20_000
TREES = 20
DEPTH = 4
STEP = 0.2
#: Labelled urls that the share of blocked urls over all of them counts for in each suffix's own share.
PRIOR = 10
LEXICAL = ("url_length", "host_length", "path_length", "query_length", "labels", "depth", "params", "url_digits", "host_digits", "hyphens", "marks", "host_entropy", "path_entropy")
SUFFIXES = ("last_label", "last_two_labels", "first_segment")
FEATURES = (*LEXICAL, *(f"{s}_{x}" for s in SUFFIXES for x in ("blocked", "count")))

Rule = tuple[str, str, str]


def url_parts(url: Column) -> dict[str, Column]:
    """host (A-Z in lower case), path and query; the path ends at the first ? or #."""
    has = url.contains("://")
    rest = F.when(has, F.substring_index(url, "://", 1)).otherwise(url)
    rest = F.when(has, url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit("")), "query": F.coalesce(query, F.lit(""))}


def by_rules(rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule (host, path, verdict) that fits the columns host and path, or null."""
    out = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def entropy(text: Column) -> Column:
    """Bits a character, from the lengths of the runs of its sorted characters."""
    log = lambda n: n * F.log2(F.greatest(n, F.lit(1.0)))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1.0).alias("n"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["sum"] + log(a["n"])).alias("sum")))
    runs = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda a: a["sum"] + log(a["n"]))
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - runs / n).otherwise(F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """df, which has host, path and query, with the columns of LEXICAL and the suffixes of each url."""
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    url = F.concat(host, path, query)
    of = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    share = lambda text: of(text, "[0-9]+") / F.greatest(F.length(text), F.lit(1))
    filled = lambda text, by: F.size(F.array_remove(F.split(text, by), ""))
    values = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query), "labels": filled(host, r"\."), "depth": filled(path, "/"),
        "params": filled(query, "&"), "url_digits": share(url), "host_digits": share(host), "hyphens": of(host, "-+"), "marks": of(url, r"[^\p{L}\p{N}/.-]+"), "host_entropy": entropy(host), "path_entropy": entropy(path),
    }
    suffixes = {"last_label": F.substring_index(host, ".", -1), "last_two_labels": F.substring_index(host, ".", -2), "first_segment": F.split_part(path, F.lit("/"), F.lit(2))}
    return df.withColumns({**{k: v.cast("double") for k, v in values.items()}, **suffixes})


@dataclass
class Model:
    """statistics: kind, key, blocked, count of every suffix of the labelled urls; share: blocked ones of all of them; trees: none if one kind of label is missing."""

    statistics: DataFrame
    share: float
    trees: GBTClassificationModel | None


def _with_statistics(df: DataFrame, statistics: DataFrame, share: float) -> DataFrame:
    for s in SUFFIXES:
        own = statistics.where(F.col("kind") == s).select(F.col("key").alias(s), F.col("blocked").alias(f"{s}_blocked"), F.col("count").alias(f"{s}_count"))
        df = df.join(own, s, "left")
    return df.na.fill({f"{s}_blocked": share for s in SUFFIXES} | {f"{s}_count": 0.0 for s in SUFFIXES})


def learn(labelled: DataFrame) -> Model:
    """Trees from labelled urls: columns url and block (boolean); rows without either don't count."""
    rows = labelled.where("url is not null and block is not null").select("url", F.col("block").cast("double").alias("label"))
    rows = stored(lexical(rows.withColumns(url_parts(F.col("url")))), "labelled-urls")
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = blocked / n if n else 0.0
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("key")) for s in SUFFIXES]))
    counts = rows.select(kinds.alias("s"), "label").groupBy("s.kind", "s.key").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
    counts = counts.select("kind", "key", ((F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).alias("blocked"), F.log1p("n").alias("count"))
    statistics = stored(counts, "url-suffixes")
    if not 0 < blocked < n:
        return Model(statistics, share, None)
    one = rows.groupBy("url").agg(F.max("label").alias("label"), *[F.first(c).alias(c) for c in (*LEXICAL, *SUFFIXES)])
    sample = one.orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
    sample = _with_statistics(sample, statistics, share).select("url", "label", *FEATURES)
    # one sorted partition of at most SAMPLE rows, so that sums, and with them the trees, come out alike in every run
    sample = stored(sample.repartition(1).sortWithinPartitions("url"), "sampled-urls")
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(sample).select("label", "__features")
    trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7).fit(train)
    return Model(statistics, share, trees)


def score(df: DataFrame, model: Model) -> DataFrame:
    """df, which has host, path and query, with score: the chance, from 0 to 1, that a url is to be blocked."""
    if model.trees is None:
        return df.withColumn("score", F.lit(0.0))
    rows = df.select(F.struct(*df.columns).alias("__row"), "host", "path", "query")
    rows = _with_statistics(lexical(rows), model.statistics, model.share).select("__row", *FEATURES)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(rows).select("__row", "__features")
    rows = model.trees.setFeaturesCol("__features").setProbabilityCol("__chance").transform(rows)
    return rows.select("__row.*", vector_to_array("__chance")[1].alias("score"))


def judge_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, score and verdict (allow or block): that of the longest rule that fits, else of the trees.

    Without labelled urls those that a rule judges are the labelled ones.
    """
    made = ("host", "path", "query", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in made]
    rows = pages.select(*kept).withColumns(url_parts(F.col("url"))).withColumn("__found", by_rules(rules))
    if labelled is None:
        labelled = rows.where("__found is not null").select("url", (F.col("__found.verdict") == "block").alias("block"))
    scored = score(rows, learn(labelled))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(*kept, "host", "path", F.col("__found.rule").alias("rule"), "score", F.coalesce("__found.verdict", own).alias("verdict"))
