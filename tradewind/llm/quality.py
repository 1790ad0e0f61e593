"""Quality rules: statistics of whole texts, and an ordered decision list learned from labelled documents.

Everything is DataFrame functions. Statistics need no shuffle: repeated word windows are found inside the row by sorting
window hashes. Rules are learned by sequential covering: a rule grows condition by condition on two thirds of the
labelled rows that pass the base rules, is pruned on the rest, and the rows it covers leave before the next rule grows.
If a rule doesn't hold on the rest, the statistic that it opens with is given up. The list is one Spark expression.

LABELLED, THRESHOLDS, MAX_RULES and MAX_CONDITIONS are parameters of the learner; every document is judged by the whole list.

Defined results: a null text has no words and fails the base rules; without labelled rows of both classes there are no
learned rules; of labels that a document has twice the lower counts; of conditions of equal gain that of the wider gap
between values wins, then the first; repeated rows give equal results; very long texts are arrays in one row; other
columns don't matter, and those named as a statistic are replaced by judge and kept by keep_good.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import SPACE, stored

#: At most so many labelled rows, those of the smallest hashes of doc_id and text, are used to fit.
LABELLED = 20_000
THRESHOLDS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
PRECISION = 0.8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbols", "repeats", "dup_lines", "distinct", "upper", "marks", "digits", "line_words")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of so many words that occur twice or more in the array."""

    def covered(pos: Column) -> Column:
        step = lambda a, k: a + F.coalesce(F.least(F.lit(window), F.get(pos, k + 1) - F.get(pos, k)), F.lit(window))
        return F.aggregate(F.sequence(F.lit(0), F.size(pos) - 1), F.lit(0), step)

    def marked(pairs: Column) -> Column:
        same = lambda k, p: F.get(pairs, k)["h"].eqNullSafe(p["h"])
        return F.sort_array(F.array_compact(F.transform(pairs, lambda p, k: F.when(same(k - 1, p) | same(k + 1, p), p["i"]))))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, _let(_let(pairs, marked), covered)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    hashed = lambda h: _let(windows(h), count)
    return F.when(F.size(words) > window, _let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.lit(0)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of BASE and the other statistics that rules may use (ratios as doubles)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    df = docs.withColumns({"__words": words, "__lines": lines, "n_symbols": without("[#*$%&|<>]+").cast("bigint"), "__upper": without(r"\p{Lu}+"), "__marks": without("[!?]+"), "__digits": without("[0-9]+")})
    df = df.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("__words")),
        "__distinct": F.size(F.array_distinct("__words")),
        "__n_lines": F.size("__lines"),
    })
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = {"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "word_chars"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "__n_lines"), "distinct": per("__distinct", "n_words"), "upper": per("__upper", "word_chars"), "marks": per("__marks", "word_chars"), "digits": per("__digits", "word_chars"), "line_words": per("n_words", "__n_lines")}
    return df.withColumns(ratios).drop("__words", "__lines", "__upper", "__marks", "__digits", "__distinct", "__n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


Condition = tuple[str, str, float]


def _expression(rule: list[Condition]) -> Column:
    return reduce(and_, [F.col(f) > t if op == ">" else F.col(f) <= t for f, op, t in rule], F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of at most LABELLED labelled documents that pass the base rules, with bad (1: low quality) and grow (for growing, else pruning)."""
    wanted = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"))
    order = [F.xxhash64("doc_id").alias("__h"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th")]
    rows = rows.select(*FEATURES, (F.col("__quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0).alias("grow"), base_failed().alias("failed"), *order)
    # an id may have any number of rows
    rows = rows.orderBy("__h", "__id", "__th").limit(LABELLED).drop("__h", "__id", "__th")
    # the filter comes after the table is written: before, it would be pushed below the join, to all documents
    return stored(rows.repartition(4), "labelled").where("not failed").drop("failed")


def _binned(rows: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """For each statistic of the labelled sample how many thresholds lie below it; LABELLED rows at most, so in one partition."""
    above = lambda f, t: F.size(F.filter(F.array(*map(F.lit, t)), lambda x: F.col(f) > x))
    return stored(rows.select("bad", "grow", *[above(f, t).alias(f) for f, t in thresholds.items()]).repartition(1), "bins")


def _counts(rows: DataFrame, features: list[str]) -> dict:
    """{(feature, k): (bad, good)} of rows whose feature lies above exactly k thresholds."""
    pairs = [F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in features]
    found = rows.select(F.explode(F.array(*pairs)).alias("x"), "bad").groupBy("x.f", "x.k").agg(F.sum("bad"), F.sum(1 - F.col("bad"))).collect()
    return {(r[0], r[1]): (r[2], r[3]) for r in found}


def _best(counts: dict, thresholds: dict[str, list[float]], rule: list[Condition]) -> tuple[Condition | None, int, int]:
    """The condition, with the place of its threshold, of the best gain in information for the bad rows that stay covered."""
    from math import log2

    bad = sum(b for (f, _), (b, _) in counts.items() if f == next(iter(thresholds)))
    good = sum(g for (f, _), (_, g) in counts.items() if f == next(iter(thresholds)))
    start, best, found, kept = log2((bad + 1) / (bad + good + 1)), (1e-9, 0.0), None, (bad, good)
    for f, t in thresholds.items():
        low_b = low_g = 0
        gaps = [(b - a) / ((t[-1] - t[0]) or 1) for a, b in zip([t[0], *t], [*t[1:], t[-1], t[-1]], strict=False)]
        for k in range(len(t)):
            b, g = counts.get((f, k), (0, 0))
            low_b, low_g = low_b + b, low_g + g
            for op, b, g in (("<=", low_b, low_g), (">", bad - low_b, good - low_g)):
                gain = (round(b * (log2((b + 1) / (b + g + 1)) - start), 6), gaps[k])  # of equal gains, the wider gap
                if gain > best and (f, op, k) not in rule and b:
                    best, found, kept = gain, (f, op, k), (b, g)
    return found, *kept


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """An ordered list of rules that reject: conjunctions of (statistic, '>' or '<=', threshold)."""
    rows = labelled_sample(docs, labels)
    cuts = rows.agg(*[F.percentile_approx(f, [k / THRESHOLDS for k in range(1, THRESHOLDS)], 1000).alias(f) for f in FEATURES]).first()
    extremes = rows.groupBy("bad").agg(*[F.percentile_approx(f, [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0], 1000).alias(f) for f in FEATURES]).collect()
    values = {f: sorted({float(x) for r in [cuts, *extremes] for x in (r[f] or [])}) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for f, v in values.items() if len(v) > 1}
    values, rows = thresholds, _binned(rows, thresholds) if thresholds else rows
    rules: list[list[Condition]] = []
    while thresholds and len(rules) < MAX_RULES:
        rule: list[Condition] = []
        grow, prune = (rows.where(F.col("grow") if side else ~F.col("grow")) for side in (True, False))
        while len(rule) < MAX_CONDITIONS:
            condition, _, good = _best(_counts(grow.where(_expression(rule)), list(thresholds)), thresholds, rule)
            if not condition:
                break
            rule.append(condition)
            if not good:
                break
        if not rule:
            break
        cover = [F.struct(F.sum(F.when(_expression(rule[:n]), F.col("bad"))).alias("b"), F.sum(F.when(_expression(rule[:n]), 1 - F.col("bad"))).alias("g")).alias(str(n)) for n in range(1, len(rule) + 1)]
        held = [((x["b"] or 0), (x["g"] or 0)) for x in prune.agg(*cover).first()]
        worth = [((b - g) / (b + g) if b + g else -1.0, -n) for n, (b, g) in enumerate(held, 1)]
        n = -max(worth)[1]
        b, g = held[n - 1]
        if not b or b / (b + g) < PRECISION:
            thresholds = {f: t for f, t in thresholds.items() if f != rule[0][0]}  # what it opens with doesn't carry over
            continue
        rules.append([(f, op, values[f][k]) for f, op, k in rule[:n]])
        rows = rows.where(~_expression(rule[:n]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that rejects, from 1, or 0 where none does: one ordered conditional expression."""
    out = F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_expression(rule), F.lit(n)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with statistics (in place of columns of these names), base_failed, rule (the first learned rule that rejects, or 0) and kept."""
    rules = learn_rules(docs, labels)
    judged = statistics(docs).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    return judge(rows, labels).where("kept").select("__row.*")
