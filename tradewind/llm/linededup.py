"""Line deduplication by a suffix array over sequences of line ids; everything is DataFrame functions.

A document is the sequence of its lines that have a word; lines without one neither belong to a run nor end it. Lines
that occur once get no id and end every run. Suffixes are ranked by prefix doubling: their rank by 2**(k+1) lines is the
place of the pair (rank by 2**k, rank by 2**k of the suffix 2**k lines on) among all such pairs. Sorted by rank, they are
the suffix array; the longest common prefix of neighbours gives the intervals of suffixes that agree on so many lines.
A suffix that is not the earliest of its interval starts a later copy of a run, whose lines are deleted.

A line is to be deleted if it lies in a run of MIN_WORDS words that occurs earlier too. Every such maximal run is the
union of its shortest parts of MIN_WORDS words: from each of its lines on, and up to each of its lines. As every line has
a word, these have at most MIN_WORDS lines, so doubling stops there, however long the maximal runs are.

Documents are ordered by doc_id (null first), then by a hash of the text. Defined results: a null text stays null and
has no lines; lines without words stay; rows equal in id and text count as one document and get the same result; of
runs that are equal the earliest stays, also within a document; an empty table gives an empty result; columns other
than doc_id and text are kept, but for n_lines and n_removed, which are replaced; very long texts are arrays in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import SPACE, constant, stored, with_global_index

MIN_WORDS = 8
_DOC = ["doc_id", "dk", "th"]
_WORD = f"[^{SPACE[1:-1]}]+"


def _ranked(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """rows whose key occurs so often at least, with rank: the place of their key among all such keys in order."""
    keys = rows.groupBy(*key).count().where(F.col("count") >= least).select(*key)
    # a table of its own, so that Spark may split the rows of a line that very many documents have
    return rows.join(stored(with_global_index(keys, [F.col(c) for c in key], "rank"), "ranks"), key)


def _in_documents(rows: DataFrame, *columns: str) -> DataFrame:
    """One row a document with its lines in order; rows equal in id and text fall together."""
    return rows.groupBy("dk", "th").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_set(F.struct("i", *columns))).alias("lines"))


def _ahead(at: Column, i: Column, steps: int) -> Column:
    """The line so many steps after index at (of number i), or null where one in between has no id."""
    line = F.get("lines", at + steps)
    return F.when(line["i"] == i + steps, line)


def _suffixes(docs: DataFrame, depth: int) -> DataFrame:
    """A row for each line that is repeated: rank (by depth lines), ids, words and places of the lines from it on."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, p: F.struct(p.alias("pos"), F.regexp_count(x, F.lit(_WORD)).alias("words"), F.xxhash64(x).alias("a"), F.hash(x).alias("b"))), lambda x: x["words"] > 0)
    text = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), F.xxhash64("text").alias("th"), F.posexplode(lines).alias("i", "line"))
    rows = text.select(*_DOC, "i", "line.pos", "line.words", "line.a", "line.b")
    rows = _ranked(rows, ["a", "b"], 2).select(*_DOC, "i", "pos", "words", F.col("rank").alias("id"), "rank")
    step = 1
    while step < depth:
        found = _in_documents(rows, "pos", "words", "id", "rank")
        moved = F.transform("lines", lambda x, at: F.struct(x["i"].alias("i"), x["pos"].alias("pos"), x["words"].alias("words"), x["id"].alias("id"), x["rank"].alias("low"), F.coalesce(_ahead(at, x["i"], step)["rank"], F.lit(-1)).alias("high")))  # noqa: B023
        rows = _ranked(stored(found.select(*_DOC, F.explode(moved).alias("x")).select(*_DOC, "x.*"), "pairs"), ["low", "high"], 1).drop("low", "high")
        step *= 2
    some = lambda at, x, field: F.filter(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda k: F.when(F.get("lines", at + k)["i"] == x["i"] + k, F.get("lines", at + k)[field])), lambda v: v.isNotNull())
    suffix = F.transform("lines", lambda x, at: F.struct(x["i"].alias("i"), x["rank"].alias("rank"), some(at, x, "id").alias("ids"), some(at, x, "words").alias("words"), some(at, x, "pos").alias("places")))
    return _in_documents(rows, "pos", "words", "id", "rank").select(*_DOC, F.explode(suffix).alias("x")).select(*_DOC, "x.*")


def _prefix(ids: Column, before: Column, depth: int) -> Column:
    """How many ids both arrays have in common from the start."""
    same = F.lit(depth)
    for k in reversed(range(depth)):
        same = F.when(F.get(ids, k).eqNullSafe(F.get(before, k)) & F.get(ids, k).isNotNull(), same).otherwise(F.lit(k))
    return same


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(dk, th, places): runs of lines at these places (0-based) of a document that have an earlier copy and min_words words."""
    depth = max(1, min_words)
    upto = lambda k, start: F.aggregate(F.slice("words", start, F.greatest(k - start + 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    lengths = F.sequence(F.lit(1), F.size("words"))
    # the shortest run from here on with the words, and those up to a later line with the words that start here
    fit = F.filter(lengths, lambda k: (upto(k, 1) >= min_words) & ((upto(k, 2) < min_words) | (upto(k - 1, 1) < min_words)))
    rows = _suffixes(docs, depth).withColumn("depths", fit).drop("words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["rank", "doc_id", "th", "i"]
    array = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "suffix-array")
    # of each range of the array, the last suffix and then the last starts of intervals go on into the next one
    last = dict(array.groupBy("part").agg(F.max_by("ids", "at")).collect())
    before, ids = [], []
    for part in range(max(last, default=-1) + 1):
        before.append(ids)
        ids = last.get(part, ids)
    window = Window.partitionBy("part").orderBy("at")
    previous = F.coalesce(F.lag("ids").over(window), F.get(constant(before, "array<bigint>"), F.col("part")))
    array = array.withColumn("lcp", _prefix(F.col("ids"), previous, depth))
    start = lambda k: F.max(F.when(F.col("lcp") < k, F.col("at"))).over(window.rowsBetween(Window.unboundedPreceding, 0))
    array = stored(array.select(*_DOC, "i", "places", "depths", "part", F.array(*[start(k) for k in range(1, depth + 1)]).alias("starts")), "intervals")
    last = {r[0]: r[1:] for r in array.groupBy("part").agg(*[F.max(F.get("starts", k)) for k in range(depth)]).collect()}
    carried, starts = [], [None] * depth
    for part in range(max(last, default=-1) + 1):
        carried.append(starts)
        starts = [b if b is not None else a for a, b in zip(starts, last.get(part, starts), strict=True)]
    within = array.select(*_DOC, "i", "places", "starts", "part", F.explode("depths").alias("depth"))
    begun = F.coalesce(F.get("starts", F.col("depth") - 1), F.get(F.get(constant(carried, "array<bigint>"), F.col("part")), F.col("depth") - 1))
    within = within.select(*_DOC, "i", "depth", begun.alias("interval"), F.slice("places", 1, F.col("depth")).alias("places"))
    place = F.struct("doc_id", "th", "i")
    firsts = within.groupBy("depth", "interval").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = within.join(stored(firsts, "firsts"), ["depth", "interval"]).where(place > F.col("first"))
    return later.select("dk", "th", "places")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, with the text less its later copies of runs; and n_lines, n_removed."""
    gone = repeated_lines(docs, min_words).groupBy(F.col("dk").alias("__dk"), F.col("th").alias("__th")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("__gone"))
    rows = docs.withColumns({"__dk": F.xxhash64("doc_id", "text"), "__th": F.xxhash64("text")}).join(gone, ["__dk", "__th"], "left")
    rows = rows.withColumn("__lines", F.split("text", "\n")).withColumn("__n", F.coalesce(F.size("__lines"), F.lit(0)))
    left = F.array_except(F.sequence(F.lit(0), F.col("__n") - 1), "__gone")
    rows = rows.withColumn("__left", F.when(F.col("__gone").isNotNull(), F.transform(left, lambda p: F.get("__lines", p))).otherwise(F.col("__lines")))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("__n")).cast("bigint")
    counts = {"n_lines": n, "n_removed": n - F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__left"))}
    counts["text"] = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n"))
    return rows.withColumns(counts).drop("__dk", "__th", "__gone", "__lines", "__n", "__left")
