"""Mixing sources to target weights by packing words into fixed-length blocks and drawing blocks by index.

Each source is one long stream of words: its documents in hash order, cut into blocks of BLOCK words. A source owns as
many slots as its target needs. Output shards have so many slots each, and a multinomial draw for each shard says how
many of them each source gets; draws beyond what a source owns go to those sources that the draws left short, so totals
are exact. Slot s of a source takes its block perm(s mod blocks), where perm is a keyed bijection, so a block comes at
most once per epoch, and the join of slots and blocks is by index. The last slot of a source is cut short, so that the
words taken meet the target exactly (after rounding to whole words).

Defined results: a null text has size 0, a null source is a source of its own (last in order), repeated rows are
separate documents, documents without words take 0, an empty table gives an empty result; a text of any length is as
many blocks as it needs; columns of any other names are kept as they are by take_mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.common import SPACE, stored, with_global_index, with_running_sum

BLOCK = 512
SLOTS_PER_SHARD = 1 << 15
LEAST_SHARDS = 16
#: Sources whose share of a shard is drawn in one task.
SOURCES = 1024
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def permute(at: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0..n-1 for each element, or its inverse: a Feistel network over the next even power of two, walked until inside."""
    at, n, seed = (np.asarray(x, dtype=np.uint64) for x in (at, n, seed))
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))) / 2)).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), at.copy(), np.ones(len(at), dtype=bool)

    def mixed(x: np.ndarray, key: np.ndarray, m: np.ndarray, turn: int) -> np.ndarray:
        x = x * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(turn * 0x632BE59B)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & m

    while todo.any():
        h, m, k = half[todo], mask[todo], seed[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in reversed(range(6)) if back else range(6):
            if back:
                left, right = right ^ mixed(left, k, m, turn), left
            else:
                left, right = right, left ^ mixed(right, k, m, turn)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo]
    return out


def targets(sources: DataFrame, total: float, key: str = "skey") -> DataFrame:
    """Adds target: weights share the total, each source stops at MOST times its size, and the excess is shared again."""
    table = stored(sources.withColumn("capped", F.col("size") <= 0), "sources")
    while True:
        left = table.agg(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.sum(F.when(F.col("capped"), F.lit(float(MOST)) * F.col("size")))).first()
        level = (total - (left[1] or 0.0)) / left[0] if left[0] else 0.0
        above = ~F.col("capped") & (F.lit(level) * F.col("weight") > F.lit(float(MOST)) * F.col("size"))
        if not left[0] or not table.where(above).limit(1).count():
            break
        table = stored(table.withColumn("capped", F.col("capped") | above), "sources")
    return table.withColumn("target", F.when(F.col("capped"), F.lit(float(MOST)) * F.col("size")).otherwise(F.lit(level) * F.col("weight"))).drop("capped")


def _owned(seed: int, block: int):
    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                if r.size <= 0 or r.target <= 0:
                    continue
                want, blocks = round(r.target), -(-r.size // block)
                key = (r.source_id * 0x9E3779B97F4A7C15 + seed) % (1 << 64)
                epochs, rest = divmod(want, r.size)
                short, last, slots = r.size - (blocks - 1) * block, block, epochs * blocks
                if rest:
                    # the rank at which the permutation reaches the short block decides where the words run out
                    rank = int(permute(np.array([blocks - 1]), np.array([blocks]), np.array([key], dtype=np.uint64), back=True)[0])
                    if rest <= rank * block:
                        full, last = divmod(rest, block)
                    elif rest <= rank * block + short:
                        full, last = rank, rest - rank * block
                    else:
                        full, last = divmod(rest + block - short, block)
                    slots += full + (last > 0)
                    last = last or block
                yield pd.DataFrame({"source_id": [r.source_id], "blocks": [blocks], "key": np.array([key], dtype=np.uint64).view(np.int64), "slots": [slots], "last": [last]})

    return plan


def _shares(seed: int, size: int, total: int, of: list[int]):
    """How many of each shard's slots each group of sources gets."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chances = np.array(of) / total
        for pdf in batches:
            for shard in pdf["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(min(size, total - int(shard) * size), chances)
                yield pd.DataFrame({"shard": shard, "group": np.flatnonzero(n), "n": n[n > 0]})

    return draw


def _within(seed: int):
    """How many slots of a shard each source of the group gets."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, slots = (np.array([x[c] for x in r.members]) for c in ("source_id", "slots"))
                n = np.random.default_rng([seed, int(r.shard), int(r.group)]).multinomial(int(r.n), slots / slots.sum())
                yield pd.DataFrame({"shard": r.shard, "source_id": ids[n > 0], "n": n[n > 0]})

    return draw


def deal(owned: DataFrame, seed: int) -> DataFrame:
    """source_id, slot and shard of each slot that the sources own: a multinomial draw for each shard, settled to exact totals."""
    spark = owned.sparkSession
    group = F.floor(F.col("source_id") / SOURCES).cast("bigint").alias("group")
    members = F.sort_array(F.collect_list(F.struct("source_id", "slots"))).alias("members")
    groups = stored(owned.groupBy(group).agg(F.sum("slots").alias("all"), members), "groups")
    of = dict(groups.select("group", "all").collect())  # a number for SOURCES sources each
    total = sum(of.values())
    size = max(1, min(SLOTS_PER_SHARD, -(-total // LEAST_SHARDS)))
    chances = [of.get(k, 0) for k in range(max(of, default=-1) + 1)]
    # written, so that a task has one Python worker at a time
    drawn = stored(spark.range(-(-total // size)).mapInPandas(_shares(seed, size, total, chances), "shard bigint, group bigint, n bigint"), "shares")
    drawn = drawn.join(groups.select("group", "members"), "group").mapInPandas(_within(seed), "shard bigint, source_id bigint, n bigint")
    drawn = stored(with_running_sum(stored(drawn, "drawn"), [F.col("source_id"), F.col("shard")], "n", "at"), "running")
    per_source = stored(drawn.groupBy("source_id").agg(F.min("at").alias("begin"), F.sum("n").alias("drawn")), "per-source")
    kept = drawn.join(per_source, "source_id").join(owned.select("source_id", "slots"), "source_id")
    kept = kept.withColumn("first", F.col("at") - F.col("begin")).withColumn("fit", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("first"))))
    kept = stored(kept.select("source_id", "shard", "first", "fit", (F.col("n") - F.col("fit")).alias("over")), "kept")
    numbers = lambda low, high: F.explode(F.sequence(F.col(low) if isinstance(low, str) else low, high))
    own = kept.where("fit > 0").repartition("source_id", "shard").select("source_id", "shard", numbers("first", F.col("first") + F.col("fit") - 1).alias("slot"))
    free = kept.where("over > 0").select("shard", "source_id", numbers(F.lit(1).cast("bigint"), F.col("over")).alias("k"))
    free = with_global_index(free, [F.col("shard"), F.col("source_id"), F.col("k")], "n").select("n", F.col("shard").cast("bigint"))
    short = owned.join(per_source.select("source_id", "drawn"), "source_id", "left").select("source_id", F.coalesce("drawn", F.lit(0)).alias("drawn"), "slots").where("drawn < slots")
    short = short.select("source_id", numbers("drawn", F.col("slots") - 1).alias("slot"))
    short = with_global_index(short, [F.col("source_id"), F.col("slot")], "n")
    return own.unionByName(short.join(free, "n").select("source_id", "shard", "slot"))


@F.pandas_udf(T.LongType())
def _block_of(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    n = blocks.to_numpy()
    return pd.Series(permute(slot.to_numpy() % n, n, key.to_numpy().view(np.uint64)).astype(np.int64))


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE[1:-1]}]+")), F.lit(0)).cast("bigint")


def row_key(docs: DataFrame) -> dict:
    """Columns that tell rows apart: id, text, source, and a number for rows that are equal in all of these."""
    return {"skey": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col("source"))), "th": F.xxhash64("text")}


def equal_rows():
    return Window.partitionBy("doc_id", "th", "skey").orderBy("skey")


def source_targets(rows: DataFrame) -> DataFrame:
    """skey, source, source_id (by code point, null last), weight, size and target of each source of rows with skey, source, size."""
    per_source = rows.groupBy("skey").agg(F.sum("size").alias("size"), F.first("source").alias("source"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("source_id"), F.lit(len(WEIGHTS))).cast("int"))
    numbered = with_global_index(per_source, [F.col("source").asc_nulls_last()], "source_id").withColumn("weight", weight)
    total = numbered.agg(F.sum("size")).first()[0] or 0
    return stored(targets(numbered, SHARE * total), "targets")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, skey, th, source and size (words) of each document."""
    return docs.withColumns(row_key(docs)).select("doc_id", "skey", "th", "source", word_count().alias("size"))


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sources, pieces): pieces has a row for each run of a document's words that a slot takes (epoch, shard, slot, from, to),
    and one with nulls for a document of which nothing is taken. Columns doc_id, th, skey, rep, size tell documents apart."""
    rows = stored(sizes(docs), "sizes").withColumn("rep", F.row_number().over(equal_rows()))
    sources = source_targets(rows)
    owned = stored(sources.select("source_id", "size", "target").mapInPandas(_owned(seed, block), "source_id bigint, blocks bigint, key bigint, slots bigint, last bigint"), "owned")
    # tables of their own, so that Spark knows how large they are when it chooses a join
    dealt = stored(deal(owned.select("source_id", "slots"), seed), "dealt").join(owned, "source_id")
    slots = dealt.select("source_id", "shard", "slot", _block_of("slot", "blocks", "key").alias("block"), F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("epoch"), F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(F.lit(block)).alias("cut"))
    slots = stored(slots, "slots")
    order = [F.col("skey"), F.xxhash64("doc_id", "th", F.lit(seed)), F.col("doc_id"), F.col("th"), F.col("rep")]
    placed = stored(with_running_sum(rows, order, "size", "at"), "placed")
    begins = placed.groupBy("skey").agg(F.min("at").alias("begin"))
    begins = stored(begins.join(sources.select("skey", "source_id"), "skey"), "begins")
    placed = placed.join(begins, "skey").withColumn("start", F.col("at") - F.col("begin"))
    low, high = F.col("start"), F.col("start") + F.col("size")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(low / block), F.floor((high - 1) / block)))
    pieces = placed.select("doc_id", "th", "skey", "rep", "size", "source_id", "start", F.explode_outer(spans).alias("block"))
    at = F.greatest(low, F.col("block") * block)
    pieces = pieces.withColumns({"at": at - F.col("block") * block, "from": at - low, "to": F.least(high, (F.col("block") + 1) * block) - low})
    taken = pieces.join(slots, ["source_id", "block"], "left")
    to = F.least(F.col("to"), F.col("from") + F.greatest(F.lit(0), F.col("cut") - F.col("at")))
    return sources, taken.select("doc_id", "th", "skey", "rep", "size", "epoch", "shard", "slot", "from", F.coalesce(to, F.col("from")).alias("to"))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    sources, pieces = mix(docs, seed)
    per_doc = pieces.groupBy("doc_id", "th", "skey", "rep", "size").agg(F.coalesce(F.sum(F.col("to") - F.col("from")), F.lit(0)).alias("taken"))
    named = sources.select("skey", F.col("size").alias("source_size"), "target")
    return per_doc.join(named, "skey").select("doc_id", "size", "source_size", "target", "taken")


def _joined(spans):
    """Spans (from, to) in order, with those that meet made one."""
    none = F.array().cast("array<struct<from: bigint, to: bigint>>")

    def add(found, s):
        last = F.get(found, F.size(found) - 1)
        longer = F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.struct(last["from"].alias("from"), s["to"].alias("to"))))
        return F.when(last["to"] == s["from"], longer).otherwise(F.concat(found, F.array(F.struct(s["from"].alias("from"), s["to"].alias("to")))))

    return F.aggregate(spans, none, add)


def take_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The columns of docs, a row for each run of a document's words that the mix takes in an epoch, with those words as text.

    The text is unchanged where all its words are taken; a part has its words joined by blanks. n_chars, if there, follows.
    """
    _, pieces = mix(docs, seed)
    key = ["doc_id", "th", "skey", "rep"]
    spans = pieces.where("to > from").groupBy(*key, "epoch").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("__spans"), F.first("size").alias("__size"))
    spans = spans.select(*[F.col(c).alias(f"__{c}") for c in key], F.explode(_joined(F.col("__spans"))).alias("__span"), "__size")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", *[c.alias(n) for n, c in row_key(docs).items()])
    rows = rows.withColumn("rep", F.row_number().over(equal_rows()))
    same = F.col("rep") == F.col("__rep")
    for c in key[:3]:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    rows = rows.join(spans, same).withColumn("__words", F.array_remove(F.split("text", f"{SPACE}+"), ""))
    low, n = F.col("__span.from"), F.col("__span.to") - F.col("__span.from")
    part = F.array_join(F.slice("__words", (low + 1).cast("int"), n.cast("int")), " ")
    rows = rows.withColumn("text", F.when(n == F.col("__size"), F.col("text")).otherwise(part))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return rows.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"__row.`{f.name}`") for f in docs.schema])
