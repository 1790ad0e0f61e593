"""Language identification by compression: the language whose text, as a raw-content dictionary, makes a text smallest.

Texts are compressed in lower case and in pieces, so that a long text doesn't become its own dictionary; all pieces count. The score is
the share by which the winner beats the next language, from 0 to 1; below MARGIN the decision counts as rejected.

Dictionaries come from a bounded sample of the labelled rows that are not held out: of each language the DOCS rows of
the smallest hashes, with TAKE characters of each, of which the first DICTIONARY bytes in order of doc_id are used, or an
equal part of ALL bytes where there are very many languages. Predictions read whole texts.

Defined results: a null text, or one without a letter, is 'und' with score 0; a null id is neither learned from nor
held out; with one learned language every other text gets it with score 1, with none it is 'und'; repeated rows get
equal results; of languages of equal size the first by name wins; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import stored

DOCS = 96
TAKE = 4096
DICTIONARY = 1 << 17
ALL = 1 << 26
PIECE = 4096
LEVEL = 6
MARGIN = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw text of each language from rows that are not held out; at most DICTIONARY bytes each reach the driver."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    usable = usable.select("doc_id", "lang", F.xxhash64("text").alias("th"), "text")
    key = ["lang", "doc_id", "th"]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    # the limit on row_number is pushed below the shuffle, so each task sends DOCS rows a language at most
    chosen = usable.select(*key).withColumn("n", F.row_number().over(order)).where(F.col("n") <= DOCS).select(*key).distinct()
    chosen = stored(chosen, "chosen")
    most = min(DICTIONARY, ALL // max(1, chosen.select("lang").distinct().count()))
    each = min(TAKE, most)
    # rows equal in language, id and text are one
    texts = usable.join(chosen, key).groupBy(*key).agg(F.first(F.substring("text", 1, each)).alias("text"))
    joined = texts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("doc_id", "th", "text"))).alias("x"))
    joined = joined.select("lang", F.lower(F.array_join(F.transform("x", lambda x: x["text"]), "\n")).alias("raw"))
    joined = joined.select("lang", F.substring("raw", 1, most).alias("raw"))
    return {r["lang"]: r["raw"].lower().encode("utf-8", "replace")[:most] for r in joined.orderBy("lang").collect()}


def _classify(learned):
    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = {}
        for lang, raw in learned.value.items():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            packs[lang] = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False)

        def one(text: str | None) -> tuple[str, float]:
            if not packs or not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0
            raw = text.lower().encode("utf-8", "replace")
            pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
            sizes = sorted((sum(len(pack.compress(x)) for x in pieces), lang) for lang, pack in packs.items())
            return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0

        for batch in batches:
            found = [one(x.as_py()) for x in batch["text"]]
            arrays = [batch["doc_id"], batch["held_out"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return classify


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred (the nearest language), score, and rejected: the margin is too narrow to rely on."""
    learned = docs.sparkSession.sparkContext.broadcast(dictionaries(docs))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = rows.mapInArrow(_classify(learned), "doc_id bigint, held_out boolean, lang_pred string, score double")
    return found.withColumn("rejected", F.col("score") < MARGIN)
