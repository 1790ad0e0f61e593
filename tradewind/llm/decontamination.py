"""Benchmark decontamination by templates: windows of words in which numbers, names and units are typed placeholders.

Documents' windows meet the benchmark's in a hash join on the whole template. Along each alignment of a document with an
item, the placeholders' values should correspond one to one: a re-parameterised question replaces a value by one other
value everywhere. A document is contaminated by an item when SHARE of the item's windows match along such
alignments, or when OWN_SHARE of them do or have the item's own values, whatever the other windows have: a copy with one value
altered, or with two values for what happened to be equal. Windows with other values count along a consistent alignment only.

There are three templates of a window. COPIED has the words as they are, without regard to case, so every window of an
item can be copied. In PLACED a capitalised word that begins a sentence is a word, in FREE it is a name wherever it
stands, unless it is one of STARTERS; so what stands before a copy, or a name that begins it, doesn't matter: either one
of a document may meet either one of an item. These two are searched where they have LITERALS plain words: shares are of all windows, or of these for matches of templates
alone. RUN copied words in a row are enough whatever the share.

Windows travel as two 64-bit hashes with the hashes of their values, never as text. Up to BENCHMARK_WINDOWS different
templates of benchmark windows go to the tasks as a filter, so that only likely windows are shuffled; above that, all
windows are shuffled to the join. Results are the same.

Defined results: null texts have no windows; items shorter than a window are searched whole, those of fewer than LEAST
words only where they stand between punctuation, one word only as a sentence; repeated rows and ids count as one document; items or documents
that are empty tables give an empty result; other columns don't matter; very long texts are one row of a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import stored

WINDOW = 8
LEAST = 5
LITERALS = 3
SHARE = 0.3
OWN_SHARE = 0.5
RUN = 13
BENCHMARK_WINDOWS = 1 << 20
#: Tokens and windows that a task handles at a time.
CHUNK = 1 << 18
TOKEN = re.compile(r"""[^\W_]+|[.!?\n]|[$€£%]|[:;,"()\[\]“”«»–—]""")
COPIED, PLACED, FREE = 0, 1, 2
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Words and signs of measure; they are units next to a number only.
UNITS = frozenset("% $ € £ percent dollar dollars euro euros cent cents pound pounds mm cm m km kg g mg lb lbs oz ml l liter liters litre litres meter meters metre metres mile miles foot feet inch inches yard yards second seconds minute minutes hour hours day days week weeks month months year years".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
#: Words that begin sentences and questions; they are no names however they are written.
STARTERS = frozenset("a after all an and are as at before both but by can compute could did do does each every explain find for from give given had has have he how i if in is it its let list many more most name no of on or she should solve some suppose that the their there these they this those to was we were what when where which who whom whose why will with would write you".split())
_SIGNS = frozenset("$€£%")
_STOPS = frozenset(".!?\n")
_PAUSES = frozenset(':;,"()[]“”«»–—')


def _kind(token: str) -> int:
    """0 word, 1 capitalised, 2 number, 3 unit, 4 sign, 5 end of a sentence, 6 capitalised starter, 7 other punctuation."""
    if token in _STOPS:
        return 5
    if token in _PAUSES:
        return 7
    if token in _SIGNS:
        return 4
    low = token.lower()
    if token[0].isdigit() or low in NUMBERS:
        return 2
    if low in UNITS:
        return 3
    if len(token) > 1 and token[0].isupper() and (token[1:].islower() or token.isalpha() and token.isupper()):
        return 6 if low in STARTERS else 1
    return 0


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


class _Known(dict):
    """Places of tokens in the arrays of their hashes and kinds; a new token is added when it is asked for."""

    def __init__(self) -> None:
        self.hashes, self.kinds = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint8)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.kinds):
            self.hashes, self.kinds = np.concatenate([self.hashes] * 2), np.concatenate([self.kinds] * 2)
        self.hashes[at], self.kinds[at] = _hash(token.casefold()), _kind(token)
        self[token] = at
        return at


class Words:
    """The words of some texts in a row: text each is of, whether it begins or ends a sentence, and by template its kind
    (0 word, 1 name, 2 number, 3 unit) and the hash of what stands for it."""

    def __init__(self, texts: list[str], known: _Known) -> None:
        tokens, ends = [], []
        for text in texts:
            tokens += TOKEN.findall(text)
            ends.append(len(tokens))
        places = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        kinds, plain = known.kinds[places], known.hashes[places]
        text = np.repeat(np.arange(len(texts)), np.diff(np.array([0, *ends])))
        words = kinds != 7
        opens, closes = np.zeros(len(kinds), dtype=bool), np.zeros(len(kinds), dtype=bool)
        opens[1:], closes[:-1] = ~words[:-1], ~words[1:]
        kinds, plain, text, opens, closes = kinds[words], plain[words], text[words], opens[words], closes[words]
        border = np.ones(len(kinds) + 1, dtype=bool)  # between two tokens
        border[1:-1] = text[1:] != text[:-1]
        stop, number = kinds == 5, kinds == 2
        begins, ended, beside = border[:-1].copy(), border[1:].copy(), np.zeros(len(kinds), dtype=bool)
        begins[1:] |= stop[:-1]
        ended[:-1] |= stop[1:]
        beside[1:] |= number[:-1] & ~border[1:-1]
        beside[:-1] |= number[1:] & ~border[1:-1]
        kinds = np.where(((kinds == 3) | (kinds == 4)) & beside, 3, np.where(kinds == 3, 0, kinds))
        keep = kinds != 5
        keep &= kinds != 4
        self.opens, self.closes = (begins | opens)[keep], (ended | closes)[keep]
        kinds, self.plain, self.text, self.begins, self.ended = kinds[keep], plain[keep], text[keep], begins[keep], ended[keep]
        free = np.where(kinds == 6, 0, kinds)
        placed = np.where((kinds == 1) & self.begins | (kinds == 6) & self.begins, 0, np.where(kinds == 6, 1, kinds))
        self.kinds = {COPIED: kinds, PLACED: placed, FREE: free}
        self.hashes = {COPIED: self.plain}
        for mode in (PLACED, FREE):
            self.hashes[mode] = self.plain.copy()
            for kind, name in ((1, NAME), (2, NUMBER), (3, UNIT)):
                self.hashes[mode][self.kinds[mode] == kind] = np.uint64(_hash(name))

    def windows(self, mode: int, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Polynomial hashes of all windows of so many words, those over the border of two texts too."""
        hashes = self.hashes[mode]
        out, n = np.zeros(len(hashes), dtype=np.uint64), len(hashes)
        for width in range(1, min(max(widths, default=0), n) + 1):
            out = out[: n - width + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[width - 1 :]
            if width in widths:
                yield width, out

    def searched(self, mode: int, width: int, at: np.ndarray) -> np.ndarray:
        """Those of the windows that are searched: inside a text, short ones as a sentence, templates with enough words."""
        last = at + width - 1
        fit = self.text[at] == self.text[last]
        if mode != COPIED:
            plain = np.concatenate([[0], np.cumsum(self.kinds[mode] == 0)])
            fit &= (plain[last + 1] - plain[at] >= LITERALS) & (width >= LEAST)
        if mode == FREE:
            differ = np.concatenate([[0], np.cumsum(self.hashes[FREE] != self.hashes[PLACED])])
            fit &= differ[last + 1] > differ[at]
        if width == 1:
            fit &= self.begins[at] & self.ended[last]
        elif width < LEAST:
            fit &= self.opens[at] & self.closes[last]
        return at[fit]

    def rows(self, mode: int, width: int, at: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
        """mode, width, place in the text, two hashes, and the hashes of the placeholders' values, by window."""
        inside = at[:, None] + np.arange(width)
        second = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = self.hashes[mode][inside[:, k]]
            second = second * np.uint64(0xC2B2AE3D27D4EB4F) + (h ^ (h >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        slot = (self.kinds[mode][inside] > 0) & (mode != COPIED)
        offsets = np.concatenate([[0], np.cumsum(slot.sum(axis=1))]).astype(np.int32)
        slots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.plain[inside][slot].view(np.int64)))
        place = at - np.searchsorted(self.text, self.text[at])
        same = lambda x: pa.array(np.full(len(at), x, np.int32))
        return [same(mode), same(width), pa.array(place), pa.array(hashes.view(np.int64)), pa.array(second.view(np.int64)), slots]


FIELDS = ["mode", "width", "at", "h1", "h2", "slots"]
WINDOWS = "id bigint, th bigint, mode int, width int, at bigint, h1 bigint, h2 bigint, slots array<bigint>"
ITEMS = WINDOWS + ", n bigint, searchable bigint, has_words boolean"


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item: of WINDOW words, or the whole item if it is shorter; with how many it has, how many of
    them templates can match, and whether LITERALS of the words are no numbers."""
    known = _Known()
    for batch in batches:
        for key, th, text in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["text"], strict=True):
            words = Words([text.as_py() or ""], known)
            width = min(WINDOW, len(words.text))
            if not width:
                continue
            found, n = [], len(words.text) - width + 1
            for mode in (COPIED, PLACED, FREE):
                hashes = dict(words.windows(mode, [width]))[width]
                at = words.searched(mode, width, np.arange(n))
                if len(at):
                    found.append((at, words.rows(mode, width, at, hashes[at])))
            searchable = len(set().union(*[at.tolist() for at, x in found if x[0][0].as_py() != COPIED]))
            numbers = np.concatenate([[0], np.cumsum(words.kinds[COPIED] == 2)])
            for at, columns in found:
                has_words = width - (numbers[at + width] - numbers[at]) >= LITERALS
                same = lambda x: pa.array([x] * len(at), pa.int64())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([same(key), same(th), *columns, same(n), same(searchable), pa.array(has_words)], ["id", "th", *FIELDS, "n", "searchable", "has_words"])


def _document_windows(widths: list[int], wanted):
    """Windows of the given widths that are searched; of those in wanted only, where it is given."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, filters = _Known(), {}
        for key, values in (wanted.value if wanted is not None else {}).items():
            table = np.zeros(1 << 20, dtype=bool)
            table[values >> np.uint64(44)] = True
            filters[key] = (table, values)

        def likely(mode: int, width: int, hashes: np.ndarray) -> np.ndarray:
            if wanted is None:
                return np.arange(len(hashes))
            if (min(mode, PLACED), width) not in filters:
                return np.arange(0)
            table, values = filters[min(mode, PLACED), width]
            at = np.flatnonzero(table[hashes >> np.uint64(44)])
            near = np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)
            return at[values[near] == hashes[at]]

        def found(ids: list, ths: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal known
            if len(known) > CHUNK // 2:
                known = _Known()
            words, ids, ths = Words(texts, known), np.array([x or 0 for x in ids], np.int64), np.array(ths, np.int64)
            none = np.array([x is None for x in ids])
            for mode in (COPIED, PLACED, FREE):
                for width, hashes in words.windows(mode, widths):
                    at = words.searched(mode, width, likely(mode, width, hashes))
                    for part in np.split(at, range(CHUNK, len(at), CHUNK)) if len(at) else []:
                        of = words.text[part]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[of], mask=none[of]), pa.array(ths[of]), *words.rows(mode, width, part, hashes[part])], ["id", "th", *FIELDS])

        for batch in batches:
            keys, ths, texts, held = [], [], [], 0
            for key, th, text in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["text"], strict=True):
                keys.append(key), ths.append(th), texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > 4 * CHUNK:
                    yield from found(keys, ths, texts)
                    keys, ths, texts, held = [], [], [], 0
            yield from found(keys, ths, texts)

    return cut


def find_leaks(docs: DataFrame, benchmark: DataFrame, limit: int = BENCHMARK_WINDOWS) -> DataFrame:
    """doc_id, th (hash of the text), item_id, windows (matched of the item), item_windows, and changed: some placeholder's
    value differs. A row for each contaminated document and item."""
    text = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    items = stored(items.mapInArrow(_item_windows, ITEMS), "item-windows")
    template = (F.col("mode") != COPIED).cast("int").alias("template")
    templates = items.select(template, "width", "h1").distinct()
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    wanted = None
    if templates.count() <= limit:
        found: dict[tuple[int, int], list[int]] = {}
        for r in templates.collect():
            found.setdefault((r[0], r[1]), []).append(r[2] % (1 << 64))
        wanted = spark.sparkContext.broadcast({k: np.unique(np.array(x, np.uint64)) for k, x in found.items()})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    windows = rows.mapInArrow(_document_windows(widths, wanted), WINDOWS)
    key = ["template", "width", "h1", "h2"]
    own = items.select(template, *key[1:], F.col("mode").alias("item_mode"), F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n").alias("item_windows"), "searchable", "has_words", F.col("slots").alias("item_slots"))
    hits = windows.select(F.col("id").alias("doc_id"), "th", template, *key[1:], "mode", "at", "slots").join(own, key)
    hits = hits.withColumns({"shift": F.col("at") - F.col("item_at"), "copied": F.col("template") == 0, "free": F.greatest("mode", "item_mode") == FREE})
    hits = stored(hits.drop("template", "mode", "item_mode", "h1", "h2"), "hits")
    # windows of the template PLACED are held against each other only, those of FREE against all
    line = ["doc_id", "th", "item_id", "shift", "free"]
    all_hits = hits.where("not free").unionByName(hits.withColumn("free", F.lit(True)))
    pairs = all_hits.select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select(*line, F.col("x.item_slots").alias("was"), F.col("x.slots").alias("is")).distinct()
    along = pairs.groupBy(*line).agg(F.count("*").alias("n"), F.countDistinct("was").alias("a"), F.countDistinct("is").alias("b"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in line]
    joined = hits.alias("h").join(along.alias("b"), same({c: F.col(f"h.{c}") for c in line}, {c: F.col(f"b.{c}") for c in line}), "left")
    distinct = lambda c: F.size(F.array_distinct(c))
    own = distinct(F.arrays_zip("item_slots", "slots"))
    joined = joined.where((own == distinct("item_slots")) & (own == distinct("slots")))
    joined = joined.withColumns({"whole": F.coalesce(F.expr("b.n = b.a and b.n = b.b"), F.lit(True)), "differs": F.col("item_slots") != F.col("slots")})
    joined, line = stored(joined.select("h.*", "whole", "differs"), "matches"), line[:4]
    copies = joined.where("copied and has_words").select(*line, "width", "item_at").distinct()
    row = F.row_number().over(Window.partitionBy(*line, "width").orderBy("item_at"))
    runs = copies.withColumn("start", F.col("item_at") - row).groupBy(*line, "width", "start").agg(F.count("*").alias("n"))
    runs = runs.where(F.col("n") + F.col("width") > RUN).select("doc_id", "th", "item_id", F.lit(True).alias("run")).distinct()
    windows = lambda where: F.countDistinct(F.when(where, F.col("item_at")))
    template, counted = ~F.col("copied"), F.col("whole") | ~F.col("differs")
    sums = {"windows": windows(counted), "own_t": windows(template & counted), "whole": windows(F.col("whole")), "whole_t": windows(F.col("whole") & template)}
    sums |= {"item_windows": F.max("item_windows"), "searchable": F.max(F.when(template, F.col("searchable"))), "changed": F.max("differs")}
    found = joined.groupBy("doc_id", "th", "item_id").agg(*[v.alias(k) for k, v in sums.items()])
    enough = lambda share, of: F.greatest(F.lit(1), F.ceil(share * F.col(of)))
    some = (F.col("whole") >= enough(SHARE, "item_windows")) | (F.col("windows") >= enough(OWN_SHARE, "item_windows"))
    some |= (F.col("whole_t") >= enough(SHARE, "searchable")) | (F.col("own_t") >= enough(OWN_SHARE, "searchable"))
    key = ["doc_id", "th", "item_id"]
    found = found.alias("f").join(runs.alias("r"), [F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key], "left")
    leak = F.coalesce(some, F.lit(False)) | F.col("run").isNotNull()
    return found.where(leak).select(*[f"f.{c}" for c in (*key, "windows", "item_windows", "changed")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates."""
    leaks = stored(find_leaks(docs, benchmark).select(F.col("th").alias("__leak")).distinct(), "leaks")
    return docs.join(leaks, F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__leak"), "left_anti")
