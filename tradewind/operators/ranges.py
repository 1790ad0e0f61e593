"""Order within keys without one task a key: rows are dealt to ranges of (key, order), and what a key brings over a border is carried.

Bounds are quantiles of a sample, so a key with very many rows goes over many ranges and small keys share one. Ranges are
dealt by number, each to a task of its own, and windows inside a range need no other exchange. Only keys that a border cuts
bring anything along, at most one a range: their totals are gathered, a row for each range at most.

Order columns are strings, numbers, dates or times. Rows equal in all order columns can't be told apart by a border; give
enough columns to tell them apart where many may be equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__part"
#: Sampled rows for each range.
SAMPLED = 100


def _comparable(df: DataFrame, columns: list[str]) -> list[Column]:
    """Times as microseconds and dates as days, so that bounds are plain numbers and texts; nulls come first everywhere."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    as_number = {"timestamp": F.unix_micros, "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp")), "date": F.unix_date}
    return [as_number.get(kinds[c], lambda x: x)(F.col(c)) for c in columns]


def _below(values: list, at: list[Column]) -> Column:
    """Whether the bound lies at or before the row, compared column by column, nulls first."""
    out = F.lit(True)  # equal in all columns
    for value, c in reversed(list(zip(values, at, strict=True))):
        if value is None:
            out = F.when(c.isNull(), out).otherwise(True)
        else:
            out = F.coalesce(F.when(c == F.lit(value), out).otherwise(c > F.lit(value)), F.lit(False))
    return out


def _number(bounds: list[tuple], at: list[Column], low: int = 0) -> Column:
    """How many bounds lie at or before the row: a tree of comparisons, as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(_below(bounds[mid], at), _number(bounds[mid + 1 :], at, low + mid + 1)).otherwise(_number(bounds[:mid], at, low))


@dataclass
class Ranges:
    """rows: the table with its range in __part, dealt by it; bounds: the lowest values of all ranges but the first."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    bounds: list[tuple]

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def cut_keys(self) -> list[tuple]:
        """Values of the keys in which borders lie."""
        return sorted({b[: len(self.keys)] for b in self.bounds}, key=repr)

    def of_cut_keys(self) -> DataFrame:
        """Rows of the keys that borders cut, not dealt anew."""
        at = _comparable(self.rows, self.keys)
        same = lambda values: reduce(and_, [c.isNull() if v is None else c == F.lit(v) for v, c in zip(values, at, strict=True)], F.lit(True))
        if len(self.keys) == 1 and self.bounds:
            values = [v for (v,) in self.cut_keys()]
            some = at[0].isin([v for v in values if v is not None])
            return self.undealt.where(some | at[0].isNull() if None in values else some)
        return self.undealt.where(reduce(lambda a, b: a | b, map(same, self.cut_keys()), F.lit(False)))

    undealt: DataFrame = None

    def window(self):
        """Of a key's rows inside a range, in order."""
        return Window.partitionBy(PART, *self.keys).orderBy(*self.order)

    def carried(self, totals: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
        """__part and, for the key whose rows a range continues, what merge makes of its totals in all ranges before: a row a range at most."""
        before = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        sums = self.of_cut_keys().groupBy(PART, *self.keys).agg(*[c.alias(n) for n, c in totals.items()])
        out = sums.withColumns({n: c.over(before) for n, c in merge.items()}).withColumn("__again", F.count(F.lit(1)).over(before) > 0)
        return out.where("__again").select(F.col(PART).alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in self.keys], *[F.col(n).alias(f"__before_{n}") for n in merge])

    def with_carried(self, df: DataFrame, totals: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
        """df, rows of these ranges, with __before_{name} of each total; null where the key begins in the range."""
        if not self.bounds:
            return df.withColumns({f"__before_{n}": F.lit(None) for n in merge})
        over = self.carried(totals, merge)
        on = [F.col(PART) == F.col("__p"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in self.keys]]
        # bounded: a row for each range, so its size is known to be small
        return df.join(F.broadcast(over), reduce(and_, on), "left").drop("__p", *[f"__k_{k}" for k in self.keys])


def cut(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> Ranges:
    """df in as many ranges of (keys, order) as there are shuffle partitions, of about equal numbers of rows."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _comparable(df, [*keys, *order])
    names = [f"c{k}" for k in range(len(at))]
    drawn = df.select(*[c.alias(n) for c, n in zip(at, names, strict=True)])
    drawn = drawn.withColumn("h", F.xxhash64(*names, F.monotonically_increasing_id())).orderBy("h").limit(parts * SAMPLED).drop("h")
    sample = sorted((tuple(r) for r in drawn.collect()), key=lambda r: [(v is not None, v) for v in r])
    bounds = []
    for k in range(1, parts):
        bound = sample[k * len(sample) // parts] if sample else None
        if bound is not None and bound != (bounds[-1] if bounds else sample[0]):
            bounds.append(bound)
    ranged = df.withColumn(PART, _number(bounds, at))
    return Ranges(ranged.repartitionById(len(bounds) + 1, F.col(PART)), keys, order, bounds, ranged)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, first: dict[str, str] | None = None) -> DataFrame:
    """Adds the place of each row within its key, from 1, as bigint; first: new columns with the least value of a column over the key.

    First values are those of the key's first row if the column never falls in the order, as a month doesn't in that of its time.
    """
    r = cut(df, keys, order)
    first = first or {}
    whole = Window.partitionBy(PART, *keys)
    rows = r.rows.withColumns({name: F.row_number().over(r.window()).cast("bigint"), **{n: F.min(c).over(whole) for n, c in first.items()}})
    totals = {"n": F.count(F.lit(1)), **{n: F.min(c) for n, c in first.items()}}
    rows = r.with_carried(rows, totals, {"n": F.sum("n"), **{n: F.min(n) for n in first}})
    rows = rows.withColumns({name: F.col(name) + F.coalesce("__before_n", F.lit(0)), **{n: F.least(n, f"__before_{n}") for n in first}})
    return rows.drop(PART, "__before_n", *[f"__before_{n}" for n in first])


def numbered_whole(df: DataFrame, order: list[str], name: str, above: int | Column = 0) -> DataFrame:
    """Adds the place of each row in the whole order, from above + 1, as bigint; the ranges' counts are the offsets."""
    r = cut(df, [], order)
    counts = dict(r.undealt.groupBy(PART).count().collect()) if r.bounds else {}
    starts = [sum(counts.get(p, 0) for p in range(k)) for k in range(r.parts)]
    here = F.row_number().over(Window.partitionBy(PART).orderBy(*order)).cast("bigint")
    offset = F.get(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col(PART))
    return r.rows.withColumn(name, here + offset + above).drop(PART)
