"""Column functions of the retail model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "America/New_York"
NULL_MARK = "<NULL>"
UNKNOWN = "UNKNOWN"

#: Rules of refund tags, first match wins; more are data of the caller.
REFUND_RULES = [("%MISSING%", "Missing"), ("%WRONG ITEM%", "Wrong Item"), ("%WRONG ORDER%", "Wrong Order"), ("%DAMAGE%", "Shipping Damage"), ("%LOST%", "Lost In Transit"), ("%NOT RECEIVED%", "Not Received")]
WAREHOUSE = ["Missing", "Wrong Item", "Wrong Order"]
CARRIER = ["Shipping Damage", "Lost In Transit", "No Movement", "Not Received"]
#: Layers of lineage nodes by the start of the short name.
LAYERS = [("raw.", 0), ("silver.", 1), ("mart.", 2), ("metric.", 3), ("dash.", 4)]


def normalize_source(source: Column) -> Column:
    """Trimmed source; URL-encoded search sources and one mail tool get their one name."""
    name = F.trim(source)
    return F.when(name.rlike("(?i)^google%"), "google-ads").when(F.lower(name) == "emarsys", "Emarsys").otherwise(name)


def business_time(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, BUSINESS_ZONE)


def business_date_key(ts: Column) -> Column:
    """yyyyMMdd of the local day, daylight saving included."""
    return F.date_format(business_time(ts), "yyyyMMdd").cast("int")


def legacy_business_date(ts: Column) -> Column:
    """The day five hours behind UTC, all year."""
    return F.to_date(ts - F.expr("INTERVAL 5 HOURS"))


def product_path(url: Column) -> Column:
    """'/products/<handle>' of a path or URL, '' where there is none."""
    return F.regexp_extract(url, r"(/products/[^/?#]+)", 1)


def iso_day(day: Column) -> Column:
    return F.weekday(day) + 1


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def week_ending(day: Column) -> Column:
    """The Sunday of the ISO week."""
    return F.date_add(day, 7 - iso_day(day))


def period_index(month: Column, cohort: Column) -> Column:
    """Whole months between two month starts."""
    return (F.year(month) * 12 + F.month(month) - F.year(cohort) * 12 - F.month(cohort)).cast("int")


def refund_category(tags: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    out = F.lit("Other")
    for pattern, name in reversed(rules or REFUND_RULES):
        out = F.when(F.upper(tags).like(pattern), name).otherwise(out)
    return out


def responsibility(category: Column) -> Column:
    return F.when(category.isin(WAREHOUSE), "WAREHOUSE").when(category.isin(CARRIER), "SHIPPING CARRIER").otherwise("RETAILER")


def original_order(note: Column) -> Column:
    """The order number that a free-text note names, null where it names none."""
    return F.nullif(F.regexp_extract(note, r"(?i)(?:original|replacement for|order)\D{0,12}#?(\d{1,12})", 1), F.lit("")).cast("bigint")


def carrier_label(carrier: Column, kind: Column) -> Column:
    return F.concat_ws("-", carrier, kind)


def created_date(name: Column) -> Column:
    """The date in a shipment's name, in any of the formats that occur; null where there is none."""
    us = F.regexp_extract(name, r"(\d{2}/\d{2}/\d{4})", 1)
    iso = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.to_date(F.try_to_timestamp(us, F.lit("MM/dd/yyyy"))), F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))


def key_to_timestamp(key: Column) -> Column:
    """A yyyyMMdd key, date or time as a timestamp."""
    return F.coalesce(F.try_to_timestamp(key.cast("string"), F.lit("yyyyMMdd")), F.try_to_timestamp(key.cast("string")))


def short_name(full: Column) -> Column:
    """A table's name without its catalog."""
    return F.regexp_replace(full, r"^[^.]*\.(?=[^.]*\.)", "")


def layer(name: Column) -> Column:
    """0 raw, 1 silver, 2 mart, 3 metric, 4 dashboard; 2 for others."""
    out = F.lit(2)
    for start, number in reversed(LAYERS):
        out = F.when(name.startswith(start), number).otherwise(out)
    return out


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text; null differs from the empty text."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))
