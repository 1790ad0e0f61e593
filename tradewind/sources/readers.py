"""Batch and stream readers, schema detection, raw landing and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions import scalars as S

CANONICAL = ["sku", "vend_id", "item_description", "season", "group_name", "gender", "class_name", "master_style", "cost", "retail"]
#: Headers of the product master by version, in the order of CANONICAL; the first two tell the version.
HEADERS = {
    "current": ["SKU", "Style#", "Item Description", "Season", "Group", "Gender", "Class", "Master Style", "Cost", "Retail"],
    "legacy": ["Unique_Identifier", "Vend_ID", "Item_Description", "Season", "Group", "Gender", "Class", "Master_Style", "Cost", "Retail"],
}
#: key, source, group, paid, of the ad vendor itself. Key 0 is the unknown member.
CHANNELS = [
    (0, "Unknown", "Unknown", False, False), (1, "facebook-ads", "Paid Social", True, False), (2, "google-ads", "Paid Search", True, False), (3, "bing", "Paid Search", True, False),
    (4, "pinterest-ads", "Paid Social", True, False), (5, "impact", "Affiliate", False, False), (6, "influencers", "Influencer", False, False), (7, "Emarsys", "Email", False, False),
    (8, "klaviyo", "Email", False, False), (9, "Promotional", "Email", False, False), (10, "Transactional", "Email", False, False), (11, "Tactics", "Email", False, False),
    (12, "attentive", "SMS", False, False), (13, "organic_and_social", "Organic", False, False), (14, "Direct", "Direct", False, False), (15, "shop_app", "Shop App", False, False),
    (16, "shop-website", "Other", False, False), (17, "AMZN_US_ShopDirect", "Marketplace", False, False), (18, "chatgpt.com", "AI Search", False, False), (19, "perplexity", "AI Search", False, False),
    (20, "copilot.com", "AI Search", False, False), (21, "Non-attributed", "Non-attributed", False, True), (22, "Excluded", "Excluded", False, True),
]


def read_catalog_table(spark: SparkSession, name: str) -> DataFrame:
    """A table by name, or a Parquet folder by path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(folder)


def detect_schema(columns: list[str], headers: dict[str, list[str]] | None = None) -> dict[str, str]:
    """{header: canonical name} of the version whose two telling columns are there; all of its columns must be."""
    for version, names in (headers or HEADERS).items():
        if set(names[:2]) <= set(columns):
            if missing := sorted(set(names) - set(columns)):
                raise ValueError(f"{version} product master lacks {missing}")
            return dict(zip(names, CANONICAL, strict=True))
    raise ValueError(f"no known product master has the columns {sorted(columns)}")


def normalize_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def table_or_default(spark: SparkSession, name: str) -> DataFrame | None:
    """The optional table, or None where it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        df = read_catalog_table(spark, name)
        df.schema  # noqa: B018  resolves it
        return df
    except AnalysisException:
        return None


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def stream_json(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """New *.json files as they come; files under other names (being written) are left alone."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.json").json(folder)


def stream_table(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """New rows of a logged table, without what rewrites of it write again; or new files of a plain folder that is only appended to."""
    from tradewind.sources.tables import LoggedTable

    table = LoggedTable(spark, folder)
    return table.stream() if table.exists() else spark.readStream.schema(schema).parquet(folder)


def generate_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row a day, both ends included."""
    return calendar_of(spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")))


def calendar_of(days: DataFrame) -> DataFrame:
    """The date dimension of a frame of days (column day)."""
    d = F.col("day")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("date_actual"), S.iso_year(d).alias("iso_year"), S.iso_week(d).alias("iso_week"), S.iso_day(d).alias("iso_day_of_week"), F.year(d).alias("cal_year"), F.month(d).alias("cal_month"),
        F.day(d).alias("cal_day"), F.quarter(d).alias("cal_quarter"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("day_name"), (S.iso_day(d) >= 6).alias("is_weekend"),
    )


def calendar_wide(days: DataFrame) -> DataFrame:
    """20 attributes of each day: those of the dimension, day of year, and starts and ends of its week, month and quarter."""
    d = F.col("day")
    week, month, quarter = (F.to_date(F.date_trunc(x, d)) for x in ("week", "month", "quarter"))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), d.alias("date_value"), F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.day(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        S.iso_year(d).alias("iso_year"), S.iso_week(d).alias("iso_week"), S.iso_day(d).alias("iso_day_of_week"), F.concat(S.iso_year(d).cast("string"), F.lit("-W"), F.lpad(S.iso_week(d).cast("string"), 2, "0")).alias("iso_year_week"), week.alias("iso_week_start_date"), F.date_add(week, 6).alias("iso_week_end_date"),
        month.alias("month_start_date"), F.last_day(d).alias("month_end_date"), quarter.alias("quarter_start_date"), F.date_sub(F.to_date(F.add_months(quarter, 3)), 1).alias("quarter_end_date"), F.date_format(d, "EEEE").alias("day_name"), (S.iso_day(d) >= 6).alias("is_weekend"),
    )


def seed_channels(spark: SparkSession) -> DataFrame:
    """The seed rows as inline values, whose size Spark knows, so that joins to them are broadcast."""
    rows = ", ".join(f"({key}, '{source}', '{group}', {paid}, {meta})" for key, source, group, paid, meta in CHANNELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(channel_key, channel_source, channel_group, is_paid, is_meta)")


def land_raw(df: DataFrame, source: str, run_id: str, at: Column) -> DataFrame:
    """Bronze rows: the whole row as JSON, and where and when it came from."""
    return df.select(F.to_json(F.struct("*")).alias("raw_payload"), F.lit(source).alias("source"), F.lit(run_id).alias("run_id"), F.to_date(at).alias("ingestion_date"), at.alias("ingestion_ts"))


def flatten_payload(bronze: DataFrame, schema: str, columns: dict[str, str], payload: str = "raw_payload") -> DataFrame:
    """Typed columns from JSON: names to SQL expressions over x, the parsed payload; bad values become null."""
    return bronze.withColumn("x", F.from_json(payload, schema)).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def typed_report(df: DataFrame, rename: dict[str, str], ints: list[str], floats: list[str], date: str) -> DataFrame:
    """A report of texts with its own names and types; the date is a yyyyMMdd text."""
    df = df.withColumnsRenamed(rename)
    types = {c: F.expr(f"try_cast({c} as bigint)") for c in ints} | {c: F.expr(f"try_cast({c} as double)") for c in floats}
    return df.withColumns(types | {date: F.to_date(F.try_to_timestamp(date, F.lit("yyyyMMdd")))})


def discover_then_hydrate(window_rows: DataFrame, full_rows: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that the window shows; the window's own rows may be incomplete."""
    return full_rows.join(window_rows.select(key).distinct(), key, "left_semi")


def explode_ranking(payload: DataFrame) -> DataFrame:
    """Ranked ids of a collection's pages: position runs on over the pages; pinned, boosted and removed by id.

    payload: collection, page, json with results [{id, uid}], elevated, boosted and removed (lists of ids).
    """
    shape = "results array<struct<id string, uid string>>, elevated array<string>, boosted array<string>, removed array<string>"
    rows = payload.withColumn("x", F.from_json("json", shape)).select("collection", "page", F.col("x.elevated").alias("up"), F.col("x.boosted").alias("more"), F.col("x.removed").alias("off"), F.posexplode("x.results").alias("at", "r"))
    order = Window.partitionBy("collection").orderBy("page", "at")
    member = lambda c: F.coalesce(F.array_contains(c, F.col("r.id")), F.lit(False))
    return rows.select("collection", F.col("r.id").alias("product_id"), F.row_number().over(order).alias("position"), member("up").alias("is_pinned"), member("more").alias("is_boosted"), member("off").alias("is_removed"))


def ranking_meta(payload: DataFrame) -> DataFrame:
    """Totals and the default sort of a collection: the first option that is selected or default."""
    shape = "total bigint, per_page bigint, sorting array<struct<label string, selected boolean, default boolean>>, campaigns array<string>"
    x = payload.where("page = 1").withColumn("x", F.from_json("json", shape))
    chosen = F.filter("x.sorting", lambda s: F.coalesce(s["selected"], F.lit(False)) | F.coalesce(s["default"], F.lit(False)))
    return x.select("collection", F.col("x.total").alias("total_results"), F.col("x.per_page").alias("default_per_page"), F.get(chosen, F.lit(0))["label"].alias("default_sort"), F.to_json("x.campaigns").alias("triggered_campaigns"))


def read_partition_pruned(edges: DataFrame, column: str, watermark: str | None, today: str, buffer_days: int = 2, first_days: int = 365) -> DataFrame:
    """Rows from the watermark less a buffer on, or of the last year where there is no watermark; pruned by partition."""
    bound = F.date_sub(F.lit(watermark or today).cast("date"), buffer_days if watermark else first_days)
    return edges.where(F.col(column) >= bound)
