"""Aggregations of facts, orders, web reports and freight. Money is summed in cents and rounded once."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions import scalars as S
from tradewind.operators.ranges import cut
from tradewind.sources.sinks import stored

NET = "quantity - refunded_quantity"
STYLE_KEYS = ["iso_year", "iso_week", "vend_id", "item_description", "season", "channel_source", "channel_group"]


def money(cents):
    return F.round(cents.cast("double") / 100, 2)


def quantity_by_style_channel_week(star: DataFrame) -> DataFrame:
    rows = star.where("is_sales_attributable and vend_id is not null")
    return rows.groupBy(*STYLE_KEYS).agg(F.sum(F.expr(NET)).alias("value"))


def units_dollars_by_sku_channel_week(star: DataFrame) -> DataFrame:
    rows = star.where("is_sales_attributable and product_sku is not null").withColumn("week_ending_date", S.week_ending(F.col("date_actual")))
    out = rows.groupBy("week_ending_date", F.col("product_sku").alias("sku"), F.col("channel_source").alias("channel"))
    units = F.sum(F.expr(NET))
    return out.agg(units.alias("units_sold"), F.round(F.sum(F.expr(f"({NET}) * pre_tax_price")), 2).cast("double").alias("dollar_sales")).where("units_sold <> 0")


def order_total_qty(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_id").agg(F.sum("quantity").alias("order_quantity"))


def refunded_keys(lines: DataFrame, refunds: DataFrame) -> DataFrame:
    return lines.join(refunds.select(F.col("order_line_id").alias("id")), "id", "left_semi").select("order_id", "sku").distinct()


def first_of_order(sales: DataFrame) -> DataFrame:
    """is_first: the line is the one that counts its order on a day and page. So orders are counted by a sum, and what is looked up
    for the lines afterwards need not be dealt by order with them."""
    same = Window.partitionBy("date", "page", "order_id").orderBy("order_id")
    return sales.withColumn("is_first", F.col("order_id").isNotNull() & (F.row_number().over(same) == 1))


def shopify_page_agg(sales: DataFrame) -> DataFrame:
    """Orders, units, value and attributes of each day and page, of lines marked by first_of_order."""
    return sales.groupBy("date", "page").agg(
        F.count_if("is_first").alias("unique_orders"), F.sum("quantity").alias("unique_sold"), F.sum("net_line_cents").alias("net_cents"),
        F.max("group_name").alias("category"), F.max("gender").alias("gender"), F.max("item_description").alias("descr"),
    )


def web_page_agg(pages: DataFrame) -> DataFrame:
    rows = pages.withColumn("page", S.product_path(F.col("page_path"))).where("page <> ''")
    return rows.groupBy("date", "page").agg(F.sum("event_count").alias("event_count"), F.sum("add_to_carts").alias("add_to_cart"))


def column_of(group: str) -> str:
    return group.lower().replace(" ", "_").replace("-", "_")


def traffic_pivot(traffic: DataFrame, groups: list[str]) -> DataFrame:
    """Sessions of each (date, page) in a column for each group, 0 where there are none."""
    rows = traffic.withColumn("page", S.product_path(F.col("landing_page"))).where("page <> ''")
    out = rows.groupBy("date", "page").pivot("channel_group", groups).agg(F.sum("sessions"))
    return out.select("date", "page", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).alias(column_of(g)) for g in groups])


def page_view_by_product(gold: DataFrame, groups: list[str], start: int, end: int) -> DataFrame:
    key = F.date_format("date", "yyyyMMdd").cast("int")
    sums = ["event_count", "add_to_cart", "unique_orders", "unique_sold", *map(column_of, groups)]
    out = gold.where(key.between(start, end)).groupBy("page")
    return out.agg(*[F.sum(c).alias(c) for c in sums], money(F.sum("net_cents")).alias("net_sales"), *[F.max(c).alias(c) for c in ("category", "gender", "descr")])


def new_vs_returning_by_month(seq: DataFrame) -> DataFrame:
    when = lambda test, x: F.when(F.expr(test), x)
    return seq.groupBy("order_month").agg(
        F.count(when("order_seq = 1", 1)).alias("new_orders"), F.count(when("order_seq > 1", 1)).alias("returning_orders"),
        money(F.coalesce(F.sum(when("order_seq = 1", F.col("total_cents"))), F.lit(0))).alias("new_revenue"), money(F.coalesce(F.sum(when("order_seq > 1", F.col("total_cents"))), F.lit(0))).alias("returning_revenue"),
    )


def cohort_retention(seq: DataFrame) -> DataFrame:
    activity = seq.select("customer_id", "cohort_month", S.period_index(F.col("order_month"), F.col("cohort_month")).alias("period_index")).distinct()
    active = activity.groupBy("cohort_month", "period_index").agg(F.count("*").alias("active_customers"))
    sizes = active.where("period_index = 0").select("cohort_month", F.col("active_customers").alias("cohort_size"))
    return active.join(sizes, "cohort_month").withColumn("retention_rate", F.round(F.col("active_customers") / F.col("cohort_size"), 4))


def join_stats(df: DataFrame, matched: str) -> DataFrame:
    """Rows, matched and unmatched, in one pass."""
    hit = F.sum(F.when(F.col(matched).isNotNull(), 1).otherwise(0))
    return df.agg(F.count("*").alias("total"), F.coalesce(hit, F.lit(0)).alias("matched"), (F.count("*") - F.coalesce(hit, F.lit(0))).alias("unmatched"))


def top_counts(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n most frequent values; the values themselves break ties."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *columns).limit(n)


def breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def edge_last_seen(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target").agg(F.max("last_seen").alias("last_seen"))


def channel_group_rollup(channels: DataFrame) -> DataFrame:
    return channels.groupBy("channel_group").agg(F.count("*").alias("channels"), F.concat_ws(", ", F.sort_array(F.collect_list("channel_source"))).alias("members"))


def ad_channel_summary(ads: DataFrame) -> DataFrame:
    return ads.groupBy("channel").agg(F.count("*").alias("ads"), money(F.sum("spend_cents")).alias("spend"), F.count("order_id").alias("attributed"))


def ratio_by(df: DataFrame, keys: list[str], top: str, bottom: str, name: str, digits: int = 4) -> DataFrame:
    """Ratio of two sums for each key, null where the lower one is 0."""
    return df.groupBy(*keys).agg(F.round(F.sum(top).cast("double") / F.nullif(F.sum(bottom).cast("double"), F.lit(0.0)), digits).alias(name))


def version_histogram(history: DataFrame, key: str) -> DataFrame:
    return history.groupBy(key).agg(F.count("*").alias("versions")).groupBy("versions").agg(F.count("*").alias("keys"))


def dedup_check(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"))


def daily_basket_metrics(lines: DataFrame) -> DataFrame:
    """Per-order figures averaged over each day. Columns day, order_id, quantity, sku, style, net_line_cents.

    Distinct values of an order are counted by their ranks, so lines dealt by order aren't repeated and shuffled for each count."""
    rank = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(Window.partitionBy("day", "order_id").orderBy(F.col(c).asc_nulls_last())))
    distinct = lambda c: F.coalesce(F.max(f"__{c}"), F.lit(0))
    ranked = lines.select("day", "order_id", "quantity", "net_line_cents", rank("sku").alias("__sku"), rank("style").alias("__style"))
    per_order = ranked.groupBy("day", "order_id").agg(F.sum("quantity").alias("units"), distinct("sku").alias("skus"), distinct("style").alias("styles"), F.sum("net_line_cents").alias("cents"))
    mean = lambda c: F.round(F.sum(c).cast("double") / F.count("*"), 4)
    return per_order.groupBy("day").agg(F.count("*").alias("orders"), mean("units").alias("units_per_order"), mean("skus").alias("skus_per_order"), mean("styles").alias("styles_per_order"), F.round(F.sum("cents").cast("double") / F.count("*") / 100, 8).alias("order_value"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of a key's values, by name; nulls don't count.

    Values are counted first, then ranged by key and value with counts carried over the borders, and a quantile is where the
    running count passes its rank: a key with very many values is spread over many tasks. n is the number of values.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), "values")
    r = cut(counts, keys, [value])
    upto = r.rows.withColumn("__upto", F.sum("__n").over(r.window().rowsBetween(Window.unboundedPreceding, 0)))
    upto = r.with_carried(upto, {"n": F.sum("__n")}, {"n": F.sum("n")}).withColumn("__upto", F.col("__upto") + F.coalesce("__before_n", F.lit(0)))
    totals = df.groupBy(*keys).agg(F.count(value).alias("n")).select(*[F.col(k).alias(f"__k_{k}") for k in keys], "n")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    rank = lambda p: (F.col("n") - 1) * F.lit(p)
    passed = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    bounds = [x for name, p in at.items() for x in (passed(F.floor(rank(p))).alias(f"__low_{name}"), passed(F.ceil(rank(p))).alias(f"__high_{name}"))]
    found = totals.join(upto, same, "left").groupBy(*[F.col(f"__k_{k}").alias(k) for k in keys], "n").agg(*bounds)
    between = lambda name, p: F.col(f"__low_{name}") + (rank(p) - F.floor(rank(p))) * (F.col(f"__high_{name}") - F.col(f"__low_{name}"))
    return found.select(*keys, "n", *[between(name, p).alias(name) for name, p in at.items()])


def daily_quantiles(orders: DataFrame, day: str, cents: str) -> DataFrame:
    """Exact interpolated quartiles, median and 90th percentile of order values."""
    at = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    found = exact_quantiles(orders, [day], cents, at)
    return found.select(day, *[F.round(F.col(n) / 100, 4).alias(n) for n in at])


def freight_cost(freight: DataFrame, orders: DataFrame) -> DataFrame:
    """Freight of each label and of replacement orders apart. orders: order_id, is_replacement_order."""
    label = S.carrier_label(F.col("carrier"), F.col("kind")).alias("label")
    return freight.join(orders, "order_id").groupBy(label, "is_replacement_order").agg(F.countDistinct("order_id").alias("orders"), money(F.sum("cost_cents")).alias("cost"))


def order_drop_alert(daily: DataFrame, share: float = 0.5) -> DataFrame:
    """Orders of a day against the mean of the seven days before. One row a day."""
    past = F.avg("orders").over(Window.orderBy("day").rowsBetween(-7, -1))
    return daily.withColumns({"past_mean": F.round(past, 4), "alert": F.coalesce(F.col("orders") < share * past, F.lit(False))})


def drilldown_matrix(star: DataFrame) -> DataFrame:
    """Style, channel and item subtotals for each week."""
    rows = star.where("is_sales_attributable").rollup("vend_id", "channel_source", "item_description", F.col("iso_week"))
    return rows.agg(F.sum(F.expr(NET)).alias("units"), F.grouping_id().cast("bigint").alias("level"))


def quantity_by_grain(star: DataFrame, grain: str) -> DataFrame:
    """The same measure by year, quarter, month, week or day."""
    keys = {"year": ["cal_year"], "quarter": ["cal_year", "cal_quarter"], "month": ["cal_year", "cal_month"], "week": ["iso_year", "iso_week"], "day": ["date_key"]}[grain]
    return star.where("is_sales_attributable").groupBy(*keys).agg(F.sum(F.expr(NET)).alias("value"))


def kpi_parity(ours: DataFrame, theirs: DataFrame, key: str, tolerance: float = 0.05) -> DataFrame:
    """Our figure against the vendor's (column value in both): consistent below the tolerance."""
    both = ours.select(key, F.col("value").alias("ours")).join(theirs.select(key, F.col("value").alias("theirs")), key)
    gap = F.abs(F.col("ours") - F.col("theirs")).cast("double") / F.nullif(F.col("theirs").cast("double"), F.lit(0.0))
    return both.withColumns({"gap": F.round(gap, 4), "consistent": F.coalesce(gap < tolerance, F.lit(False))})


def table_profile(df: DataFrame, date: str, key: str, flags: dict[str, Column]) -> DataFrame:
    """One row: number of rows, first and last date, number of keys, and how many rows have each flag."""
    counts = [F.coalesce(F.sum(test.cast("int")), F.lit(0)).alias(name) for name, test in flags.items()]
    return df.agg(F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.countDistinct(key).alias("keys"), *counts)
