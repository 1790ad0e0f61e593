"""Joins of the retail model. Sides are broadcast only where Spark finds them small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.operators.ranges import cut
from tradewind.operators.windows import latest_by_key


def lines_with_header(lines: DataFrame, orders: DataFrame) -> DataFrame:
    header = orders.select(F.col("id").alias("order_id"), F.col("name").alias("order_name"), "processed_at", "financial_status", F.col("updated_at").alias("order_updated_at"))
    return lines.join(header, "order_id")


def flag_by_id_set(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """flag: the key is among the ids (first column); both sides are compared as text."""
    known = ids.select(F.col(ids.columns[0]).cast("string").alias("__id")).where("__id is not null").distinct()
    return df.join(known, F.col(key).cast("string") == F.col("__id"), "left").withColumn(flag, F.col("__id").isNotNull()).drop("__id")


def net_refunds(lines: DataFrame, refunds: DataFrame) -> DataFrame:
    """refunded_quantity of each line. Refunds that name the order of their line (column order_id) are dealt by order among the
    lines, so neither is shuffled by line, and what is joined by order next needs no other shuffle of the lines; others are
    summed by line and joined by its id."""
    back = refunds.where("order_line_id is not null")
    if "order_id" in refunds.columns and "order_id" in lines.columns:
        of = F.col("order_id").cast(lines.schema["order_id"].dataType).alias("order_id")
        back = back.select(F.col("order_line_id").alias("id"), of, F.coalesce("quantity", F.lit(0)).alias("__one"))  # null in lines only
        rows = lines.unionByName(back, allowMissingColumns=True).repartition("order_id")
        rows = rows.withColumn("__back", F.sum("__one").over(Window.partitionBy("order_id", "id"))).where("__one is null").drop("__one")
    else:
        rows = lines.join(back.groupBy(F.col("order_line_id").alias("id")).agg(F.sum("quantity").alias("__back")), "id", "left")
    return rows.withColumn("refunded_quantity", F.coalesce(F.round("__back"), F.lit(0)).cast("int")).drop("__back")


def semi_prefilter(touches: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """Touches of the batch's orders only, before they are shuffled and sorted for a window."""
    ids = orders.select(F.col(key).cast("string").alias("__id")).distinct()
    return touches.join(ids, F.col("order_id") == F.col("__id"), "left_semi")


def attach_attribution(lines: DataFrame, touches: DataFrame) -> DataFrame:
    mine = touches.select(F.col("order_id").alias("tw_order_id"), F.col("source").alias("tw_channel_source"), "channel_source_norm", F.col("click_date").alias("tw_touch_ts"), "position", "attribution_model", "campaign_id", "adset_id", "ad_id")
    return lines.join(mine, F.col("order_id").cast("string") == F.col("tw_order_id"), "left")


def lookup_key(df: DataFrame, dim: DataFrame, value: str, dim_value: str, key: str) -> DataFrame:
    """Adds the surrogate key of a value; 0 where the dimension doesn't have it."""
    found = dim.where(F.col(dim_value).isNotNull()).select(F.col(dim_value).alias("__value"), F.col(key).alias("__key"))
    return df.join(found, F.col(value) == F.col("__value"), "left").withColumn(key, F.coalesce("__key", F.lit(0))).drop("__value", "__key")


def lookup_week(orders: DataFrame, dates: DataFrame) -> DataFrame:
    """ISO week of the date key, which an order's lines have in common."""
    return orders.join(dates.select("date_key", "iso_year", "iso_week"), "date_key", "left")


def join_star(fact: DataFrame, dates: DataFrame, products: DataFrame, channels: DataFrame) -> DataFrame:
    products = products.withColumnsRenamed({"sku": "product_sku", "_ingested_at": "product_ingested_at"})
    return fact.drop("iso_year", "iso_week").join(dates, "date_key").join(products, "product_key").join(channels, "channel_key")


def referential_orphans(items: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return items.join(parents.select(key).distinct(), key, "left_anti")


def orphan_rate(items: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows, rows without a parent, and their percentage, in one row."""
    marked = items.join(parents.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    lost = F.sum(F.when(F.col("__there").isNull(), 1).otherwise(0))
    return marked.agg(F.count("*").alias("total"), F.coalesce(lost, F.lit(0)).alias("orphans"), F.round(100.0 * lost / F.count("*"), 4).alias("pct"))


def exclude_matched(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns are not among the keys; a null never matches."""
    return df.join(keys, keys.columns, "left_anti")


def with_order_marks(lines: DataFrame, refunds: DataFrame) -> DataFrame:
    """Lines with order_quantity, the units of their whole order, and is_refunded: some line of the same order and sku was refunded
    (never for a null sku). One scan of the lines, and one shuffle by order for both.

    Refunds that name the order and sku of their line (columns order_id and sku) are dealt by order with the lines, so neither is
    shuffled by line; others are looked up by order_line_id first."""
    if {"order_id", "sku"} <= set(refunds.columns):
        back = refunds.where("order_id is not null and sku is not null").select("order_id", "sku", F.lit(True).alias("__back"))
        rows, is_line = lines.withColumn("__back", F.lit(False)).unionByName(back, allowMissingColumns=True), ~F.col("__back")
    else:
        back = refunds.select(F.col("order_line_id").alias("__of")).distinct()
        rows, is_line = lines.join(back, F.col("id") == F.col("__of"), "left").withColumn("__back", F.col("__of").isNotNull()).drop("__of"), F.lit(True)
    again = F.max("__back").over(Window.partitionBy("order_id", "sku"))
    whole = Window.partitionBy("order_id").orderBy("sku").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort for both
    units = F.sum("quantity").over(whole)  # a refund's row has no quantity
    return rows.withColumns({"order_quantity": units, "is_refunded": F.col("sku").isNotNull() & again}).where(is_line).drop("__back")


def join_on_composite(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join whose missing measures become 0."""
    measures = [c for c in other.columns if c not in keys]
    return df.join(other, keys, "left").fillna(0, measures)


def as_of_point(history: DataFrame, key: str, value, at) -> DataFrame:
    """The version of a key, or of every key for None, that was valid at a time: from <= time < to."""
    valid = (F.col("effective_from") <= at) & (at < F.col("effective_to"))
    return history.where(valid if value is None else valid & (F.col(key) == F.lit(value)))


def as_of_join(facts: DataFrame, history: DataFrame, key: str, time: str) -> DataFrame:
    """Each fact with the version of its key (as v_ columns) that began last before or at its time and has not ended by then.

    No join: facts and the starts of versions are one table in order of key and time, and the last version is carried to the
    facts after it; a hot key is cut into ranges of time, into which its last version so far is carried. Versions of a key
    must not overlap.
    """
    columns = [c for c in history.columns if c != key]
    version = F.struct(*[F.col(c).alias(f"v_{c}") for c in columns])
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("__at")
    starts = history.where(F.col(key).isNotNull() & F.col("effective_from").isNotNull()).select(F.col(key).alias("__key"), at("effective_from"), F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__tie"), version.alias("__v"))
    rows = facts.select(F.col(key).alias("__key"), at(time), F.lit(1).alias("__kind"), F.xxhash64(*facts.columns).alias("__tie"), F.struct(*facts.columns).alias("__fact"))
    r = cut(starts.unionByName(rows, allowMissingColumns=True), ["__key"], ["__at", "__kind", "__tie"])
    carried = F.last("__v", ignorenulls=True)
    found = r.rows.withColumn("__in", carried.over(r.window().rowsBetween(Window.unboundedPreceding, 0))).where("__kind = 1")
    found = r.with_carried(found, {"v": F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct("__at", "__tie")))}, {"v": F.last("v", ignorenulls=True)})
    last = F.coalesce("__in", "__before_v")
    open_ = F.col("__key").isNotNull() & (F.col("__at") < F.unix_micros(F.col("__last.v_effective_to")))
    found = found.withColumn("__last", last).withColumn("__last", F.when(open_, F.col("__last")))
    return found.select("__fact.*", *[F.col(f"__last.v_{c}").alias(f"v_{c}") for c in columns])


def items_with_shipments(items: DataFrame, shipments: DataFrame) -> DataFrame:
    """Left, so that items of unknown shipments stay."""
    return items.join(shipments, "shipment_id", "left")


def full_outer_compare(new: DataFrame, old: DataFrame, keys: list[str], measure: str = "qty") -> DataFrame:
    a, b = (x.select(*keys, F.col(measure).alias(n)) for x, n in ((new, "new_qty"), (old, "old_qty")))
    return a.join(b, keys, "full").fillna(0, ["new_qty", "old_qty"])


def multi_key_fallback_join(orders: DataFrame, hits: DataFrame, keys: list[str], hit_key: str) -> DataFrame:
    """Hits whose id is any of several order keys: one equi-join for each key, their union without repeats."""
    out = None
    for key in keys:
        part = orders.where(F.col(key).isNotNull()).join(hits, F.col(key).cast("string") == F.col(hit_key))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def degraded_lookup(lines: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """Key by sku, else by description (that with the smallest key), else 0. Columns sku and item_description on both sides."""
    by_sku = products.select(F.col("sku").alias("__s"), F.col(key).alias("__k1")).where("__s is not null")
    by_text = products.where("item_description is not null").groupBy(F.col("item_description").alias("__d")).agg(F.min(key).alias("__k2"))
    found = lines.join(by_sku, F.col("sku") == F.col("__s"), "left")
    wanted = F.when(F.col("__k1").isNull(), F.col("item_description"))
    return found.join(by_text, wanted == F.col("__d"), "left").withColumn(key, F.coalesce("__k1", "__k2", F.lit(0))).drop("__s", "__k1", "__d", "__k2")


def replacement_links(orders: DataFrame, freight: DataFrame) -> DataFrame:
    """Replacement orders with their originals (column original_id), both freights, and how many orders the customer has."""
    cost = freight.groupBy("order_id").agg(F.sum("cost_cents").alias("cost_cents"))
    count = orders.where("customer_id is not null").groupBy("customer_id").agg(F.count("*").alias("customer_orders"))
    links = orders.where("original_id is not null").select(F.col("id").alias("replacement_id"), "original_id", "customer_id")
    links = links.join(orders.select(F.col("id").alias("original_id"), F.col("total_cents").alias("original_cents")), "original_id")
    for side in ("replacement", "original"):
        links = links.join(cost.select(F.col("order_id").alias(f"{side}_id"), F.col("cost_cents").alias(f"{side}_freight")), f"{side}_id", "left")
    return links.join(count, "customer_id", "left")


def class_pairs(products: DataFrame, column: str = "class_name") -> DataFrame:
    """All pairs of the distinct classes; a handful of values, not rows."""
    one = products.select(F.col(column).alias("class_a")).distinct()
    return one.crossJoin(one.select(F.col("class_a").alias("class_b")))


def cross_sell_pairs(baskets: DataFrame) -> DataFrame:
    """Customers of each pair of classes: distinct (customer, class) first, so a customer's pairs are few. Columns customer_id, class_name."""
    one = baskets.where("customer_id is not null and class_name is not null").select("customer_id", "class_name").distinct()
    two = one.select("customer_id", F.col("class_name").alias("class_b"))
    pairs = one.withColumnRenamed("class_name", "class_a").join(two, "customer_id").where("class_a < class_b")
    return pairs.groupBy("class_a", "class_b").agg(F.count("*").alias("customers"))


def match_rate_by_month(orders: DataFrame, touches: DataFrame, below: float = 90.0) -> DataFrame:
    """Months in which fewer than so many percent of the orders have a touch."""
    seen = touches.select(F.col("order_id").alias("__id")).distinct()
    rows = orders.join(seen, F.col("id").cast("string") == F.col("__id"), "left").groupBy(F.date_format("processed_at", "yyyy-MM").alias("month"))
    out = rows.agg(F.countDistinct("id").alias("orders"), F.countDistinct(F.when(F.col("__id").isNotNull(), F.col("id"))).alias("matched"))
    return out.withColumn("pct", F.round(100.0 * F.col("matched") / F.col("orders"), 2)).where(F.col("pct") < below)


def dedupe_touches(touches: DataFrame) -> DataFrame:
    return latest_by_key(touches, ["order_id"], ["position", "click_date", "tie_1", "tie_2"])
