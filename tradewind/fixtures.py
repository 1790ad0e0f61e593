"""Retail views of the given tables: orders, lines, refunds, touches, products, web reports, streams and shipments.

The given tables have no nulls, orphans, refunds, late rows or duplicates, so the views make them by rules on the keys.
CTES is the same text for DuckDB, where the oracles read it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marketing sources by key modulo 8.
SOURCES = ["google%20ads", "GOOGLE%2Fcpc", "facebook-ads", " EMARSYS ", "Direct", "bing", "Non-attributed", "impact"]
#: Channel groups of web sessions by key modulo 15.
GROUPS = ["Email", "Paid Search", "Paid Social", "Affiliates", "Organic Social", "Direct", "Organic Search", "SMS", "Cross-network", "Referral", "Paid Shopping", "Organic Shopping", "Organic Video", "Paid Other", "Unassigned"]


def cents(column: str) -> Column:
    """Whole cents as decimal money."""
    return (F.col(column).cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,2)")


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


class Views:
    """The views over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"})

    @cached_property
    def order(self) -> DataFrame:
        k = F.col("o_orderkey")
        at = F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))
        status = F.when(F.col("o_orderstatus") == "O", "pending").when((F.col("o_orderstatus") == "P") & (k % 5 == 0), "refunded").otherwise("paid")
        return self.table("orders").select(
            k.alias("id"), F.when(k % 41 != 0, F.col("o_custkey")).alias("customer_id"),
            F.when(k % 97 != 0, F.concat(F.lit("#"), k.cast("string"), F.when(k % 37 == 0, "-EXC").otherwise(""))).alias("name"),
            at.alias("created_at"), at.alias("processed_at"), (at + F.make_dt_interval(days=(k % 40).cast("int"))).alias("updated_at"),
            F.when(k % 53 == 0, at).alias("cancelled_at"), status.alias("financial_status"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total_cents"),
            (k % 71 == 0).alias("test"), F.when(k % 67 == 0, True).when(k % 3 != 0, False).alias("deleted"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        ).withColumn("total_price", cents("total_cents"))

    @cached_property
    def line(self) -> DataFrame:
        p, q = F.col("l_partkey"), F.col("l_quantity").cast("bigint")
        price = F.when(F.col("l_suppkey") % 47 == 0, F.lit(0)).otherwise(F.expr("(cast(round(l_extendedprice * 100) as bigint) * 2 + cast(l_quantity as bigint)) div (2 * cast(l_quantity as bigint))"))
        rows = self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("id"), F.col("l_orderkey").alias("order_id"), p.alias("product_id"),
            F.when(p % 101 == 0, None).when(p % 103 == 0, F.concat(F.lit("X"), p.cast("string"))).otherwise(p.cast("string")).alias("sku"),
            F.expr("cast((cast(l_quantity as bigint) + 4) div 5 as int)").alias("quantity"), price.cast("bigint").alias("price_cents"), F.round(F.col("l_discount") * 100).cast("bigint").alias("discount_pct"),
            q.alias("units"), "l_linenumber", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus",
        )
        rows = rows.withColumn("discount_cents", F.expr("(price_cents * quantity * discount_pct + 50) div 100"))
        return rows.withColumns({"price": cents("price_cents").cast("decimal(10,2)"), "discount": cents("discount_cents")})

    @cached_property
    def refund(self) -> DataFrame:
        """Refunds of lines. Besides the line's id, as in the SQL, they name its order and sku."""
        back = self.line.where("l_returnflag = 'R'").select("id", "order_id", "sku", "quantity", "l_suppkey", F.col("l_linestatus").alias("restock_type"))
        of = [F.col("id").alias("order_line_id"), "order_id", "sku"]
        first = back.select(*of, F.expr("cast(greatest(1, quantity div 2) as int)").alias("quantity"), "restock_type")
        second = back.where("l_suppkey % 7 = 0 and quantity > 2").select(*of, F.lit(1).alias("quantity"), "restock_type")
        return first.unionByName(second)

    @cached_property
    def metafield(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").where((k % 29 == 0) | (k % 31 == 0)).select(k.alias("order_id"), F.when(k % 29 == 0, "Replace").otherwise("Refund").alias("replace_refund"))

    @cached_property
    def touch(self) -> DataFrame:
        p = F.col("l_partkey")
        return self.table("lineitem").where("l_orderkey % 89 <> 0").select(
            F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("position"), F.col("l_shipdate").alias("click_date"), p.alias("tie_1"), F.col("l_suppkey").alias("tie_2"),
            F.when(p % 211 == 0, "mystery-src").otherwise(_pick(SOURCES, p % 8)).alias("source"), F.when(F.col("l_suppkey") % 2 == 0, "last").otherwise("linear").alias("attribution_model"),
            *[F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit(n), (p % m).cast("string"))).alias(f"{c}_id") for c, n, m in (("campaign", "c", 13), ("adset", "s", 29), ("ad", "a", 97))],
        )

    def product(self, version: int = 1) -> DataFrame:
        """Product master snapshots: the second changes some prices, drops some keys and adds 20."""
        k = F.col("p_partkey")
        rows = self.table("part").select(
            k.alias("key"), k.cast("string").alias("sku"), F.col("p_brand").alias("vend_id"), F.when(k % 17 != 0, F.col("p_name")).alias("item_description"), F.col("p_type").alias("season"),
            F.concat(F.lit("G"), (F.col("p_size") % 5).cast("string")).alias("group_name"), F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("U").alias("gender"), F.concat(F.lit("C"), (F.col("p_size") % 7).cast("string")).alias("class_name"),
            F.when(k % 13 != 0, F.concat(F.lit("M"), (k % 9).cast("string"))).alias("master_style"), F.expr("cast(round(p_retailprice * 100) as bigint) * 6 div 10").alias("cost_cents"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("retail_cents"),
        )
        if version == 2:
            rows = rows.where("key % 19 <> 0")
            rows = rows.withColumn("retail_cents", F.expr("retail_cents + if(key % 10 = 0, 100, 0)"))
            added = self.table("part").where("p_partkey < 20").select(
                (F.col("p_partkey") + 90000000).alias("key"), (F.col("p_partkey") + 90000000).cast("string").alias("sku"), F.lit("Brand#New").alias("vend_id"), F.lit("new item").alias("item_description"), F.lit("PROMO").alias("season"),
                F.lit("G0").alias("group_name"), F.lit("U").alias("gender"), F.lit("C0").alias("class_name"), F.lit("M0").alias("master_style"), F.lit(600).cast("bigint").alias("cost_cents"), F.lit(1000).cast("bigint").alias("retail_cents"),
            )
            rows = rows.unionByName(added)
        return rows.withColumns({c: cents(f"{c}_cents").cast("decimal(10,2)") for c in ("cost", "retail")}).drop("cost_cents")

    @cached_property
    def web_page(self) -> DataFrame:
        e = F.col("event_id")
        path = F.when(e % 11 == 0, "/cart").otherwise(F.concat(F.lit("/products/p"), (F.col("user_id") % 15).cast("string"), F.lit("?ref="), (e % 3).cast("string")))
        return self.table("events").select(F.date_add(F.lit("1998-01-01").cast("date"), (e % 365).cast("int")).alias("date"), path.alias("page_path"), F.lit(1).cast("bigint").alias("event_count"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("bigint").alias("add_to_carts"))

    @cached_property
    def web_traffic(self) -> DataFrame:
        e = F.col("event_id")
        path = F.when(e % 11 == 0, "/cart").otherwise(F.concat(F.lit("/products/p"), (F.col("user_id") % 15).cast("string")))
        return self.table("events").select(F.date_add(F.lit("1998-01-01").cast("date"), (e % 365).cast("int")).alias("date"), path.alias("landing_page"), _pick(GROUPS, e % 15).alias("channel_group"), F.lit(1).cast("bigint").alias("sessions"))

    @cached_property
    def product_page(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(k.alias("id"), F.when(k % 23 != 0, F.concat(F.lit("p"), (k % 15).cast("string"))).alias("handle"))

    @cached_property
    def _clock(self) -> DataFrame:
        """Events with 30 days pressed into 12 hours."""
        start = F.lit("2024-01-01").cast("timestamp")
        micros = F.expr("(unix_micros(ts) - unix_micros(timestamp '2024-01-01')) div 60000000 * 1000000")
        return self.table("events").withColumn("event_time", F.timestamp_micros(F.unix_micros(start) + micros))

    @cached_property
    def orders_stream(self) -> DataFrame:
        return self._clock.where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("order_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("customer_id"), F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"), "event_time")

    @cached_property
    def ads_stream(self) -> DataFrame:
        """Clicks as ads: a quarter without an order, the others with the first purchase among the next 30 events."""
        clicks = self._clock.where("event_type = 'click'").select("event_id", "user_id", "value", "event_time")
        buys = self._clock.where("event_type = 'purchase'").select(F.col("event_id").alias("buy"), F.explode(F.sequence(F.col("event_id") - 30, F.col("event_id") - 1)).alias("event_id"))
        first = buys.groupBy("event_id").agg(F.min("buy").alias("buy"))
        late = F.when(F.col("event_id") % 20 == 7, 60).otherwise(0)
        return clicks.join(first, "event_id", "left").select(
            F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("ad_event_id"), F.when(F.col("event_id") % 4 != 0, F.col("buy").cast("string")).alias("order_id"), F.concat(F.lit("ch"), (F.col("user_id") % 4).cast("string")).alias("channel"),
            F.round(F.col("value") * 10).cast("bigint").alias("spend_cents"), F.timestamp_micros(F.unix_micros("event_time") - late * 1000000).alias("event_time"),
        )

    @cached_property
    def shipment_item(self) -> DataFrame:
        """One load of received items a line; a shipment is an order."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("shipment_id"), F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("seller_sku"), F.concat(F.lit("F"), F.col("l_suppkey").cast("string")).alias("network_sku"),
            F.col("l_quantity").cast("bigint").alias("quantity_shipped"), (F.col("l_quantity").cast("bigint") - F.col("l_linenumber") % 3).alias("quantity_received"), F.col("l_shipdate").alias("loaded_at"), F.concat_ws("-", "l_linenumber", "l_suppkey").alias("load_id"),
        )

    @cached_property
    def shipment(self) -> DataFrame:
        k = F.col("o_orderkey")
        stamp = F.date_format("o_orderdate", "MM/dd/yyyy")
        name = F.when(k % 3 == 0, F.concat(F.lit("FBA STA ("), stamp, F.lit(" 17:52)-P"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("FBA ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")-P"), k.cast("string"))).otherwise(F.concat(F.lit("Box "), k.cast("string")))
        return self.table("orders").where("o_orderkey % 31 <> 0").select(k.alias("shipment_id"), name.alias("shipment_name"), F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "WORKING").otherwise("RECEIVING").alias("shipment_status"), F.col("o_orderpriority").alias("destination_fc_id"))

    @cached_property
    def freight(self) -> DataFrame:
        k = F.col("o_orderkey")
        one = self.table("orders").select(k.alias("order_id"), F.col("o_orderpriority").alias("carrier"), _pick(["ground", "air", "sea"], k % 3).alias("kind"), F.expr("cast(round(o_totalprice) as bigint)").alias("cost_cents"), F.lit(1).alias("parcel"))
        return one.unionByName(one.where("order_id % 6 = 0").withColumns({"parcel": F.lit(2), "cost_cents": F.expr("cost_cents div 2")}))

    @cached_property
    def edges(self) -> DataFrame:
        """Lineage edges region -> nation -> supplier with a time last seen."""
        seen = lambda c: F.timestamp_seconds(F.lit(1704067200) + F.col(c).cast("bigint") * 3600)
        top = self.table("nation").select(F.concat(F.lit("cat.raw.region_"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("cat.mart.nation_"), F.col("n_nationkey").cast("string")).alias("target"), seen("n_nationkey").alias("last_seen"))
        low = self.table("supplier").select(F.concat(F.lit("cat.mart.nation_"), F.col("s_nationkey").cast("string")).alias("source"), F.concat(F.lit("cat.dash.supplier_"), F.col("s_suppkey").cast("string")).alias("target"), seen("s_suppkey").alias("last_seen"))
        return top.unionByName(low)


def _case(values: list[str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


#: The views as common table expressions for DuckDB.
CTES = f"""
f_order AS (SELECT *, CAST(total_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS total_price FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN '#' || o_orderkey || CASE WHEN o_orderkey % 37 = 0 THEN '-EXC' ELSE '' END END AS name,
    o_orderdate + to_hours(o_orderkey % 24) AS created_at, o_orderdate + to_hours(o_orderkey % 24) AS processed_at,
    o_orderdate + to_hours(o_orderkey % 24) + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS updated_at,
    CASE WHEN o_orderkey % 53 = 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS cancelled_at,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'refunded' ELSE 'paid' END AS financial_status,
    CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderkey % 71 = 0 AS test,
    CASE WHEN o_orderkey % 67 = 0 THEN true WHEN o_orderkey % 3 <> 0 THEN false END AS deleted, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders)),
f_line AS (SELECT *, CAST(price_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS price, CAST(discount_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS discount FROM (
  SELECT *, (price_cents * quantity * discount_pct + 50) // 100 AS discount_cents FROM (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id, l_orderkey AS order_id, l_partkey AS product_id,
    CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN 'X' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS sku,
    CAST((CAST(l_quantity AS BIGINT) + 4) // 5 AS INTEGER) AS quantity,
    CASE WHEN l_suppkey % 47 = 0 THEN 0 ELSE (CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) END AS price_cents,
    CAST(round(l_discount * 100) AS BIGINT) AS discount_pct, CAST(l_quantity AS BIGINT) AS units, l_linenumber, l_suppkey, l_shipdate, l_returnflag, l_linestatus FROM lineitem))),
f_refund AS (SELECT id AS order_line_id, CAST(greatest(1, quantity // 2) AS INTEGER) AS quantity, l_linestatus AS restock_type FROM f_line WHERE l_returnflag = 'R'
  UNION ALL SELECT id, 1, l_linestatus FROM f_line WHERE l_returnflag = 'R' AND l_suppkey % 7 = 0 AND quantity > 2),
f_metafield AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 29 = 0 THEN 'Replace' ELSE 'Refund' END AS replace_refund FROM orders WHERE o_orderkey % 29 = 0 OR o_orderkey % 31 = 0),
f_touch AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS position, l_shipdate AS click_date, l_partkey AS tie_1, l_suppkey AS tie_2,
    CASE WHEN l_partkey % 211 = 0 THEN 'mystery-src' ELSE {_case(SOURCES, "l_partkey % 8")} END AS source, CASE WHEN l_suppkey % 2 = 0 THEN 'last' ELSE 'linear' END AS attribution_model,
    CASE WHEN l_suppkey % 4 <> 0 THEN 'c' || (l_partkey % 13) END AS campaign_id, CASE WHEN l_suppkey % 4 <> 0 THEN 's' || (l_partkey % 29) END AS adset_id, CASE WHEN l_suppkey % 4 <> 0 THEN 'a' || (l_partkey % 97) END AS ad_id FROM lineitem WHERE l_orderkey % 89 <> 0),
f_product_1 AS (SELECT *, CAST(retail_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS retail FROM (
  SELECT p_partkey AS key, CAST(p_partkey AS VARCHAR) AS sku, p_brand AS vend_id, CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS item_description, p_type AS season, 'G' || (p_size % 5) AS group_name,
    CASE WHEN p_partkey % 3 = 0 THEN 'M' WHEN p_partkey % 3 = 1 THEN 'F' ELSE 'U' END AS gender, 'C' || (p_size % 7) AS class_name, CASE WHEN p_partkey % 13 <> 0 THEN 'M' || (p_partkey % 9) END AS master_style,
    CAST((CAST(round(p_retailprice * 100) AS BIGINT) * 6 // 10) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS cost, CAST(round(p_retailprice * 100) AS BIGINT) AS retail_cents FROM part)),
f_product_2 AS (SELECT *, CAST(retail_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS retail FROM (
  SELECT * EXCLUDE (retail_cents, retail), retail_cents + CASE WHEN key % 10 = 0 THEN 100 ELSE 0 END AS retail_cents FROM f_product_1 WHERE key % 19 <> 0
  UNION ALL SELECT p_partkey + 90000000, CAST(p_partkey + 90000000 AS VARCHAR), 'Brand#New', 'new item', 'PROMO', 'G0', 'U', 'C0', 'M0', 6.00, 1000 FROM part WHERE p_partkey < 20)),
f_web_page AS (SELECT DATE '1998-01-01' + CAST(event_id % 365 AS INTEGER) AS date, CASE WHEN event_id % 11 = 0 THEN '/cart' ELSE '/products/p' || (user_id % 15) || '?ref=' || (event_id % 3) END AS page_path, 1 AS event_count, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS add_to_carts FROM events),
f_web_traffic AS (SELECT DATE '1998-01-01' + CAST(event_id % 365 AS INTEGER) AS date, CASE WHEN event_id % 11 = 0 THEN '/cart' ELSE '/products/p' || (user_id % 15) END AS landing_page, {_case(GROUPS, "event_id % 15")} AS channel_group, 1 AS sessions FROM events),
f_product_page AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 23 <> 0 THEN 'p' || (p_partkey % 15) END AS handle FROM part),
f_clock AS (SELECT *, make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 * 1000000) AS event_time FROM events),
f_orders_stream AS (SELECT CAST(event_id AS VARCHAR) AS order_id, 'c' || user_id AS customer_id, CAST(round(value * 100) AS BIGINT) AS amount_cents, event_time FROM f_clock WHERE event_type = 'purchase'),
f_ads_stream AS (SELECT 'a' || c.event_id AS ad_event_id, CASE WHEN c.event_id % 4 <> 0 THEN CAST(b.buy AS VARCHAR) END AS order_id, 'ch' || (user_id % 4) AS channel, CAST(round(value * 10) AS BIGINT) AS spend_cents,
    event_time - CASE WHEN c.event_id % 20 = 7 THEN INTERVAL 60 SECOND ELSE INTERVAL 0 SECOND END AS event_time
  FROM f_clock c LEFT JOIN (SELECT x.event_id, min(y.event_id) AS buy FROM events x JOIN events y ON y.event_id BETWEEN x.event_id + 1 AND x.event_id + 30 AND y.event_type = 'purchase' WHERE x.event_type = 'click' GROUP BY 1) b USING (event_id) WHERE event_type = 'click'),
f_shipment_item AS (SELECT l_orderkey AS shipment_id, 'S' || l_partkey AS seller_sku, 'F' || l_suppkey AS network_sku, CAST(l_quantity AS BIGINT) AS quantity_shipped, CAST(l_quantity AS BIGINT) - l_linenumber % 3 AS quantity_received, l_shipdate AS loaded_at, l_linenumber || '-' || l_suppkey AS load_id FROM lineitem),
f_shipment AS (SELECT o_orderkey AS shipment_id, CASE o_orderkey % 3 WHEN 0 THEN 'FBA STA (' || strftime(o_orderdate, '%m/%d/%Y') || ' 17:52)-P' || o_orderkey WHEN 1 THEN 'FBA (' || strftime(o_orderdate, '%Y-%m-%d') || ')-P' || o_orderkey ELSE 'Box ' || o_orderkey END AS shipment_name,
    CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'WORKING' ELSE 'RECEIVING' END AS shipment_status, o_orderpriority AS destination_fc_id FROM orders WHERE o_orderkey % 31 <> 0),
f_freight_1 AS (SELECT o_orderkey AS order_id, o_orderpriority AS carrier, {_case(["ground", "air", "sea"], "o_orderkey % 3")} AS kind, CAST(round(o_totalprice) AS BIGINT) AS cost_cents, 1 AS parcel FROM orders),
f_freight AS (SELECT * FROM f_freight_1 UNION ALL SELECT order_id, carrier, kind, cost_cents // 2, 2 FROM f_freight_1 WHERE order_id % 6 = 0),
f_edges AS (SELECT 'cat.raw.region_' || n_regionkey AS source, 'cat.mart.nation_' || n_nationkey AS target, make_timestamp((1704067200 + CAST(n_nationkey AS BIGINT) * 3600) * 1000000) AS last_seen FROM nation
  UNION ALL SELECT 'cat.mart.nation_' || s_nationkey, 'cat.dash.supplier_' || s_suppkey, make_timestamp((1704067200 + s_suppkey * 3600) * 1000000) FROM supplier)
"""
