"""Composite builds: dimensions, the order-line fact, gold tables, cohorts, receiving, lineage, the daily run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.fixtures import GROUPS, Views
from tradewind.functions import scalars as S
from tradewind.operators import aggregates as A
from tradewind.operators import filters as P
from tradewind.operators import history as H
from tradewind.operators import joins as J
from tradewind.operators import quality as Q
from tradewind.operators import windows as W
from tradewind.sources import readers as R
from tradewind.sources import sinks as K
from tradewind.sources import tables as T
from tradewind.streaming import streams as ST

START, END = "1996-01-01", "2000-12-31"
#: The load time that builds of the given tables bear, which are of a fixed time; a live run passes its own.
LOADED = f"{END} 06:00:00"
TEXTS = ["vend_id", "item_description", "season", "group_name", "gender", "class_name", "master_style"]


def loaded(at: Column | None) -> Column:
    return (F.lit(LOADED).cast("timestamp") if at is None else at).alias("_ingested_at")


def clean_products(raw: DataFrame) -> DataFrame:
    """Products of a master: keyed, filled, the last of each sku."""
    rows = P.fill_sentinels(P.drop_missing_key(raw, "sku"), TEXTS)
    rows = P.completeness_flag(rows, ["vend_id", "item_description"])
    return W.latest_by_key(rows.withColumn("sku", F.trim("sku")), ["sku"], ["key"])


def build_dim_product(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Product dimension without history: clean products, numbered by sku, with the unknown member."""
    rows = clean_products(raw).select("sku", *TEXTS, "cost", "retail", "is_complete", loaded(loaded_at))
    keyed = W.surrogate_key(rows, "sku", "product_key")
    unknown = raw.sparkSession.range(1).select(*[
        {"product_key": F.lit(0), "is_complete": F.lit(False), "cost": F.lit(None), "retail": F.lit(None), "_ingested_at": loaded(loaded_at)}.get(f.name, F.lit(S.UNKNOWN)).cast(f.dataType).alias(f.name) for f in keyed.schema
    ])
    return unknown.unionByName(keyed)


def build_dim_product_scd2(raw: DataFrame, path: str, at: Column, tracked: list[str] | None = None) -> DataFrame:
    """Product dimension with history at a path after a delivery: keyed and deduplicated, merged as of a time, with the unknown member."""
    rows = P.drop_missing_key(raw, "sku").withColumn("sku", F.trim("sku"))
    rows, history = W.latest_by_key(rows, ["sku"], ["key"]), H.open_history(raw.sparkSession, path)
    if history is None:
        history = H.History.begin(rows, path, "sku", tracked or ["season", "retail"], at, unknown=True)
    else:
        history.merge(rows, at)
    return history.all_versions()


#: Columns of the fact, as expressions over the joined lines.
FACT = {
    "channel_key": "channel_key", "product_key": "product_key", "date_key": "date_key", "shopify_order_id": "cast(order_id AS string)", "shopify_order_name": "order_name", "tw_order_id": "tw_order_id", "shopify_line_id": "cast(id AS string)", "sku_raw": "sku",
    "quantity": "cast(quantity AS int)", "refunded_quantity": "refunded_quantity", "pre_tax_price": "cast(price AS decimal(10,2))", "tw_channel_source": "tw_channel_source", "channel_source_norm": "channel_source_norm", "tw_touch_ts": "tw_touch_ts", "attribution_model": "attribution_model",
    "position": "position", "campaign_id": "campaign_id", "adset_id": "adset_id", "ad_id": "ad_id", "financial_status": "financial_status", "is_exc_order": "is_exc_order", "is_replacement_order": "is_replacement_order", "is_sales_attributable": "is_sales_attributable",
    "iso_year": "iso_year", "iso_week": "iso_week", "order_updated_at": "order_updated_at", "_ingested_at": "_ingested_at",
}
#: Those that come from the order's last touch, and from its exclusion.
TOUCHED = {"channel_key", "tw_order_id", "tw_channel_source", "channel_source_norm", "tw_touch_ts", "attribution_model", "position", "campaign_id", "adset_id", "ad_id"}
EXCLUDED = {"is_exc_order", "is_replacement_order", "is_sales_attributable"}


def build_fact(v: Views, dates: DataFrame, products: DataFrame | None, channels: DataFrame, since: str | None = None, metafield: DataFrame | None = None, start: str = START, end: str = END, loaded_at: Column | None = None, columns: Iterable[str] = tuple(FACT)) -> DataFrame:
    """The order-line fact: all orders of the days from start to end, or those changed since the watermark less two days (with all of their lines).

    columns: those wanted, all by default; what only others come from is neither joined nor shuffled.
    """
    want = set(columns)
    orders = P.filter_since(v.order, "updated_at", since)
    local = S.business_time(F.col("processed_at"))
    # ids of orders are texts throughout, as those of touches are, so that orders are dealt by id once for all that is joined to them
    orders = orders.select(F.col("id").cast("string").alias("order_id"), F.col("name").alias("order_name"), "processed_at", "financial_status", F.col("updated_at").alias("order_updated_at"), F.date_format(local, "yyyyMMdd").cast("int").alias("date_key"), F.to_date(local).alias("local_day"))
    orders = changed = P.filter_window(orders, "local_day", start, end)
    # all that depends on the order is joined to the orders, so that the lines are shuffled once for it, with their refunds
    if want & EXCLUDED:
        if metafield is None:
            orders = orders.withColumn("is_replacement_order", F.lit(False))
        else:
            orders = J.flag_by_id_set(orders, metafield.where("replace_refund = 'Replace'").select("order_id"), "order_id", "is_replacement_order")
        orders = P.exclusion_flags(orders)
    if want & TOUCHED:
        touches = W.last_touch(v.touch).withColumn("channel_source_norm", S.normalize_source(F.col("source")))
        orders = J.lookup_key(J.attach_attribution(orders, touches), channels, "channel_source_norm", "channel_source", "channel_key")
    if want & {"iso_year", "iso_week"}:
        orders = J.lookup_week(orders, dates)
    lines = v.line.where("order_id is not null").select("id", F.col("order_id").cast("string").alias("order_id"), "sku", "quantity", "price")
    # lines get what is found by sku while they are narrow, before the orders' columns come to them (of a batch, only its orders'
    # lines), or last, where the lines' ids aren't wanted any more
    with_key = lambda rows: J.lookup_key(rows, products, "sku", "sku", "product_key") if "product_key" in want else rows
    net = lambda rows: J.net_refunds(rows, v.refund) if "refunded_quantity" in want else rows
    last = "shopify_line_id" not in want
    if since is None or last:
        lines = net(lines if last else with_key(lines))
    else:
        lines = with_key(net(lines).join(changed.select("order_id"), "order_id", "left_semi"))
    rows = lines.join(orders, "order_id").withColumn("_ingested_at", loaded(loaded_at))
    return project_fact(with_key(rows) if last else rows, want)


def project_fact(df: DataFrame, columns: Iterable[str] = tuple(FACT)) -> DataFrame:
    """The fact's columns, or those wanted, in its order."""
    return df.select(*[F.expr(x).alias(name) for name, x in FACT.items() if name in set(columns)])


def build_page_view(v: Views, products: DataFrame) -> DataFrame:
    """Day and product page: sales of lines that were never refunded, web events, sessions by channel group."""
    orders = P.soft_delete_filter(v.order).where("processed_at is not null").select(F.col("id").alias("order_id"), S.legacy_business_date(F.col("processed_at")).alias("date"))
    lines = J.with_order_marks(P.derived_measures(v.line), v.refund).where("not is_refunded").join(orders, "order_id")
    lines = lines.join(v.product_page.select(F.col("id").alias("product_id"), "handle"), "product_id", "left")
    sales = A.first_of_order(P.sales_line_filter(lines).withColumn("page", F.concat(F.lit("/products/"), "handle")))
    sales = sales.join(products.select("sku", "group_name", "gender", "item_description"), "sku", "left")
    gold = J.join_on_composite(A.shopify_page_agg(sales), A.web_page_agg(v.web_page), ["date", "page"])
    return J.join_on_composite(gold, A.traffic_pivot(v.web_traffic, GROUPS), ["date", "page"])


def build_receiving(v: Views, days: int = 8) -> DataFrame:
    """Items of shipments that were active in the last days, complete and in their latest load, with their shipments' data."""
    items = v.shipment_item
    last = items.agg(F.max("loaded_at").alias("last"))
    active = items.join(last, items.loaded_at >= last.last - F.make_dt_interval(days=F.lit(days))).select("shipment_id")
    whole = R.discover_then_hydrate(active, items, "shipment_id")
    latest = W.latest_by_key(whole, ["shipment_id", "seller_sku"], ["loaded_at", "load_id"])
    ships = R.discover_then_hydrate(latest, v.shipment, "shipment_id")
    gold = J.items_with_shipments(latest, ships)
    return gold.withColumns({"receiving_gap": F.col("quantity_shipped") - F.col("quantity_received"), "created_date": S.created_date(F.col("shipment_name"))})


#: Where an application wrote the tables of the star of a folder.
_WRITTEN: dict[tuple, str] = {}


class Star:
    """The star schema and gold tables of one folder, built lazily.

    The product dimension and the fact are written once an application, each when it is first asked for, and then read, as
    every query over them would otherwise build them anew; they are written again once a table that they come from has changed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.v = spark, Views(spark, sf_dir)

    @cached_property
    def dates(self) -> DataFrame:
        return R.generate_calendar(self.spark, START, END)

    @cached_property
    def products(self) -> DataFrame:
        return self._stored("dim_product", ("part",), lambda: build_dim_product(self.v.product(1)))

    def _stored(self, name: str, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        """What make builds of these tables, as this application wrote it."""
        key = (self.spark.sparkContext.applicationId, self.v.sf_dir, name, *map(self._state, tables))
        if key not in _WRITTEN:
            path = K.scratch(self.spark, name)
            K.overwrite_table(make(), path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def build(self) -> None:
        """Writes the product dimension and the fact if they aren't there."""
        _ = self.fact

    def _state(self, table: str) -> tuple[int, int, int]:
        """Bytes, files and time of a table, by which a change of it is seen."""
        folder = T.Folder(self.spark, f"{self.v.sf_dir}/{table}.parquet")
        held = folder.fs.getContentSummary(folder.at(""))
        return held.getLength(), held.getFileCount(), folder.fs.getFileStatus(folder.at("")).getModificationTime()

    def remove(self) -> None:
        """Removes what this application wrote of the star of its folder."""
        for key in [k for k in _WRITTEN if k[:2] == (self.spark.sparkContext.applicationId, self.v.sf_dir)]:
            K.remove(self.spark, _WRITTEN.pop(key))

    def new_fact(self, products: DataFrame | None, **only) -> DataFrame:
        return build_fact(self.v, self.dates, products, self.channels, metafield=self.v.metafield, **only)

    def fact_of(self, *columns: str, **only) -> DataFrame:
        """A few columns of the fact, built without what only others need and not written; products are looked up for product_key."""
        return self.new_fact(self.products if "product_key" in columns else None, columns=columns, **only)

    def styled(self, *columns: str, **only) -> DataFrame:
        """A few columns of the fact with the style of each line's product, as in the star. Products are looked up by sku when no
        line's id is needed any more; neither the fact nor the dimension is written."""
        styles = clean_products(self.v.product(1)).select(F.col("sku").alias("__sku"), "vend_id")
        rows = self.fact_of("sku_raw", *columns, **only).join(styles, F.col("sku_raw") == F.col("__sku"), "left")
        return rows.withColumn("vend_id", F.coalesce("vend_id", F.lit(S.UNKNOWN))).drop("__sku")

    @cached_property
    def channels(self) -> DataFrame:
        return R.seed_channels(self.spark)

    @cached_property
    def fact(self) -> DataFrame:
        return self._stored("fact", ("orders", "lineitem", "part"), lambda: self.new_fact(self.products))

    @cached_property
    def star(self) -> DataFrame:
        return J.join_star(self.fact, self.dates, self.products, self.channels)

    @cached_property
    def metric(self) -> DataFrame:
        return A.quantity_by_style_channel_week(self.star)

    @cached_property
    def page_view(self) -> DataFrame:
        return build_page_view(self.v, clean_products(self.v.product(1)))  # the dimension's rows; its numbers are of no use here

    @cached_property
    def cohort_seq(self) -> DataFrame:
        return W.order_sequence(P.valid_orders(self.v.order))

    @cached_property
    def retention(self) -> DataFrame:
        return A.cohort_retention(self.cohort_seq)

    @cached_property
    def monthly(self) -> DataFrame:
        return A.new_vs_returning_by_month(self.cohort_seq)

    @cached_property
    def receiving(self) -> DataFrame:
        return build_receiving(self.v)

    @cached_property
    def sales_day(self) -> DataFrame:
        rows = P.valid_orders(self.v.order).withColumn("day", F.to_date("processed_at"))
        out = rows.groupBy("day").agg(F.sum("total_cents").alias("revenue_cents"), F.count("*").alias("orders"))
        return out.withColumn("date_key", F.date_format("day", "yyyyMMdd").cast("int"))

    @cached_property
    def attributed(self) -> DataFrame:
        return ST.attribute_ads(ST.dedup_stream(self.v.ads_stream, "ad_event_id"), ST.dedup_stream(self.v.orders_stream, "order_id"))

    @cached_property
    def windows(self) -> DataFrame:
        return ST.windowed_roas(self.attributed)

    @cached_property
    def channel_gold(self) -> DataFrame:
        """The windows flagged against the mean of all of their channel."""
        base = self.windows.groupBy("channel").agg(F.avg("roas").alias("baseline_roas"), F.count("*").alias("baseline_n"))
        return ST.flag_anomaly(self.windows, base)

    @cached_property
    def ads_day(self) -> DataFrame:
        out = self.attributed.withColumn("day", F.to_date("event_time")).groupBy("day", "channel")
        out = out.agg(F.sum("spend_cents").alias("spend_cents"), F.sum("revenue_cents").alias("revenue_cents"), F.sum("is_attributed").alias("new_customers"))
        return out.withColumn("date_key", F.date_format("day", "yyyyMMdd").cast("int"))

    #: Temp views of the metric layer and what they show.
    VIEWS = {"fact": "fact", "dim_date": "dates", "dim_product": "products", "dim_channel": "channels", "page_view": "page_view", "receiving": "receiving", "sales_day": "sales_day", "ads_day": "ads_day", "cohort_monthly": "monthly", "cohort_retention": "retention", "channel_gold": "channel_gold"}

    def register(self, views: Iterable[str] | None = None) -> None:
        """Temp views for the metric layer: those named, or all. Only what is named is built."""
        for name in self.VIEWS if views is None else views:
            K.create_view(getattr(self, self.VIEWS[name]), name)


def refund_analysis(orders: DataFrame) -> DataFrame:
    """Refunds by tags (column tags) and by metafield (column replace_refund), classified alike; disjoint paths in one union."""
    by_tag = orders.where("tags is not null").select("order_id", S.refund_category(F.col("tags")).alias("category"), F.lit("tags").alias("path"))
    by_field = orders.where("tags is null and replace_refund is not null").select("order_id", S.refund_category(F.col("replace_refund")).alias("category"), F.lit("metafield").alias("path"))
    return by_tag.unionByName(by_field).withColumn("responsibility", S.responsibility(F.col("category")))


def sales_order_clean(orders: DataFrame, metafield: DataFrame) -> DataFrame:
    """Orders without replacements, refunds, excluded names and orders of the returns service (column tags)."""
    rows = J.flag_by_id_set(orders, metafield.where("replace_refund = 'Replace'").select("order_id"), "id", "is_replacement_order")
    rows = P.exclusion_flags(rows, name="name")
    return rows.where("is_sales_attributable and financial_status <> 'refunded' and not coalesce(lower(tags) like '%returnly%', false)")


def watermark_read(spark: SparkSession, path: str, table: str) -> str | None:
    """The table's watermark, None before the first build."""
    state = T.read_state(spark, path)
    row = state.where(F.col("table_name") == table).first() if state is not None else None
    return row["last_watermark"] if row else None


def watermark_advance(spark: SparkSession, path: str, table: str, batch: DataFrame, column: str) -> None:
    """Moves the watermark to the batch's maximum, after the batch was written; an empty batch leaves it."""
    top = batch.agg(F.date_format(F.max(column), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if top is not None:
        T.upsert_row(spark, path, "table_name", spark.createDataFrame([(table, top)], "table_name string, last_watermark string"))


#: Buckets of the tables that are kept by ISO week.
WEEK = "iso_year * 100 + iso_week"


def refresh_dim_product(raw: DataFrame, path: str, loaded_at: Column | None = None) -> DataFrame:
    """The product dimension at a path after a delivery: known skus keep their keys, new ones get keys above the highest."""
    spark, built = raw.sparkSession, build_dim_product(raw, loaded_at)
    table = T.KeyedTable(spark, path)
    if not table.exists():
        return T.KeyedTable.create(built, path, ["sku"], 16).read()
    known = table.read()
    rows = K.stored(built.drop("product_key").join(known.select("sku", "product_key"), "sku", "left").select(*known.columns), "products")
    fresh = W.surrogate_key(rows.where("product_key is null").drop("product_key"), "sku", "product_key", known.agg(F.max("product_key")).first()[0] or 0)
    same = known.select(F.struct(*[c for c in known.columns if c != "_ingested_at"]).alias("__known"))
    changed = rows.where("product_key is not null").join(same, F.struct(*[F.col(c) for c in known.columns if c != "_ingested_at"]).eqNullSafe(F.col("__known")), "left_anti")
    table.upsert(changed.unionByName(fresh))
    return table.read()


def refresh_fact(batch: DataFrame, path: str) -> tuple[DataFrame, set[int]]:
    """The fact at a path after a batch of changed lines, and the weeks that changed: those of the batch and those where its lines were before."""
    table = T.KeyedTable(batch.sparkSession, path)
    if table.exists():
        return table, table.upsert(batch)
    table = T.KeyedTable.create(batch, path, ["shopify_line_id"], by=WEEK)
    return table, table.buckets()


def refresh_metric(fact: T.KeyedTable, weeks: set[int], dims: list[DataFrame], path: str) -> T.KeyedTable:
    """The flagship metric at a path after the fact changed in these weeks: only they are read, aggregated and replaced."""
    rows = A.quantity_by_style_channel_week(J.join_star(fact.read(buckets=weeks), *dims))
    table = T.KeyedTable(rows.sparkSession, path)
    if not table.exists():
        return T.KeyedTable.create(rows, path, A.STYLE_KEYS, by=WEEK)
    if weeks:
        table.replace(rows, weeks)
    return table


def daily_run(spark: SparkSession, sf_dir: str, out: str, specs: list[dict], day: str = END, before: str | None = None) -> DataFrame:
    """Dimensions, fact, checks, then what is published: a failed gate raises after the fact is written, before the gold tables.

    From the second run on only orders changed since the watermark are built, and only the weeks in which their lines are or
    were are rewritten, in the fact and in the metric. The watermark moves when all is published, so a run that failed is
    made up by the next. before: takes orders changed before this time only, as a run of that day did.
    """
    star = Star(spark, sf_dir)
    if before:
        star.v.order = star.v.order.where(F.col("updated_at") < F.lit(before).cast("timestamp"))
    for name, df in (("dim_date", star.dates), ("dim_channel", star.channels)):
        K.overwrite_table(df, f"{out}/{name}")
    dates, channels = (spark.read.parquet(f"{out}/{n}") for n in ("dim_date", "dim_channel"))
    products = refresh_dim_product(star.v.product(1), f"{out}/dim_product", F.lit(f"{day} 06:00:00").cast("timestamp"))
    since = watermark_read(spark, f"{out}/watermarks", "fact_orders_line")
    batch = build_fact(star.v, dates, products, channels, since, star.v.metafield, loaded_at=F.lit(f"{day} 06:00:00").cast("timestamp"))
    table, weeks = refresh_fact(batch, f"{out}/fact_orders_line")
    fact = table.read()
    results = Q.run_checks(spark, specs, {"fact_orders_line": fact}, F.lit(f"{END} 00:00:00").cast("timestamp"))
    K.write_json_report(results, f"{out}/checks", "daily")
    Q.gate(results)
    refresh_metric(table, weeks, [dates, products, channels], f"{out}/quantity_by_style_channel_week")
    K.overwrite_table(star.page_view, f"{out}/page_view")
    # the newest of the weeks rewritten is the batch's newest, as the batch has all that changed since the last watermark
    watermark_advance(spark, f"{out}/watermarks", "fact_orders_line", table.read(buckets=weeks), "order_updated_at")
    return success_digest(spark, out, fact, results, day)


def success_digest(spark: SparkSession, out: str, fact: DataFrame, results: DataFrame, day: str = END) -> DataFrame:
    """Today's row of the run history (replaced on a rerun), with the change against the run before."""
    passed = results.agg(F.concat(F.sum(F.col("passed").cast("int")), F.lit("/"), F.count("*"))).first()[0]
    row = spark.createDataFrame([(day, fact.count(), passed)], "run_date string, fact_row_count bigint, dq_summary string")
    return W.day_over_day_delta(T.upsert_row(spark, f"{out}/history", "run_date", row), "run_date", "fact_row_count")


#: Web reports by grain: new names, whole numbers, key.
REPORTS = {
    "page": ({"pagePath": "page_path", "screenPageViews": "event_count", "addToCarts": "add_to_carts"}, ["event_count", "add_to_carts"], ["date", "page_path"]),
    "session": ({"landingPage": "landing_page", "sessionDefaultChannelGroup": "channel_group"}, ["sessions"], ["date", "landing_page", "channel_group"]),
    "item": ({"itemId": "item_id", "itemsViewed": "items_viewed"}, ["items_viewed"], ["date", "item_id"]),
}


def ingest_web_report(silver: DataFrame | None, raw: DataFrame, grain: str) -> DataFrame:
    """The silver table after a pull of a report (all texts): typed, one row a key, keys compared null-safely."""
    rename, ints, keys = REPORTS[grain]
    typed = R.typed_report(raw, rename, ints, [], "date")
    return typed if silver is None else K.upsert(silver, typed, keys, null_safe=True)


def snapshot_rankings(payload: DataFrame, day: str, path: str) -> DataFrame:
    """Replaces a day's positions; a rerun of the day leaves one copy. Returns all days."""
    K.replace_where(R.explode_ranking(payload).withColumn("snapshot_date", F.lit(day)), path, "snapshot_date")
    return payload.sparkSession.read.parquet(path)


def build_cohort(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders by month, new and returning; and the retention of each month's new customers."""
    seq = W.order_sequence(P.valid_orders(orders))
    return A.new_vs_returning_by_month(seq), A.cohort_retention(seq)
