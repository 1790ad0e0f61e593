"""Operators of the ad stream. Each takes a streaming or a static frame; money is in cents.

Stream: deduplicate, attribute ads to orders by an interval join, aggregate sliding windows, flag anomalies in foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tradewind.operators.windows import latest_by_key
from tradewind.sources.sinks import replace_where, upsert
from tradewind.sources.tables import Folder

MIN_SPEND_CENTS, MIN_WINDOWS, FACTOR, LOOKBACK_MINUTES = 2000, 3, 0.5, 60
#: Batches whose baselines are kept for a replay.
KEPT_BASELINES = 10


def event_time_watermark(df: DataFrame, column: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(column, delay) if df.isStreaming else df


def dedup_stream(df: DataFrame, key: str, delay: str = "10 minutes", column: str = "event_time") -> DataFrame:
    """The first event of each key within the watermark; the earliest of a static frame."""
    if df.isStreaming:
        return df.withWatermark(column, delay).dropDuplicatesWithinWatermark([key])
    w = Window.partitionBy(key).orderBy(column)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def attribute_ads(ads: DataFrame, orders: DataFrame, minutes: int = 2) -> DataFrame:
    """Left interval join: an ad's order within so many minutes on either side; spend without an order stays, revenue 0."""
    span = F.expr(f"interval {minutes} minutes")
    ads, orders = event_time_watermark(ads, delay=f"{minutes} minutes"), event_time_watermark(orders, delay=f"{minutes} minutes")
    orders = orders.select(F.col("order_id").alias("o_order_id"), "amount_cents", F.col("event_time").alias("order_time"))
    on = (F.col("order_id") == F.col("o_order_id")) & (F.col("event_time") >= F.col("order_time") - span) & (F.col("event_time") <= F.col("order_time") + span)
    hit = F.col("o_order_id").isNotNull()
    return ads.join(orders, on, "left_outer").select(
        "ad_event_id", "order_id", "channel", "spend_cents", "event_time", F.coalesce("amount_cents", F.lit(0)).alias("revenue_cents"), hit.cast("int").alias("is_attributed"),
    )


def windowed_roas(df: DataFrame, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Spend, revenue, orders and their ratio (null without spend) of each channel in sliding windows."""
    df = event_time_watermark(df, delay="2 minutes")
    out = df.groupBy(F.window("event_time", size, slide), "channel").agg(F.sum("spend_cents").alias("spend_cents"), F.sum("revenue_cents").alias("revenue_cents"), F.sum("is_attributed").alias("order_count"))
    roas = F.round(F.col("revenue_cents") / F.nullif(F.col("spend_cents").cast("double"), F.lit(0.0)), 2)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "channel", "spend_cents", "revenue_cents", roas.alias("roas"), "order_count")


def channel_baseline(gold: DataFrame, now: Column, minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Mean ratio and number of the channel's windows without anomaly in the last minutes."""
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    rows = gold.where(~F.col("is_anomaly") & (F.col("window_start") >= since))
    if "window_day" in gold.columns:  # by which the table is partitioned: the other days aren't read
        rows = rows.where(F.col("window_day") >= F.to_date(since))
    return rows.groupBy("channel").agg(F.avg("roas").alias("baseline_roas"), F.count("*").alias("baseline_n"))


def flag_anomaly(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """is_anomaly: enough spend and baseline windows, and a ratio below half of the baseline; unknown is no anomaly."""
    test = (F.col("spend_cents") >= MIN_SPEND_CENTS) & (F.col("baseline_n") >= MIN_WINDOWS) & (F.col("roas") < F.col("baseline_roas") * FACTOR)
    return windows.join(baseline, "channel", "left").withColumn("is_anomaly", F.coalesce(test, F.lit(False))).drop("baseline_roas", "baseline_n")


def with_trigger(writer: DataStreamWriter, mode: str) -> DataStreamWriter:
    """'stream': micro-batches every 30 seconds; 'backfill': what is there now, then stop."""
    return writer.trigger(availableNow=True) if mode == "backfill" else writer.trigger(processingTime="30 seconds")


def stream_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "backfill") -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return with_trigger(writer, mode).start()


def gold_upserter(path: str, now: Column):
    """A foreachBatch body: flags a batch's windows against the gold table so far and upserts them with the time (last_updated).

    What a batch is held against is written before its rows, beside the table, so that a replayed batch, whose own windows
    are in the table by then, comes out as it did first. The table is partitioned by the day of the windows (window_day). A batch reads and rewrites the days that it has, so its
    cost doesn't grow with the history; days are replaced when the rewritten ones are complete."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        day = F.to_date("window_start").alias("window_day")
        rows = latest_by_key(batch, ["channel", "window_start"], ["window_end"]).withColumn("window_day", day).persist()
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
        gold = rows.withColumns({"is_anomaly": F.lit(False), "last_updated": now})
        gold = spark.read.schema(gold.schema).parquet(path) if exists else gold.limit(0)
        held = Folder(spark, f"{path}-baseline")
        if not held.fs.exists(held.at(f"{batch_id}/_SUCCESS")):
            channel_baseline(gold, now).write.mode("overwrite").parquet(f"{held.path}/{batch_id}")
            for old in held.names():  # a stream replays its last batch only
                if int(old) < batch_id - KEPT_BASELINES:
                    held.remove(old)
        flagged = flag_anomaly(rows, spark.read.parquet(f"{held.path}/{batch_id}")).withColumn("last_updated", now).select(*gold.columns)
        touched = gold.join(rows.select("window_day").distinct(), "window_day", "left_semi")
        replace_where(upsert(touched, flagged, ["channel", "window_start"], check=False), path, "window_day")
        rows.unpersist()

    return write


def stream_to_gold(df: DataFrame, path: str, checkpoint: str, now: Column, mode: str = "backfill") -> StreamingQuery:
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(gold_upserter(path, now))
    return with_trigger(writer, mode).start()


PROGRESS = "batch bigint, started string, input_rows bigint, late_rows bigint, state_rows bigint, output_rows bigint"


def stream_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """What a query says of its last batches: rows read, rows dropped as too late, rows kept as state, rows written (null where the sink doesn't count them)."""
    rows = []
    for p in query.recentProgress:
        states, written = p["stateOperators"], p["sink"]["numOutputRows"]
        rows.append((p["batchId"], p["timestamp"], p["numInputRows"], sum(x["numRowsDroppedByWatermark"] for x in states), sum(x["numRowsTotal"] for x in states), written if written >= 0 else None))
    return spark.createDataFrame(rows, PROGRESS)
