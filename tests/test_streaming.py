"""Streams run to the end of their files equal the same operators on static rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tradewind.plans import queries_io
from tradewind.plans.registry import QUERIES
from tradewind.sources import readers as R
from tradewind.streaming import streams as ST

ADS = "ad_event_id string, order_id string, channel string, spend_cents bigint, event_time timestamp"
ORDERS = "order_id string, customer_id string, amount_cents bigint, event_time timestamp"


def _write(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def _minute(m, s=0):
    return f"2024-01-01T{m // 60:02d}:{m % 60:02d}:{s:02d}.000Z"


@pytest.fixture()
def feeds(tmp_path):
    ads = [{"ad_event_id": f"a{k}", "order_id": f"o{k}" if k % 3 else None, "channel": f"c{k % 2}", "spend_cents": 1000 + k, "event_time": _minute(k)} for k in range(30)]
    orders = [{"order_id": f"o{k}", "customer_id": "x", "amount_cents": 5000, "event_time": _minute(k + (1 if k % 5 else 9))} for k in range(30)]
    _write(tmp_path / "ads", "1.json", ads)
    _write(tmp_path / "ads", "2.json", ads[::4])
    _write(tmp_path / "ads", "3.json.tmp", [ads[0] | {"ad_event_id": "unfinished"}])
    _write(tmp_path / "orders", "1.json", orders)
    return tmp_path


def _run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_dedup_join_and_windows(spark, feeds):
    ads = ST.dedup_stream(R.stream_json(spark, str(feeds / "ads"), ADS), "ad_event_id")
    orders = ST.dedup_stream(R.stream_json(spark, str(feeds / "orders"), ORDERS), "order_id")
    _run(ST.stream_to_table(ads, str(feeds / "silver"), str(feeds / "c1")))
    got = spark.read.parquet(str(feeds / "silver"))
    assert got.count() == 30 and got.where("ad_event_id = 'unfinished'").count() == 0
    _run(ST.stream_to_table(orders, str(feeds / "osilver"), str(feeds / "c2")))
    stream = ST.attribute_ads(R.stream_table(spark, str(feeds / "silver"), ADS), R.stream_table(spark, str(feeds / "osilver"), ORDERS))
    for hour in (9, 10, 11):  # rows without an order come once later events have moved both watermarks on
        end = {"ad_event_id": f"end{hour}", "order_id": f"end{hour}", "channel": "z", "spend_cents": 0, "event_time": _minute(hour * 60), "customer_id": "z", "amount_cents": 0}
        for folder in ("ads", "orders"):
            _write(feeds / folder, f"end{hour}.json", [end])
        _run(ST.stream_to_table(ads, str(feeds / "silver"), str(feeds / "c1")))
        _run(ST.stream_to_table(orders, str(feeds / "osilver"), str(feeds / "c2")))
        _run(ST.stream_to_table(stream, str(feeds / "attributed"), str(feeds / "c3")))
    batch = ST.attribute_ads(spark.read.parquet(str(feeds / "silver")), spark.read.parquet(str(feeds / "osilver"))).where("channel <> 'z'")
    done = spark.read.parquet(str(feeds / "attributed")).where("channel <> 'z'")
    assert sorted(map(tuple, done.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert batch.where("is_attributed = 0").agg(F.sum("spend_cents")).first()[0] > 0
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    windows = ST.windowed_roas(R.stream_table(spark, str(feeds / "attributed"), batch.schema))
    _run(ST.stream_to_gold(windows, str(feeds / "gold"), str(feeds / "c4"), now))
    gold = spark.read.parquet(str(feeds / "gold")).where("channel <> 'z'")
    want = ST.windowed_roas(batch)
    assert gold.select(*want.columns).exceptAll(want).count() == 0 and gold.count() == want.count()


def test_upsert_is_idempotent_and_flags(spark, tmp_path):
    rows = [(k, "c", 3000, 6000, 2.0, 1) for k in range(5)] + [(9, "c", 3000, 300, 0.1, 0)]
    df = spark.createDataFrame(rows, "m int, channel string, spend_cents bigint, revenue_cents bigint, roas double, order_count bigint")
    df = df.withColumn("window_start", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60)).withColumn("window_end", F.col("window_start") + F.expr("interval 5 minutes")).drop("m")
    write = ST.gold_upserter(str(tmp_path / "g"), F.lit("2024-01-01 00:30:00").cast("timestamp"))
    write(df.where("roas > 1"), 0)
    write(df, 1)
    write(df, 1)
    write(df.limit(0), 2)
    gold = spark.read.parquet(str(tmp_path / "g"))
    assert gold.count() == 6 and [r["roas"] for r in gold.where("is_anomaly").collect()] == [0.1]
    assert {str(r[0]) for r in gold.select("last_updated").collect()} == {"2024-01-01 00:30:00"}


def test_replay_of_a_batch_flags_alike(spark, tmp_path):
    """Its own windows, in the table since the first run, are no baseline for the second."""
    rows = [(k, "c", 3000, 6000, 2.0, 1) for k in range(3)] + [(5, "c", 3000, 2700, 0.9, 1), (6, "c", 3000, 2640, 0.88, 1)] + [(7 + k, "c", 3000, 30, 0.01, 1) for k in range(9)]
    df = spark.createDataFrame(rows, "m int, channel string, spend_cents bigint, revenue_cents bigint, roas double, order_count bigint")
    df = df.withColumn("window_start", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60)).withColumn("window_end", F.col("window_start") + F.expr("interval 5 minutes"))
    write = ST.gold_upserter(str(tmp_path / "g"), F.lit("2024-01-01 00:30:00").cast("timestamp"))
    write(df.where("m < 3").drop("m"), 0)
    seen = []
    for _ in range(3):
        write(df.where("m > 3").drop("m"), 1)
        seen.append(sorted(r["roas"] for r in spark.read.parquet(str(tmp_path / "g")).where("is_anomaly").collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 11


def test_rewrites_add_no_row_to_a_stream(spark, tmp_path):
    from tradewind.sources.tables import LoggedTable

    path, out, mark = (str(tmp_path / x) for x in ("t", "out", "mark"))
    rows = lambda low, high: spark.range(low, high).select("id", F.lit("v").alias("v"))
    table = LoggedTable.create(spark, path, rows(0, 0).schema)
    table.append(rows(0, 10).repartition(4))
    copy = lambda: _run(ST.stream_to_table(R.stream_table(spark, path), out, mark))
    copy()
    table.compact()
    copy()
    table.append(rows(10, 15))
    table.rewrite(lambda df: df.where("id % 2 = 0"))
    copy()
    table.compact()
    copy()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(15))
    assert sorted(r["id"] for r in table.read().collect()) == [0, 2, 4, 6, 8, 10, 12, 14]
    state = table.manifest()
    table.append(rows(20, 21))
    with pytest.raises(RuntimeError):
        table._commit(state | {"version": state["version"] + 1})
    assert len(table.vacuum()) >= 4 and table.read().count() == 9


def test_progress_of_a_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("ads", "out", "mark"))
    row = lambda k, m: {"ad_event_id": f"a{k}", "order_id": None, "channel": "c", "spend_cents": 1, "event_time": _minute(m)}
    batches = [[row(1, 0), row(2, 5)], [row(2, 5), row(3, 100), row(4, 101)], [row(5, 1), row(6, 102)], [row(7, 2), row(8, 103), row(9, 104)]]
    os.makedirs(src)
    stream = ST.dedup_stream(R.stream_json(spark, src, ADS), "ad_event_id", "10 minutes")
    tables = []
    for n, rows in enumerate(batches):
        _write(tmp_path / "ads", f"{n}.json", rows)
        query = ST.stream_to_table(stream, out, mark)
        _run(query)
        tables.append(ST.stream_progress(spark, query).where("input_rows > 0").first())
    assert [r["input_rows"] for r in tables] == [2, 3, 2, 3]
    assert [r["late_rows"] for r in tables] == [0, 0, 1, 1]
    assert tables[0]["state_rows"] == 2 and all(r["state_rows"] >= 1 for r in tables)
    assert sorted(r[0] for r in spark.read.parquet(out).select("ad_event_id").collect()) == ["a1", "a2", "a3", "a4", "a6", "a8", "a9"]


def test_triggers_and_watermarks(spark, feeds):
    stream = R.stream_json(spark, str(feeds / "ads"), ADS)
    assert ST.event_time_watermark(stream) is not stream
    static = spark.createDataFrame([], ADS)
    assert ST.event_time_watermark(static) is static
    q = ST.with_trigger(stream.writeStream.format("noop").option("checkpointLocation", str(feeds / "c9")), "backfill").start()
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 38


def test_micro_batches_of_several_files(spark, monkeypatch):
    """Batches hold the same rows in one file each and in many, none of which one task has to make alone."""
    one = sorted(map(tuple, QUERIES["st10_stream_progress"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(queries_io, "FILE_ROWS", 5)
    assert one == sorted(map(tuple, QUERIES["st10_stream_progress"](spark, "/root/testdata/sf0.001").collect())) and len(one) == 3
