import pytest
from pyspark.sql import functions as F

from tallyworks.streaming import slots


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 40:02d} {i * 7 % 24:02d}:{i % 60:02d}:00", i % 5, ["click", "view"][i % 2], float(i * 13 % 90), "{}") for i in range(200)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    for k in range(4):
        batch.where(F.col("event_id").between(50 * k, 50 * k + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, str(tmp_path / "in"), tmp_path


def test_slots_equal_batch(spark, folder):
    batch, path, tmp = folder
    streamed = slots.drain(slots.slot_counts(slots.event_stream(spark, path, 1), late="60 days"), str(tmp / "slot_out"), str(tmp / "c1"), "complete")
    expect = batch.groupBy(F.window("ts", "6 hours", "6 hours", "3 hours").start.alias("slot_start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, expect.collect()))


def test_repeats_are_dropped(spark, folder):
    batch, path, tmp = folder
    batch.limit(30).write.mode("append").parquet(path)
    slots.drain_to_parquet(slots.first_seen(slots.event_stream(spark, path), ["event_id"]), str(tmp / "out"), str(tmp / "c2"))
    out = spark.read.parquet(str(tmp / "out"))
    assert out.count() == out.select("event_id").distinct().count() == 200


def test_tracked_metrics_end_where_the_series_ends(spark, folder):
    batch, path, tmp = folder
    got = slots.drain(slots.tracked_metrics(slots.event_stream(spark, path, 2)), str(tmp / "tracked_out"), str(tmp / "c3"), "update")
    last = {r.user_id: r for r in got.orderBy("n").collect()}
    for user in range(5):
        values = [r.value for r in batch.where(F.col("user_id") == user).orderBy("ts", "event_id").collect()]
        r = last[user]
        assert r.n == 40 and r.latest == values[-1] and r.history == ",".join(f"{v:g}" for v in values[-7:])
    assert slots.drain(slots.sliding_counts(slots.event_stream(spark, path), "60 days"), str(tmp / "slide_out"), str(tmp / "c4"), "complete").count() > 0
