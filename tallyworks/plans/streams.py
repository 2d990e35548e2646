"""Streaming queries run to the end of what is there; their SQL is the same over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.workspace import scratch
from ..streaming import slots, tracking


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files. Its times have no zone and are read as UTC."""
    raw = spark.readStream.schema(slots.EVENTS.replace("ts timestamp", "ts timestamp_ntz")).parquet(f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    return slots.drain(df, scratch(df.sparkSession, name), scratch(df.sparkSession, f"{name}-state"), mode)


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, INTERVAL 3 HOUR) AS slot_start, event_type, value FROM events)
SELECT strftime(slot_start, '%Y-%m-%d %H') AS slot_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL
""")
def stream_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling six-hour slots of the stream."""
    out = drained(slots.slot_counts(events(spark, sf_dir), late="60 days"), "stream_slots", "complete")
    return out.select(F.date_format("slot_start", "yyyy-MM-dd HH").alias("slot_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH e AS (SELECT user_id, value, ts, event_id, first_value(value) OVER w AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id) AS n, round(value, 3) AS latest, round(value - f, 3) AS delta FROM e WHERE r = 1
""")
def stream_tracked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful tracking of each user's values, as it stands at the end of the stream."""
    out = drained(slots.tracked_metrics(events(spark, sf_dir)), "stream_tracked", "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "latest", "delta"), "n").alias("x"))
    return last.select("user_id", "x.n", F.round("x.latest", 3).alias("latest"), F.round("x.delta", 3).alias("delta"))


@query("""
WITH e AS (SELECT user_id, event_id, value, greatest(ts, date_trunc('hour', ts) + INTERVAL 30 MINUTE) AS seen FROM events),
f AS (SELECT user_id, count(*) AS n, arg_min(value, [epoch_us(seen), event_id]) AS first, arg_max(value, [epoch_us(seen), event_id]) AS latest FROM e GROUP BY 1)
SELECT user_id, n, round(first, 3) AS first, round(latest, 3) AS latest, round(latest - first, 3) AS delta, latest - first >= 50 OR first > 0 AND (latest - first) / greatest(1.0, first) * 100 >= 30 AS is_spiking FROM f
""")
def stream_typed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values with typed state, times clamped to the publication at half past; as it stands at the end of the stream."""
    e = events(spark, sf_dir)
    seen = tracking.clamped(F.col("ts"), F.date_trunc("hour", "ts") + F.expr("INTERVAL 30 MINUTES"))
    out = drained(tracking.tracked(e.select(F.col("user_id").alias("item"), "event_id", seen.alias("ts"), "value"), late="60 days"), "stream_typed", "update")
    last = out.groupBy(F.col("item").alias("user_id")).agg(F.max_by(F.struct("n", "first", "latest", "delta", "is_spiking"), "n").alias("x"))
    return last.select("user_id", "x.n", *[F.round(f"x.{c}", 3).alias(c) for c in ("first", "latest", "delta")], "x.is_spiking")
