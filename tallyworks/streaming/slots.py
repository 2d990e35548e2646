"""Structured Streaming over event files: slot counts, tracked metrics, dedup, all with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def slot_counts(events: DataFrame, late: str = "6 hours", slot: str = "6 hours", offset: str = "3 hours") -> DataFrame:
    """Counts by tumbling slot (from 00:00 at nine hours ahead of UTC) and type; state of a slot goes when it is `late` past."""
    w = F.window("ts", slot, slot, offset)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("slot_start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """Day-long windows that slide by six hours."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "6 hours"), "user_id").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("delta")).select(F.col("window.start").alias("window_start"), "user_id", "n", "delta")


def first_seen(events: DataFrame, keys: list[str], horizon: str = "14 days") -> DataFrame:
    """Repeated events within the horizon are dropped; state older than it goes."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


TRACKED = "user_id long, n long, first double, latest double, delta double, growth_pct double, is_spiking boolean, history string"
STATE = "n long, first double, at timestamp, history array<double>"


def tracked_metrics(events: DataFrame, keep: int = 7, forget: str = "14 days") -> DataFrame:
    """First and latest value of each item, change, growth in percent and the last `keep` values; idle items are forgotten.

    Within a micro-batch values are taken in order of time; one older than the latest known is counted but isn't the latest.
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        n, first, at, history = state.get if state.exists else (0, float(rows["value"].iloc[0]), rows["ts"].iloc[0], [])
        history = list(history)
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            n += 1
            if pd.Timestamp(ts) >= pd.Timestamp(at):
                at = ts
                history = [*history, float(value)][-keep:]
        latest = history[-1]
        delta = latest - first
        growth = delta / max(1.0, first) * 100 if first > 0 else 0.0
        state.update((n, first, pd.Timestamp(at).to_pydatetime(), history))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first": [first], "latest": [latest], "delta": [delta], "growth_pct": [growth], "is_spiking": [bool(delta >= 50 or growth >= 30)], "history": [",".join(f"{v:g}" for v in history)]})

    known = events.select("event_id", "user_id", "ts", "value").withWatermark("ts", "1 day")
    return known.groupBy("user_id").applyInPandasWithState(update, TRACKED, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all that is there in micro-batches, then stop; the rows as files below path, each batch in a folder of its own.

    A batch that runs again overwrites its folder. In complete mode only the last batch counts. Nothing passes the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode != 'complete' else 0}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def drain_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Exactly-once files of all that is there."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
