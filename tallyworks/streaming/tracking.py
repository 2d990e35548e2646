"""Tracked metrics with typed state: values, a list and a timer for each item, whatever order the rows come in."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRACKED = "item long, n long, first double, latest double, delta double, growth_pct double, is_spiking boolean, history string"
POINT = "us long, event_id long, value double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clamped(harvested: Column, published: Column) -> Column:
    """When a value was taken: never before the item was published."""
    return F.greatest(harvested, published)


class Tracker(StatefulProcessor):
    """State of an item: `count`, the earliest point as `first`, and the last `keep` points as `recent`.

    A late row that is earlier than `first` becomes it, so the changes are those of all rows in order of time. An item
    without rows for `forget` of event time is forgotten by a timer. Rows are read one by one.
    """

    def __init__(self, keep: int, forget_ms: int):
        self.keep, self.forget_ms = keep, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")
        self.first = handle.getValueState("first", POINT)
        self.recent = handle.getListState("recent", POINT)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        first = tuple(self.first.get()) if self.first.exists() else None
        recent = [tuple(p) for p in self.recent.get()] if self.recent.exists() else []
        for r in rows:
            point = (r.us, r.event_id, r.value)
            n += 1
            first = point if first is None or point[:2] < first[:2] else first
            recent = sorted([*recent, point])[-self.keep :]
        self.count.update((n,))
        self.first.update(first)
        self.recent.put(recent)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(recent[-1][0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.forget_ms)
        start, latest = first[2], recent[-1][2]
        delta = latest - start
        growth = delta / max(1.0, start) * 100 if start > 0 else 0.0
        yield Row(item=key[0], n=n, first=start, latest=latest, delta=delta, growth_pct=growth, is_spiking=bool(delta >= 50 or growth >= 30), history=",".join(f"{p[2]:g}" for p in recent))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.count, self.first, self.recent):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracked(events: DataFrame, late: str = "1 day", keep: int = 7, forget: dt.timedelta = dt.timedelta(days=14)) -> DataFrame:
    """An update of each item with every batch that has rows of it. events: item, event_id, ts (clamped already), value.

    Rows later than the watermark (`late`) are dropped. Rows without item, time or value are left out. State is kept in RocksDB, on
    disk beyond what fits in memory.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("item is not null and ts is not null and value is not null").select("item", "event_id", "ts", F.unix_micros("ts").alias("us"), "value")
    grouped = rows.withWatermark("ts", late).groupBy("item")
    return grouped.transformWithState(Tracker(keep, int(forget.total_seconds() * 1000)), TRACKED, "Update", "EventTime")
