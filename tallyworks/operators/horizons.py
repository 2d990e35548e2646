"""Many sliding horizons at once: events are summed in panes, horizons are made of panes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZON_HOURS = (12, 24, 48, 72, 168, 336, 720)
PANE_HOURS = 6


def panes(events: DataFrame, key: str, ts: str, value: str, pane_hours: int = PANE_HOURS) -> DataFrame:
    """key, pane (number since 1970), n, total, low, high: partial aggregates, one row for each key and pane that has events."""
    pane = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (3600 * pane_hours))
    return events.where(F.col(ts).isNotNull()).groupBy(key, pane.alias("pane")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def horizons(rows: DataFrame, key: str, hours: tuple[int, ...] = HORIZON_HOURS, pane_hours: int = PANE_HOURS) -> DataFrame:
    """rows of panes() with n_<h>h, total_<h>h, delta_<h>h (highest less lowest) over the h hours that end with the pane.

    All horizons share one sort by key and pane. Counts and totals are differences of running sums; lowest and highest are
    taken over the panes of the horizon, hours / pane_hours rows at most. What a key has in one task is its panes, which
    grow with time, not with its events.
    """
    if any(h % pane_hours for h in hours):
        raise ValueError("horizons must be whole panes")
    w = Window.partitionBy(key).orderBy("pane")
    so_far = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({"__n": F.sum("n").over(so_far), "__total": F.sum("total").over(so_far)})
    out = {}
    for h in hours:
        before, within = w.rangeBetween(Window.unboundedPreceding, -(h // pane_hours)), w.rangeBetween(-(h // pane_hours) + 1, Window.currentRow)
        out[f"n_{h}h"] = F.col("__n") - F.coalesce(F.last("__n").over(before), F.lit(0))
        out[f"total_{h}h"] = F.col("__total") - F.coalesce(F.last("__total", ignorenulls=True).over(before), F.lit(0.0))
        out[f"delta_{h}h"] = F.max("high").over(within) - F.min("low").over(within)
    return running.withColumns(out).select(key, "pane", *out)
