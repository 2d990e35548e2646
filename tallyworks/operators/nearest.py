"""Nearest match in time, within a tolerance: both sides once in the order of time, the last and the next value carried."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of distinct times that one range has, about, and the most ranges that are cut.
RANGE_ROWS, MAX_RANGES = 100_000, 20_000


def carried(times: DataFrame, at: str, value: str, ranges: int) -> DataFrame:
    """times with `before` and `after`: the last non-null `value` at or before `at`, and the first at or after it.

    `at` (long) is unique. Ranges of about equal size are cut at approximate quantiles; within a range the values are running ones, and
    what lies beyond its borders is carried over from the ranges beside it, of which there is one row each.
    """
    marks = times.withColumn("__at", F.col(at).cast("double"))
    cuts = sorted(set(marks.approxQuantile("__at", [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    if cuts:
        times = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__at", outputCol="__range").transform(marks).drop("__at")
    within = Window.partitionBy("__range") if cuts else Window.partitionBy()  # range_rows rows, if there is but one range
    up, down = (within.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(at), F.desc(at)))
    out = times.withColumn("__b", F.last(value, ignorenulls=True).over(up)).withColumn("__a", F.last(value, ignorenulls=True).over(down))
    if not cuts:
        return out.withColumnsRenamed({"__b": "before", "__a": "after"})
    borders = times.where(F.col(value).isNotNull()).groupBy("__range").agg(F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last"))
    everywhere = times.select("__range").distinct().join(borders, "__range", "left")
    ordered = Window.orderBy("__range")  # a row for each range
    beside = everywhere.select("__range", F.last("__last", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("__low"), F.last("__first", ignorenulls=True).over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__high"))
    return out.join(F.broadcast(beside), "__range").select(*[c for c in times.columns if c != "__range"], F.coalesce("__b", "__low").alias("before"), F.coalesce("__a", "__high").alias("after"))


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, left_ts: str, right_id: str, right_ts: str, seconds: float = 300, range_rows: int = RANGE_ROWS) -> DataFrame:
    """left with the row of right closest to it, strictly nearer than `seconds`; null without one; ties by right_id.

    Each distinct time of either side is one row, with the smallest right_id there; so a moment that holds a third of all
    rows is one row too. A left row has two candidates at most, whatever the density: work grows with the rows, not with the
    pairs. Rows of left without a time match nothing, those of right are left out.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = left.select(micros(left_ts).alias("__us"), F.lit(None).cast(right.schema[right_id].dataType).alias("__id"))
    times = own.unionByName(right.select(micros(right_ts).alias("__us"), F.col(right_id).alias("__id"))).where("__us is not null")
    times = times.groupBy("__us").agg(F.min("__id").alias("__id"))
    times = times.select("__us", F.when(F.col("__id").isNotNull(), F.struct(F.col("__us").alias("us"), F.col("__id").alias("id"))).alias("__hit"))
    near = carried(times, "__us", "__hit", min(MAX_RANGES, -(-times.count() // range_rows)))
    gap = lambda c: F.abs(F.col(f"{c}.us") - F.col("__us")) / 1e6
    side: list[Column] = [F.when(gap(c) < seconds, F.struct(gap(c).alias("gap_s"), F.col(f"{c}.id").alias(right_id))) for c in ("before", "after")]
    best = near.select("__us", F.least(*side).alias("__best")).where("__best is not null")
    return left.withColumn("__us", micros(left_ts)).join(best, "__us", "left").select(*left.columns, f"__best.{right_id}", "__best.gap_s")
