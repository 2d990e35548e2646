"""Typed state: late rows, expiry, and equality with the whole history."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyworks.streaming import slots, tracking

KIND = "item long, event_id long, ts timestamp, value double"


def run(spark, tmp_path, batches, **kw):
    """One micro-batch for each list of rows; all updates with the number of their batch."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(folder))
    out = slots.drain(tracking.tracked(stream, **kw), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    return out.withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("int")).orderBy("batch", "item").collect()


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_a_late_row_corrects_the_first(spark, tmp_path):
    got = run(spark, tmp_path, [[(1, 1, at(10), 20.0), (2, 2, at(10), 1.0)], [(1, 3, at(12), 50.0)], [(1, 4, at(2), 5.0), (None, 5, at(3), 1.0), (1, 6, None, 1.0), (1, 7, at(3), None)]])
    of = [r for r in got if r.item == 1]
    assert [(r.n, r["first"], r.latest, r.delta, r.history) for r in of] == [(1, 20.0, 20.0, 0.0, "20"), (2, 20.0, 50.0, 30.0, "20,50"), (3, 5.0, 50.0, 45.0, "5,20,50")]
    assert [r.is_spiking for r in of] == [False, True, True] and of[-1].growth_pct == 900.0


def test_idle_items_are_forgotten(spark, tmp_path):
    late = [[(9, 100 + i, at(24 * (40 + i)), 1.0)] for i in range(3)]
    got = run(spark, tmp_path, [[(1, 1, at(0), 10.0)], *late, [(1, 2, at(24 * 42), 30.0)]])
    assert [(r.n, r.delta) for r in got if r.item == 1] == [(1, 0.0), (1, 0.0)]


def test_the_end_is_that_of_all_rows_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 8), i, at(rng.randint(0, 20)), round(rng.uniform(-3, 90), 1)) for i in range(200)]
    got = run(spark, tmp_path, [rows[i : i + 50] for i in range(0, 200, 50)], late="30 days")
    last = {r.item: r for r in got}
    for item in {r[0] for r in rows}:
        own = sorted((t, e, v) for k, e, t, v in rows if k == item)
        r = last[item]
        assert (r.n, r["first"], r.latest, r.history) == (len(own), own[0][2], own[-1][2], ",".join(f"{v:g}" for *_, v in own[-7:]))
