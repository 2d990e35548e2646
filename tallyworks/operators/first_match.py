"""Clusters by ordered first match: every item joins the first cluster, by age, that one of several tests accepts.

What an item joins follows from what all before it have joined, so the decisions are a chain. Spark makes the rows, all at once: hashes
of words and values, entity masks, and until when a row can still be met; then ranges of ids are decided one after another, each by one
task, which gets its rows and the clusters that can still be met, and passes these on. What a task holds is bounded by a range of rows,
the clusters of a window of time, and older clusters with a URL that occurs again.

Values and words are compared by their hashes of 64 bits.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_specific_entity
from ..sources.workspace import dropped, written
from .similarity import anchors_of, entity_mask

#: The bucket of rows without a time.
UNTIMED = -1
KEY_STOP_WORDS = "the a an and or in on of to with by for".split()
#: Rows of a range, and after how many of them clusters that can't be met any more are forgotten.
RANGE, SWEEP = 16_384, 1024
ROW = "id long, hub long, ts double, until long, mask int, entity long, specific boolean, urls array<long>, url_until array<long>, tokens array<long>, parts array<long>, en array<long>, own array<long>, near array<long>"


def first_match_clusters(items: DataFrame, near: DataFrame | None = None, hours: float = 72.0, rows: int = RANGE) -> DataFrame:
    """id, hub: the cluster of each item, named by its first item.

    items: id (long, the order; unique), ts (seconds; null or 0: unknown), urls, tokens, en (sets of words of the title), key, entity.
    near: id, other: pairs whose embeddings are near enough. An item joins a cluster, the oldest first, unless the
    major entities of both differ (of the cluster those of all its items so far), if
    - they share a URL, of the cluster that of any of its items so far, or
    - the cluster's first item is within `hours`, and they have one specific entity, or similar story keys, or near embeddings,
      or titles that pass the gate (anchors, or three words and 0.55 of the smaller set), or a Jaccard similarity of 0.5
      between its English words and those of all items of the cluster so far.
    Null sets are empty, null names are none. A cluster has the key, title and time of its first item and the first entity.
    """
    spark, span = items.sparkSession, hours * 3600
    made = written(_prepared(items, near, span), "first-match-rows")
    n_ranges = max(1, -(-made.count() // rows))
    dealt = written(made.repartitionByRange(n_ranges, "id").sortWithinPartitions("id"), "first-match-ranges")
    dropped(made)
    files = sorted(dealt.inputFiles())
    together, steps, state = -(-len(files) // n_ranges) if files else 1, [], None
    for at in range(0, len(files), together):
        own = spark.read.schema(ROW).parquet(*files[at : at + together])
        last = own.agg(F.max("id")).first()[0]
        if last is None:
            continue
        both = (own if state is None else own.unionByName(state)).coalesce(1).sortWithinPartitions(F.col("hub").isNull(), "id")
        steps.append(written(both.mapInArrow(_decided(span, last), ROW), "first-match-decided"))
        state = steps[-1].where("until is not null")
    out = spark.createDataFrame([], ROW) if not steps else spark.read.schema(ROW).parquet(*[f for step in steps for f in step.inputFiles()])
    out = written(out.where("until is null").select("id", "hub"), "first-match")
    for table in (dealt, *steps):
        dropped(table)
    return out


def _prepared(items: DataFrame, near: DataFrame | None, span: float) -> DataFrame:
    """The columns of ROW, without a hub. until: the last id that can lie within the window of a row; url_until: the last with that URL."""
    words = lambda c: F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    hashed = lambda c: F.transform(c, lambda v: F.xxhash64(v))
    named = lambda name, v: F.xxhash64(F.lit(name), v.cast("string"))
    ts, key, entity = F.when(F.col("ts") > 0, F.col("ts").cast("double")), F.coalesce("key", F.lit("")), F.coalesce("entity", F.lit(""))
    parts = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(key), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, KEY_STOP_WORDS)))
    own: Column = F.concat(F.transform(anchors_of(words("tokens")), lambda a: named("anchor", a)), F.when(key != "", F.array(named("key", key))).otherwise(F.array().cast("array<long>")))
    rows = items.select(
        F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("hub"), ts.alias("ts"), F.coalesce(F.floor(ts / span), F.lit(UNTIMED)).alias("bucket"), entity_mask(words("tokens")).cast("int").alias("mask"),
        F.when(entity != "", F.xxhash64(entity)).alias("entity"), ((F.length(entity) >= 3) & is_specific_entity(entity)).alias("specific"), hashed(F.filter(words("urls"), lambda u: u != "")).alias("urls"),
        hashed(words("tokens")).alias("tokens"), hashed(parts).alias("parts"), hashed(words("en")).alias("en"), own.alias("own"),
    )
    rows = written(rows, "first-match-hashes")
    last = rows.groupBy("bucket").agg(F.max("id").alias("last"))
    reached = F.explode(F.when(F.col("bucket") == UNTIMED, F.array("bucket")).otherwise(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    until = last.where(f"bucket != {UNTIMED}").select(reached.alias("bucket"), "last").groupBy("bucket").agg(F.max("last").alias("near_last"))
    ends = rows.agg(F.max("id").alias("end"), F.max(F.when(F.col("bucket") == UNTIMED, F.col("id"))).alias("untimed_end"))
    placed = rows.join(until, "bucket", "left").crossJoin(F.broadcast(ends)).withColumn("until", F.when(F.col("bucket") == UNTIMED, F.col("end")).otherwise(F.greatest("near_last", "untimed_end")))

    held = rows.select("id", F.explode("urls").alias("url"))
    again = held.groupBy("url").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    of_row = held.join(again, "url").groupBy("id").agg(F.collect_list(F.struct("url", "last")).alias("again"))
    none = F.array().cast("array<long>")
    out = placed.join(of_row, "id", "left").withColumn("urls", F.coalesce("again.url", none)).withColumn("url_until", F.coalesce("again.last", none))
    if near is None:
        return out.withColumn("near", none).select(*[c.split()[0] for c in ROW.split(", ")])
    pairs = near.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).where("id != other").groupBy("id").agg(F.collect_set("other").alias("near"))
    return out.join(pairs, "id", "left").withColumn("near", F.coalesce("near", none)).select(*[c.split()[0] for c in ROW.split(", ")])


class Clusters:
    """The clusters that can still be met, oldest first, and where their words and values stand."""

    def __init__(self):
        self.held: list[dict] = []
        self.found: dict[str, dict[int, array]] = {k: {} for k in ("tokens", "parts", "en", "own", "urls", "entity")}
        self.place: dict[int, int] = {}
        self._sizes()

    def _sizes(self) -> None:
        self.n = {k: np.array([len(c[k]) for c in self.held] or [0], np.int64) for k in ("tokens", "parts", "en")}
        self.ts = np.array([np.nan if c["ts"] is None else c["ts"] for c in self.held] or [np.nan])

    def add(self, cluster: dict) -> None:
        at = len(self.held)
        self.held.append(cluster)
        self.place[cluster["hub"]] = at
        for kind in ("tokens", "parts", "en", "own", "urls"):
            for v in cluster[kind]:
                self.found[kind].setdefault(v, array("q")).append(at)
        if cluster["entity"] is not None:
            self.found["entity"].setdefault(cluster["entity"], array("q")).append(at)
        if at >= len(self.ts):  # room for twice as many
            self.ts = np.concatenate([self.ts, np.full(len(self.ts), np.nan)])
            self.n = {k: np.concatenate([v, np.zeros(len(v), np.int64)]) for k, v in self.n.items()}
        self.ts[at] = np.nan if cluster["ts"] is None else cluster["ts"]
        for kind, n in self.n.items():
            n[at] = len(cluster[kind])

    def join(self, at: int, row: dict) -> None:
        cluster = self.held[at]
        cluster["mask"] |= row["mask"]
        for kind in ("en", "urls"):
            for v in row[kind]:
                if v not in cluster[kind]:
                    self.found[kind].setdefault(v, array("q")).append(at)
            cluster[kind].update(row[kind])
        self.n["en"][at] = len(cluster["en"])
        if cluster["entity"] is None and row["entity"] is not None:
            cluster["entity"] = row["entity"]
            self.found["entity"].setdefault(row["entity"], array("q")).append(at)

    def first(self, row: dict, span: float) -> int | None:
        """The oldest cluster that accepts a row."""
        size = len(self.held)
        if not size:
            return None
        timely = [at for v in row["own"] for at in self.found["own"].get(v, ())] + [self.place[x] for x in row["near"] if x in self.place]
        if row["specific"]:
            timely += self.found["entity"].get(row["entity"], ())
        able = np.zeros(size, bool)
        able[timely] = True
        for kind in ("tokens", "parts", "en"):
            met = [np.frombuffer(self.found[kind][v], np.int64) for v in row[kind] if v in self.found[kind]]
            if met:
                own, n = len(row[kind]), self.n[kind][:size]
                shared = np.bincount(np.concatenate(met), minlength=size)
                met.clear()  # an array that is looked at can't grow
                if kind == "en":
                    able |= shared >= 0.5 * (own + n - shared)
                else:
                    able |= (shared >= 3) & (shared >= (0.55 if kind == "tokens" else 0.5) * np.minimum(own, n) - 1e-9)
        if row["ts"] is not None:
            able &= ~(np.abs(self.ts[:size] - row["ts"]) > span)
        able[[at for v in row["urls"] for at in self.found["urls"].get(v, ())]] = True
        for at in np.flatnonzero(able).tolist():
            if not row["mask"] or not self.held[at]["mask"] or row["mask"] == self.held[at]["mask"]:
                return at
        return None

    def kept(self, after: int) -> Clusters:
        """Those that a row with a larger id than `after` can meet; what only a URL leads to keeps that and its entities alone."""
        out = Clusters()
        for c in self.held:
            c["urls"] = {u: until for u, until in c["urls"].items() if until > after}
            if c["until"] > after or c["urls"]:
                out.add(c if c["until"] > after else c | {"tokens": set(), "parts": set(), "en": set(), "own": set(), "entity": None, "ts": c["ts"]})
        return out


def _decided(span: float, last: int):  # noqa: ANN202
    names = [c.split()[0] for c in ROW.split(", ")]
    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, [long, long, pa.float64(), long, pa.int32(), long, pa.bool_(), *[longs] * 7], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, seen = Clusters(), 0
        for batch in batches:
            ids, hubs = [], []
            for row in batch.to_pylist():
                row["urls"] = dict(zip(row["urls"], row["url_until"], strict=True))
                for kind in ("tokens", "parts", "en", "own"):
                    row[kind] = set(row[kind])
                if row["hub"] is not None:  # a cluster of the ranges before
                    clusters.add(row)
                    continue
                at = clusters.first(row, span)
                if at is None:
                    row["hub"] = row["id"]
                    clusters.add(row)
                else:
                    clusters.join(at, row)
                    row["hub"] = clusters.held[at]["hub"]
                ids.append(row["id"])
                hubs.append(row["hub"])
                seen += 1
                if seen % SWEEP == 0:
                    clusters = clusters.kept(row["id"])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, long), pa.array(hubs, long), *[pa.nulls(len(ids), f.type) for f in list(schema)[2:]]], schema=schema)
        held = clusters.kept(last).held
        for at in range(0, len(held), 1024):
            part = [c | {"id": c["hub"], "urls": list(c["urls"]), "url_until": list(c["urls"].values()), "near": [], **{k: list(c[k]) for k in ("tokens", "parts", "en", "own")}} for c in held[at : at + 1024]]
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    return run
