"""Inverted-file index over vectors: every row belongs to the list of its nearest centroid, a search reads a few lists.

Centroids are fitted on a bounded sample, every row is assigned, and the number of lists that a search probes is chosen so that
a measured share of the true neighbours is found. similarity.knn() is the exact form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import scratch
from .similarity import best_of, knn

#: The most rows that centroids are fitted on, and the most lists: what the driver holds, and what is sent to each task.
FIT_ROWS, MAX_LISTS = 32_768, 1024
#: Rows of a list, and queries of a list, that meet in one group: larger ones are split.
PART_ROWS = 8192


@dataclass
class Index:
    """rows: list, part, vec_id, embedding; of each list in parts of about PART_ROWS. Rows without direction are in none."""

    centroids: np.ndarray
    rows: DataFrame
    parts: DataFrame

    @property
    def lists(self) -> int:
        return len(self.centroids)


def unit(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have this width and a direction, and these vectors at length 1."""
    at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width], np.int64)
    x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good] / norm[good, None]


def fit(df: DataFrame, lists: int, fit_rows: int = FIT_ROWS, rounds: int = 10) -> np.ndarray:
    """Centroids of spherical k-means on at most fit_rows rows, those of smallest hash; vectors of the commonest width count."""
    some = df.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()
    widths, counts = np.unique([len(r.embedding) for r in some] or [1], return_counts=True)
    x = unit([r.embedding for r in some], int(widths[counts.argmax()]))[1]
    x = np.unique(x, axis=0) if len(x) else np.eye(1, int(widths[counts.argmax()]))
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1))
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], c)
    return c


def assigned(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """list, place (from 0), vec_id, embedding: each row on the lists of its `probes` nearest centroids."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for whole in frames:
            for begin in range(0, len(whole), 1024):
                pdf = whole.iloc[begin : begin + 1024]
                at, x = unit(pdf["embedding"].tolist(), c.shape[1])
                if not len(at):
                    continue
                sim = x @ c.T
                best = np.argsort(-sim, 1, kind="stable")[:, :probes]
                rows = np.repeat(at, best.shape[1])
                yield pd.DataFrame({"list": best.ravel(), "place": np.tile(np.arange(best.shape[1]), len(at)), "vec_id": pdf["vec_id"].to_numpy()[rows], "embedding": [pdf["embedding"].iloc[i] for i in rows]})

    return df.select("vec_id", "embedding").mapInPandas(run, "list int, place int, vec_id long, embedding array<double>")


def build(df: DataFrame, lists: int | None = None, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS) -> Index:
    """Index of all rows of df (vec_id, embedding), written to the shared folder. lists: sqrt(rows) if not given, MAX_LISTS at most.

    Null and zero vectors, and those of another width than the commonest of the sample, are on no list and match nothing.
    """
    spark = df.sparkSession
    lists = lists or min(MAX_LISTS, max(1, round(df.count() ** 0.5)))
    centroids, path = fit(df, lists, fit_rows), scratch(spark, "vector-index")
    assigned(df, centroids, 1).drop("place").write.parquet(path)
    rows = spark.read.schema("list int, vec_id long, embedding array<double>").parquet(path)
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # a row for each list
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    return Index(centroids, rows.join(F.broadcast(parts), "list").select("list", part, "vec_id", "embedding"), parts)


def search(index: Index, queries: DataFrame, k: int, probes: int, part_rows: int = PART_ROWS) -> DataFrame:
    """a_id, b_id, similarity, rank_position: of each query the k nearest other rows on its `probes` nearest lists, ties by b_id.

    Queries and rows of a list meet in groups of about part_rows by part_rows, each of which keeps k rows a query. With as many
    probes as lists the result is that of the exact search.
    """
    width = index.centroids.shape[1]
    asked = assigned(queries, index.centroids, probes).drop("place")
    asked_parts = asked.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("shares"))
    sizes = index.parts.join(F.broadcast(asked_parts), "list")  # a row for each list
    share = F.pmod(F.xxhash64("vec_id"), F.col("shares")).cast("int").alias("share")
    left = asked.join(F.broadcast(sizes), "list").select("list", share, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "embedding")
    right = index.rows.join(F.broadcast(asked_parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "part", "vec_id", "embedding")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, own = a["vec_id"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64)
        found, cosine = best_of(ids, unit(a["embedding"].tolist(), width)[1], own, unit(b["embedding"].tolist(), width)[1], k)
        keep = np.isfinite(cosine)
        return pd.DataFrame({"a_id": np.repeat(ids, keep.sum(1)), "b_id": found[keep], "similarity": cosine[keep]})

    met = left.groupBy("list", "part", "share").cogroup(right.groupBy("list", "part", "share")).applyInPandas(meet, "a_id long, b_id long, similarity double")
    best = Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id")
    return met.withColumn("rank_position", F.row_number().over(best)).where(F.col("rank_position") <= k)


def probes_for(index: Index, df: DataFrame, k: int, recall: float = 0.95, queries: int = 128) -> int:
    """The fewest probes that find a share `recall` of the true k nearest of a few queries (those of smallest hash), by one exact pass."""
    some = df.where("embedding is not null").select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(queries)
    true = knn(df, some, k).select("a_id", F.col("b_id").alias("vec_id"))
    where = true.join(index.rows.select("vec_id", "list"), "vec_id").select("a_id", "list")
    ranks = assigned(some, index.centroids, index.lists).select(F.col("vec_id").alias("a_id"), "list", "place")
    places = np.sort([r.place for r in where.join(ranks, ["a_id", "list"]).select("place").collect()])  # queries * k at most
    return int(places[int(np.ceil(recall * len(places))) - 1]) + 1 if len(places) else 1
