"""Operators over items of the domain: lookups by several keys, gates with a fallback, release clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_any(df: DataFrame, index: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with `value` of index by the first of several keys that hits; of one key the smallest value. One join for each key."""
    out = df
    for i, k in enumerate(keys):
        found = index.where(F.col(k).isNotNull()).groupBy(F.col(k)).agg(F.min(value).alias(f"__{i}"))
        out = out.join(found, k, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"__{i}") for i in range(len(keys))])).drop(*[f"__{i}" for i in range(len(keys))])


def gated(df: DataFrame, strict: Column, loose: Column, least: int) -> DataFrame:
    """Rows that pass the strict gate; if fewer than `least` do, those of the loose one too. The count is a scalar subquery."""
    return df.where(strict | (loose & (df.agg(F.count_if(strict)).scalar() < least)))


def release_clusters(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Members of keys with two or more rows on two or more platforms: the hub (highest `order`, a struct that ends in a
    unique column) and whether a row is archived. A hub is an aggregate that is joined back, so that no key meets in one task."""
    keyed = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    hubs = keyed.groupBy(key).agg(F.max_by("id", order).alias("hub_id"), F.count("*").alias("n"), F.count_distinct("platform").alias("n_platforms")).where("n > 1 and n_platforms > 1")
    return keyed.join(hubs, key).withColumn("archived", F.col("id") != F.col("hub_id"))
