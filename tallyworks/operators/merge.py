"""Upserts without a transactional format: old and new rows in, the table after the merge out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer join by key. Rules by column: old, new (first that isn't null), greatest, least, or (booleans), and
    newer:t, the new value where it isn't null and its row's t is later than the old one's (a missing t is the earliest), else the old."""
    a, b = old.alias("a"), new.alias("b")

    def merged(c: str, rule: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if rule.startswith("newer:"):
            before, after = (F.col(f"{side}.{rule[6:]}") for side in "ab")
            return F.when(y.isNotNull() & (x.isNull() & before.isNull() | F.coalesce(after > before, before.isNull() & after.isNotNull())), y).otherwise(x).alias(c)
        return {"old": F.coalesce(x, y), "new": F.coalesce(y, x), "greatest": F.greatest(x, y), "least": F.least(x, y), "or": F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))}[rule].alias(c)

    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[merged(c, r) for c, r in rules.items()])


def upsert_by_union(old: DataFrame, new: DataFrame, keys: list[str], greatest: list[str], by_score: list[str], score: str, first: list[str] = ()) -> DataFrame:
    """Greatest of metrics; `by_score` columns of the row with the higher score, the new one at a tie; `first` of the old row if there is one. One shuffle, partial aggregates."""
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in greatest], *[F.max_by(c, F.struct(score, "is_new")).alias(c) for c in by_score], *[F.min_by(c, "is_new").alias(c) for c in first])


def longest_wins(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    both = old.select(key, body, F.lit(0).alias("new")).unionByName(new.select(key, body, F.lit(1).alias("new")))
    return both.groupBy(key).agg(F.max_by(body, F.struct(F.length(body), "new")).alias(body))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete by key, then insert: children of keys that come new are all replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def changed(old: DataFrame, new: DataFrame, key: str, numbers: dict[str, float], others: list[str]) -> DataFrame:
    """Rows of new that are missing in old or differ: numbers by at least so much, others at all."""
    a = old.select(key, *[F.col(c).alias(f"__{c}") for c in (*numbers, *others)], F.lit(True).alias("__had"))
    differs = F.col("__had").isNull()
    for c, least in numbers.items():
        differs = differs | (F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.coalesce(F.col(f"__{c}"), F.lit(0.0))) >= least)
    for c in others:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return new.join(a, key, "left").where(differs).select(new.columns)


def retained(df: DataFrame, ts: str, as_of: Column, days: int = 14) -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))
