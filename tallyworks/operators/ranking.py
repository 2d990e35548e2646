"""Windows and top-k: ranks within a key, latest of a key, running peaks, histories, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank_position") -> DataFrame:
    """The first k rows of each key. Spark keeps k rows a task before the shuffle (group limit), so hot keys stay small."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__n").drop("__n")


def peaks(df: DataFrame, item: str, date: str, score: str, rank: str) -> DataFrame:
    """Highest score of an item with its earliest date, and its best rank: partial aggregates, no window."""
    best = F.max(F.struct(F.col(score), (-F.unix_date(F.col(date))).alias("d"))).alias("best")
    out = df.groupBy(item).agg(best, F.min(rank).alias("best_rank"))
    return out.select(item, F.col(f"best.{score}").alias("peak_score"), F.date_from_unix_date(-F.col("best.d")).alias("peak_date"), "best_rank")


def tracked(df: DataFrame, item: str, order: list[str], value: str, keep: int = 7) -> DataFrame:
    """Step and total change, growth in percent, spiking, and the last `keep` values as text, for each point of a series."""
    w = Window.partitionBy(item).orderBy(*order)
    first, last = F.first(value).over(w), F.lag(value).over(w)
    growth = F.when(first > 0, (F.col(value) - first) / F.greatest(first, F.lit(1)) * 100).otherwise(F.lit(0.0))
    recent = F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(-(keep - 1), 0))
    out = df.withColumns({"delta": F.col(value) - first, "step": F.coalesce(F.col(value) - last, F.col(value) * 0), "growth_pct": growth, "history": F.array_join(recent, ",")})
    return out.withColumn("is_spiking", (F.col("delta") >= 50) | (F.col("growth_pct") >= 30))


def rank_calendar(df: DataFrame, date: str, rank: str, columns: list[str]) -> DataFrame:
    """Rows a date, highest score, and the columns of its first rank."""
    return df.groupBy(date).agg(F.count("*").alias("n_items"), F.max("score").alias("top_score"), *[F.min_by(c, rank).alias(f"top_{c}") for c in columns])
