"""Merges into stored tables: parquet folders by hash bucket, of which only those that change are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..operators import merge
from .workspace import scratch

BUCKETS = 64


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table that merge_into() keeps. Each bucket is one folder, written by one task or, if it is large, by several."""
    with_bucket(df, key, buckets).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def keeping_enrichment(old: Column, new: Column) -> Column:
    """The new payload; where only the old one has `ai_enrichment`, that and `multilingual` stay, and old titles and descriptions win."""
    raw = lambda p, k: F.variant_get(F.try_parse_json(p), f"$.{k}", "variant")
    text = lambda k: F.coalesce(F.get_json_object(old, f"$.{k}"), F.get_json_object(new, f"$.{k}"))
    kept = pl.with_fields(new, {"ai_enrichment": raw(old, "ai_enrichment"), "multilingual": raw(old, "multilingual"), "title_ko": text("title_ko"), "description_ko": text("description_ko")})
    return F.when(new.isNull(), old).when(pl.has_key(old, "ai_enrichment") & ~pl.has_key(new, "ai_enrichment"), kept).otherwise(new)


def merge_into(path: str, schema: str, new: DataFrame, key: str, rules: dict[str, str], payload: str | None = None, buckets: int = BUCKETS) -> int:
    """Upsert rows (key unique) into a stored table; the number of buckets that were written.

    Only buckets that new rows fall in are read, only those in which a row really changes are written, by dynamic
    overwrite: first whole to the shared folder, then over the old ones, so a lost executor costs a retry and a second run
    of the same merge writes nothing. rules: those of merge.upsert(); `payload` is merged by keeping_enrichment().
    """
    spark, columns = new.sparkSession, [key, *rules, *([payload] if payload else [])]
    fresh = with_bucket(new.select(columns), key, buckets)
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return 0
    old = read(spark, path, schema).where(F.col("bucket").isin(touched))
    sides = [d.select(*columns) for d in (old, fresh)]
    both = merge.upsert(*sides, [key], rules)
    if payload:
        texts = sides[0].select(key, F.col(payload).alias("__old"), F.lit(True).alias("__had")).join(sides[1].select(key, F.col(payload).alias("__new")), key, "full_outer")
        both = both.join(texts, key).withColumn(payload, keeping_enrichment(F.col("__old"), F.col("__new"))).select(columns)
    merged = with_bucket(both, key, buckets)
    hold = scratch(spark, "merge")
    merged.write.partitionBy("bucket").parquet(hold)
    merged = read(spark, hold, schema)
    before = old.select(key, *[F.col(c).alias(f"__{c}") for c in columns[1:]], F.lit(True).alias("__was"))
    same = F.col("__was").isNotNull()
    for c in columns[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = [r.bucket for r in merged.join(before, key, "left").where(~same).select("bucket").distinct().collect()]
    if changed:
        merged.where(F.col("bucket").isin(changed)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(changed)
