"""Writers: partition overwrite, snapshots, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that df has rows of: delete, then insert, of one day's ranking."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, path: str, leave_out: list[str], rows: int) -> None:
    """First-paint snapshot: the first rows of an ordered frame as one JSON file, bulky fields left out."""
    df.drop(*leave_out).limit(rows).coalesce(1).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)
