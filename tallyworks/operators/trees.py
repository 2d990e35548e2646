"""Comment trees."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import ensure_checkpoint_dir
from .ranking import top_k


def flattened(comments: DataFrame, item: str, cap: int = 100) -> DataFrame:
    """Threads in reading order: a comment, then its answers, depth first, at most `cap` of an item; depth and place.

    comments: item, id, parent_id (null at the top). Each level is one join by (item, parent); a path of ids orders them.
    Answers are followed to any depth. Comments whose parent is missing, and loops, aren't reached.
    """
    ensure_checkpoint_dir(comments.sparkSession)
    key = lambda c: F.lpad(c.cast("string"), 20, "0")
    level = comments.where(F.col("parent_id").isNull()).withColumns({"depth": F.lit(0), "path": key(F.col("id"))})
    child = comments.where(F.col("parent_id").isNotNull())
    out = level
    for depth in count(1):
        above = level.select(F.col(item), F.col("id").alias("parent_id"), F.col("path").alias("__above"))
        found = child.join(above, [item, "parent_id"]).withColumns({"depth": F.lit(depth), "path": F.concat("__above", F.lit("/"), key(F.col("id")))})
        level = found.select(out.columns).checkpoint()
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return top_k(out, [item], [F.col("path")], cap, "place").drop("path")
