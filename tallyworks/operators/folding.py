"""Folds in which what is kept depends on what was kept before, done in rounds over all groups at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import canonical_platform
from ..sources.workspace import ensure_checkpoint_dir


def first_unique(df: DataFrame, group: list[str], keys: list[str], order: str) -> DataFrame:
    """Rows that share no key's value with an earlier kept row of their group. Exact; `order` is unique within a group.

    A row that is the first of all its values among the undecided is kept, and all that share one with it go: those are the
    sequential decisions, whatever the number of rounds. Rounds are counted by the longest chain of rows that wait for one
    another, not by the rows of a group, and no group meets in a task. Nulls are values like others.
    """
    ensure_checkpoint_dir(df.sparkSession)
    left = df.groupBy(*group, *keys).agg(F.min(order).alias(order)).checkpoint()  # of equal ones only the first can stay
    same: Callable[[DataFrame, DataFrame, list[str]], list[Column]] = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    kept = None
    while True:
        first = left
        for i, k in enumerate(keys):
            least = left.groupBy(*group, k).agg(F.min(order).alias(f"__m{i}")).withColumnsRenamed({c: f"__g{i}_{c}" for c in (*group, k)})
            first = first.join(least, [F.col(c).eqNullSafe(F.col(f"__g{i}_{c}")) for c in (*group, k)]).where(F.col(order) == F.col(f"__m{i}"))
        first = first.select(*group, *keys, order).checkpoint()
        kept = first if kept is None else kept.unionByName(first)
        for k in keys:
            gone = first.select(*group, k)
            left = left.join(gone, same(left, gone, [*group, k]), "left_anti")
        left = left.checkpoint()
        if left.isEmpty():
            break
    kept = kept.select(*group, order).withColumnsRenamed({c: f"__k_{c}" for c in (*group, order)})
    return df.join(kept, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*group, order)], "left_semi")


def folded_sources(sources: DataFrame, hub: str, order: str) -> DataFrame:
    """Sources of every hub after its items have been merged: columns hub, order (unique in a hub), url, platform, is_primary.

    The primary item's sources stay. Of the others one stays if it has a URL and no source before it, primary or kept, has its
    URL or its canonical platform.
    """
    named = sources.withColumn("canonical", canonical_platform(F.col("platform"), F.col("url")))
    primary, others = named.where("is_primary"), named.where("not is_primary and url is not null and url != ''")
    for k in ("url", "canonical"):
        others = others.join(primary.select(hub, k).distinct(), [hub, k], "left_anti")
    return primary.unionByName(first_unique(others, [hub], ["url", "canonical"], order).select(primary.columns))
