"""Property graphs as two DataFrames: nodes (id) and links (source, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their degree; a self link counts twice, a node without links 1."""
    ends = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id")))
    return nodes.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(1)).cast("long"))


def neighbours(links: DataFrame, longest: int = 100_000) -> DataFrame:
    """id, part, successors, predecessors as sorted arrays of at most about `longest`: a node with more has several parts.

    Parts go by a hash of the neighbour, so a hub never meets in one task; nodes of fewer links have part 0 alone.
    """

    def lists(of: str, other: str, name: str) -> DataFrame:
        sizes = links.groupBy(of).agg(F.ceil(F.count("*") / F.lit(longest)).alias("parts")).where("parts > 1")
        dealt = links.join(sizes, of, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int"))
        return dealt.groupBy(F.col(of).alias("id"), "part").agg(F.array_sort(F.collect_set(other)).alias(name))

    empty = F.array().cast("array<string>")
    both = lists("source", "target", "successors").join(lists("target", "source", "predecessors"), ["id", "part"], "full_outer")
    return both.select("id", "part", F.coalesce("successors", empty).alias("successors"), F.coalesce("predecessors", empty).alias("predecessors"))


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes or links of new that aren't there yet are added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(old.columns))


def first_matching(clusters: DataFrame, keyword: Column, names: str, order: str) -> DataFrame:
    """The first cluster one of whose names holds the keyword, or is held by it."""
    word = F.lower(keyword)
    name = F.lower(F.col("__name"))
    hit = clusters.withColumn("__name", F.explode(names)).where(name.contains(word) | word.contains(name))
    return hit.orderBy(order).limit(1).drop("__name")
