"""Faceted search: filters combined from parameters, named sort orders, pages."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def not_archived(status: Column) -> Column:
    return status.isNull() | (status != "archived")


def matches_tokens(text: str, fields: list[Column]) -> Column:
    """Every token of the search text stands in some field, whatever its case. % and _ are plain characters."""
    return all_of([reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(f), F.lit(t)), F.lit(False)) for f in fields)) for t in text.lower().split()])


def in_alias_group(c: Column, groups: dict[str, list[str]], wanted: str, rest: str) -> Column:
    """Members of a named group; `rest` names everything in no group, nulls included; other names stand for themselves."""
    if wanted == rest:
        return c.isNull() | ~c.isin([v for vs in groups.values() for v in vs])
    return c.isin(groups[wanted]) if wanted in groups else c == wanted


def numeric_or_zero(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.cast("double")).otherwise(F.lit(0.0))


def page(df: DataFrame, order: list[Column], limit: int = 15, number: int = 1) -> DataFrame:
    """One page (limit 1 to 100) with `total`, `total_pages` and `has_more`.

    The total is a scalar subquery: a count over an unpartitioned window would move all rows to one task.
    """
    limit = max(1, min(100, limit))
    offset = (max(1, number) - 1) * limit
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)
    return rows.withColumns({"total_pages": F.ceil(F.col("total") / limit).cast("long"), "has_more": F.lit(offset + limit) < F.col("total")})


def limited(df: DataFrame, limit: int = 0) -> DataFrame:
    """The first rows; a limit of 0 gives all."""
    return df.limit(limit) if limit > 0 else df


def windowed(df: DataFrame, as_of: Column, days: int = 0) -> DataFrame:
    """Rows that aren't archived, of the last `days` by created_at or spiking; 0 days: of any age."""
    live = df.where(not_archived(F.col("triage_status")))
    spiking = F.coalesce(F.get_json_object("payload", "$.is_cross_spiking") == "true", F.lit(False))
    return live.where((F.col("created_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) | spiking) if days > 0 else live


class Key(NamedTuple):
    """A column of a sort order; nulls come last unless nulls_first."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def sort(self) -> Column:
        c = F.col(self.column)
        return (c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()) if self.descending else (c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last())


def slices_of(df: DataFrame, keys: list[Key], skip: int, length: int, sort_rows: int, n: int, cuts: int = 64) -> list[tuple[Column, int, int]]:
    """Parts of df, each a condition with how many of its rows to skip and to take, that hold its rows skip to skip + length in order.

    The rows are counted by ranges between sampled values of the first key, each sampled value a range of its own; only
    ranges that hold some of the wanted rows are followed, a single value by the next key, until they have sort_rows at most.
    """
    if n <= sort_rows or not keys:
        return [(F.lit(True), skip, length)]
    key, c = keys[0], F.col(keys[0].column)
    some = df.where(c.isNotNull()).select(c).orderBy(F.xxhash64(c, *[F.col(k.column) for k in keys])).limit(64 * cuts)
    held = [r[0] for r in some.groupBy(c).count().orderBy(F.desc("count"), c).limit(cuts).select(c).orderBy(c).collect()]
    marks = F.array(*[F.lit(v).cast(df.schema[key.column].dataType) for v in held])
    place = F.when(c.isNull(), -1).otherwise(2 * F.size(F.filter(marks, lambda m: m < c)) + F.array_contains(marks, c).cast("int")) if held else F.lit(-1)
    counted = {r[0]: r[1] for r in df.groupBy(place.alias("__place")).count().collect()}  # 2 * cuts + 2 rows at most
    order = sorted((p for p in counted if p >= 0), reverse=key.descending)
    if -1 in counted:
        order = [-1, *order] if key.nulls_first else [*order, -1]
    out, at = [], 0
    for p in order:
        begin, end = max(skip, at), min(skip + length, at + counted[p])
        if begin < end:
            if p < 0:
                where, rest = c.isNull(), keys[1:]
            elif p % 2:
                where, rest = c == F.lit(held[p // 2]), keys[1:]
            else:
                bounds = [c > F.lit(v) for v in held[: p // 2][-1:]] + [c < F.lit(v) for v in held[p // 2 :][:1]]
                where, rest = all_of([c.isNotNull(), *bounds]), keys
            inner = slices_of(df.where(where), rest, begin - at, end - begin, sort_rows, counted[p], cuts)
            out += [(where & w, s, m) for w, s, m in inner]
        at += counted[p]
    return out


def deep_page(df: DataFrame, keys: list[Key], limit: int = 15, number: int = 1, sort_rows: int = 10_000) -> DataFrame:
    """The same page as page() of any number, with the same columns, however deep: only ranges of about sort_rows rows are sorted.

    The last keys make the order unique; of rows equal in all keys any may come. Each step of the way reads the key columns
    of the ranges that it still follows (filters that a scan can push down) and brings some dozens of counts to the driver.
    """
    limit = max(1, min(100, limit))
    offset = (max(1, number) - 1) * limit
    total = df.count()
    parts = slices_of(df, keys, offset, limit, sort_rows, total) if offset < total else []
    order = [k.sort() for k in keys]
    rows = df.limit(0)
    for where, skip, length in parts:
        part = df.where(where).orderBy(*order).offset(skip).limit(length)
        rows = part if len(parts) == 1 else rows.unionByName(part)
    return rows.orderBy(*order).withColumns({"total": F.lit(total).cast("long"), "total_pages": F.ceil(F.lit(total) / limit).cast("long"), "has_more": F.lit(offset + limit < total)})
