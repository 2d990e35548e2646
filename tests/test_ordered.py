"""Folds and deep pages against sequential brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import folding, merge, search


def kept(rows):
    """doc of rows (hub, place, a, b) that the sequential fold keeps."""
    out, seen = [], {}
    for hub, place, a, b in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        urls, names = seen.setdefault(hub, (set(), set()))
        if a not in urls and b not in names:
            urls.add(a)
            names.add(b)
            out.append((hub, place, a, b))
    return sorted(out, key=str)


def test_first_unique_matches_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, *range(30)]), rng.choice([None, *"abcdefghijklmnop"])) for i in range(500)]
    rows += [(7, 2 * i, i, i) for i in range(12)] + [(7, 2 * i + 1, i, i + 1) for i in range(12)]  # each waits for the one before
    rng.shuffle(rows)
    got = folding.first_unique(spark.createDataFrame(rows, "hub int, place int, a int, b string"), ["hub"], ["a", "b"], "place").collect()
    assert sorted(map(tuple, got), key=str) == kept([(h, p, a, None if b is None else str(b)) for h, p, a, b in rows])
    empty = spark.createDataFrame([], "hub int, place int, a int, b string")
    assert folding.first_unique(empty, ["hub"], ["a", "b"], "place").count() == 0


def test_sources_of_hubs(spark):
    rows = [("h", 1, "u1", "GitHub Trending", True), ("h", 2, "u2", "github", False), ("h", 3, "u1", "Reddit", False), ("h", 4, "", "Blog", False), ("h", 5, None, "Blog", False), ("h", 6, "https://arxiv.org/x", "Blog", False), ("h", 7, "u7", "arxiv papers", False), ("h", 8, "u8", "Blog", False), ("h", 9, "u1", "x", True)]
    got = folding.folded_sources(spark.createDataFrame(rows, "hub string, place int, url string, platform string, is_primary boolean"), "hub", "place").collect()
    assert sorted(r.place for r in got) == [1, 6, 8, 9]


def test_newer_wins(spark):
    t = lambda d: None if d is None else dt.datetime(2024, 1, d)
    old = [(1, t(3), "a"), (2, t(3), "a"), (3, None, "a"), (4, t(3), "a"), (5, t(3), None), (6, t(3), "a")]
    new = [(1, t(4), "b"), (2, t(3), "b"), (3, t(1), "b"), (4, t(5), None), (5, t(2), "b"), (7, None, "b")]
    out = merge.upsert(spark.createDataFrame(old, "k int, t timestamp, v string"), spark.createDataFrame(new, "k int, t timestamp, v string"), ["k"], {"v": "newer:t"})
    assert {r.k: r.v for r in out.collect()} == {1: "b", 2: "a", 3: "b", 4: "a", 5: None, 6: "a", 7: "b"}


@pytest.mark.parametrize(("descending", "nulls_first"), [(False, False), (True, True)])
def test_deep_pages(spark, descending, nulls_first):
    """A value that a third of all rows have, nulls, and unique last keys; pages within and across ranges."""
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", f"v{rng.randint(0, 50)}"]), rng.choice([None, float("nan"), round(rng.random(), 2)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b double, c int")
    keys = [search.Key("a", descending, nulls_first), search.Key("b", not descending, nulls_first), search.Key("c", descending)]
    order = [r.c for r in df.orderBy(*[k.sort() for k in keys]).collect()]
    for number in (1, 17, 61, 101, 300, 301):
        out = search.deep_page(df, keys, 10, number, sort_rows=40)
        assert [r.c for r in out.collect()] == order[10 * number - 10 : 10 * number], number
    last = search.deep_page(df.limit(0), keys, 10, 3)
    assert last.columns == [*df.columns, "total", "total_pages", "has_more"] and last.count() == 0
    parts = search.slices_of(df, keys, 1500, 10, 40, 3000)
    assert sum(df.where(w).count() for w, _, _ in parts) <= 40 * len(parts)


def test_equal_rows_fill_a_page(spark):
    df = spark.range(500).select(F.lit(1).alias("a"))
    assert search.deep_page(df, [search.Key("a")], 10, 20, sort_rows=50).count() == 10
