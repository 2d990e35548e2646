"""Inverted-file search: recall against brute force, and the exact search with all lists."""

import numpy as np
import pytest

from tallyworks.operators import similarity, vector_index


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    return {i: [ids[j] for j in np.lexsort((ids, -s))[:k]] for i, s in zip(ids, sim, strict=True)}


def vectors(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    return centres[rng.integers(clusters, size=n)] * (1 if clusters > 1 else 0) + rng.normal(size=(n, 16)) * 0.6


@pytest.mark.parametrize("clusters", [12, 1])
def test_every_row_as_query_reaches_recall(spark, clusters):
    x = vectors(clusters, 1200, clusters)
    df = spark.createDataFrame([(i * 3, [float(v) for v in r], "clash") for i, r in enumerate(x)], "vec_id long, embedding array<double>, list string")
    index = vector_index.build(df, part_rows=100)
    assert index.lists == 35 and index.rows.count() == 1200 and index.rows.select("vec_id").distinct().count() == 1200
    probes = vector_index.probes_for(index, df, 5)
    assert probes < 35
    true = brute(np.arange(1200) * 3, x, 5)
    got = {}
    for r in vector_index.search(index, df, 5, probes, part_rows=70).collect():
        got.setdefault(r.a_id, []).append(r.b_id)
    assert sum(len(set(true[a]) & set(b)) for a, b in got.items()) >= 0.9 * 6000
    every = {}
    for r in vector_index.search(index, df, 5, 35, part_rows=500).orderBy("a_id", "rank_position").collect():
        every.setdefault(r.a_id, []).append(r.b_id)
    assert every == true


def test_odd_vectors_and_a_hot_one(spark):
    """Null, zero and other widths match nothing; a third of all rows are one vector, their neighbours tie by id."""
    x = vectors(3, 200, 4)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [1.0] * 16) for i in range(120)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, []), (5004, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(df, lists=6, part_rows=16)
    out = vector_index.search(index, df, 3, 6, part_rows=16).collect()
    hot = sorted((r.a_id, r.rank_position, r.b_id) for r in out if r.a_id >= 1000)
    assert hot == sorted((a, p, b) for a in range(1000, 1120) for p, b in enumerate([b for b in range(1000, 1005) if b != a][:3], 1))
    assert not any(max(r.a_id, r.b_id) >= 5000 for r in out)
    assert vector_index.search(vector_index.build(df.limit(0)), df, 3, 2).count() == 0
    assert vector_index.probes_for(vector_index.build(df.limit(0)), df.limit(0), 3) == 1


def test_exact_search_is_the_same_whatever_the_blocks(spark):
    x = vectors(5, 300, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    true = brute(np.arange(300), x, 4)
    for block_rows, buffer_rows in ((50, 32), (1000, 1000), (7, 40)):
        got = {}
        for r in similarity.knn(df, df, 4, block_rows, buffer_rows).orderBy("a_id", "rank_position").collect():
            got.setdefault(r.a_id, []).append(r.b_id)
        assert got == true
