import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyworks.operators import overlap, similarity


def sets_of(n=700):
    """Sets of 1 to 60 values, some frequent, with edited copies."""
    rng = random.Random(5)
    pick = lambda: f"w{min(int(rng.expovariate(0.012)), 1500)}"
    out = {}
    for i in range(n):
        if i % 3 == 0 and i:
            s = set(out[rng.randrange(i)])
            for w in rng.sample(sorted(s), min(len(s), rng.randrange(4))):
                s.discard(w)
                s.add(pick())
            out[i] = s
        else:
            out[i] = {pick() for _ in range(rng.choice([1, 3, 4, 6, 12, 30, 60]))}
    return out


def roots(pairs):
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for p in pairs for x in p}


def test_pairs_match_all_pairs_in_blocks_of_any_size(spark, monkeypatch):
    sets = sets_of()
    mask = {i: (0, 0, 1, 2)[i % 4] for i in sets}
    frame = spark.createDataFrame([(i, sorted(s), mask[i]) for i, s in sets.items()], "id long, set array<string>, mask int").repartition(3)
    jaccard, contained = set(), set()
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared >= 0.7 * len(sets[a] | sets[b]):
                jaccard.add((a, b, shared))
            if a < b and shared >= 3 and shared >= 0.55 * min(len(sets[a]), len(sets[b])):
                contained.add((a, b, shared))
    named = lambda df: {(min(r.a, r.b), max(r.a, r.b), r.shared) for r in df.collect()}
    for block in (100, 65_536):
        plain = frame.drop("mask")
        assert named(overlap.jaccard_overlaps(plain, 0.7, block=block)) == jaccard and len(jaccard) > 50
        got = overlap.contained_pairs(plain, 0.55, 3, block=block).collect()
        assert {(min(r.a, r.b), max(r.a, r.b), r.shared) for r in got} == contained and len(got) == len(contained) > 500
        free = {(a, b) for a, b, _ in contained if not (mask[a] and mask[b] and mask[a] != mask[b])}
        forest = [(r.a, r.b) for r in overlap.contained_pairs(frame, 0.55, 3, block=block, forest=True).collect()]
        assert len(free) < len(contained) and {tuple(sorted(p)) for p in forest} <= free
        assert roots(forest) == roots(sorted(free)) and (block == 100 or len(forest) < len(free) / 2)
    path, names = overlap._blocks(plain, 100)
    numbers = pa.RecordBatch.from_arrays([pa.array(range(len(names) * (len(names) + 1) // 2))], ["id"])
    for met, cells, together in ((50, 1 << 18, 64), (1 << 20, 300, 8), (1, 1, 4)):  # steps of a few values, in this process
        for name, value in (("MET", met), ("CELLS", cells), ("TOGETHER", together)):
            monkeypatch.setattr(overlap, name, value)
        for rule, expect in (((0.7, 1, True, False), jaccard), ((0.55, 3, False, False), contained)):
            got = [r for batch in overlap._meet(path, names, *rule)(iter([numbers])) for r in batch.to_pylist()]
            assert {(min(r["a"], r["b"]), max(r["a"], r["b"]), r["shared"]) for r in got} == expect and len(got) == len(expect)


def test_labels_after_each_step():
    label = np.arange(9)
    assert overlap._joined(label, np.array([7, 5, 3, 8]), np.array([5, 3, 7, 2])) == [0, 1, 3]
    assert label.tolist() == [0, 1, 2, 3, 4, 3, 6, 3, 2]
    assert overlap._joined(label, np.array([2, 5]), np.array([7, 8])) == [0] and label.tolist() == [0, 1, 2, 2, 4, 2, 6, 2, 2]


def test_candidates_are_no_rows_of_the_plan(spark):
    """Common words bring many candidates; only pairs that pass leave a task, nothing is joined by word twice."""
    frame = spark.createDataFrame([(i, ["a", "b", "c", f"x{i}", f"y{i}", f"z{i}", f"u{i}"]) for i in range(300)], "id long, tokens array<string>")
    for made in (similarity.jaccard_pairs(frame, "id", "tokens", 0.7), similarity.story_links(frame.withColumnRenamed("tokens", "set"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join Inner, (token" not in plan
        assert made.count() == 0


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, set array<string>")
    one = spark.createDataFrame([(1, ["a", "b", "c"]), (None, ["a", "b", "c"])], "id long, set array<string>")
    for frame in (none, one, one.withColumn("set", F.array().cast("array<string>"))):
        assert overlap.jaccard_overlaps(frame, 0.7).count() == 0 and overlap.contained_pairs(frame, 0.5, 1, forest=True).count() == 0
