import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tallyworks.llm import shards as S


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, shard string, h int")


def held(rows, n, tolerance):
    """A share of the bytes, and how far a shard may be from it."""
    total = sum(len((t or "").encode()) + 16 for _, t in rows)
    largest = max(len((t or "").encode()) + 16 for _, t in rows)
    return total / n, 2 * max(tolerance * total / n, 2 * largest)


@pytest.mark.parametrize("hot", [0, 400])
def test_shards_are_even_and_gapless(spark, hot):
    rng = random.Random(hot)
    rows = [(i, rng.choice("äbc") * rng.randint(0, 300)) for i in range(600)] + [(1000 + i, "same text " * 10) for i in range(hot)] + [(None, None), (7, "again"), (7, "again")]
    out = S.assign_shards(frame(spark, rows), shards=10, cell_rows=7).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    share, slack = held(rows, 10, 0.001)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(abs(sizes[k] - share) <= slack for k in range(10))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    places = defaultdict(set)
    for r in out:
        places[r.text_crc32].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 9
    whole = S.sharded(frame(spark, rows), shards=10)
    assert whole.columns == ["doc_id", "text", "h", "shard"] and whole.count() == len(rows)
    got = Counter()
    for r in whole.collect():
        got[r.shard] += len((r.text or "").encode()) + 16
    assert all(abs(got[k] - share) <= slack for k in range(10))


def test_few_or_no_rows(spark):
    assert S.assign_shards(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert [(r.size, r.slot) for r in S.assign_shards(frame(spark, [(-(2**63), "")]), shards=40).collect()] == [(16, 0)]
    assert sorted(r.doc_id for r in S.assign_shards(frame(spark, [(-(2**63), ""), (2**63 - 1, "")]), shards=3).collect()) == [-(2**63), 2**63 - 1]


def test_very_long_text_and_many_cells(spark):
    rows = [(1, "x" * 3_000_000), (2, "y")] + [(10 + i, f"text {i}") for i in range(500)] + [(1000 + i, "hot") for i in range(700)]
    out = S.assign_shards(frame(spark, rows), shards=4, cell_rows=50).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert next(r.size for r in out if r.doc_id == 1) == 3_000_016


@pytest.mark.parametrize("hot", [0, 300])
def test_shards_and_slots_are_those_of_the_sorted_rows(spark, hot):
    """Against a plain sort: shards are stretches of it, slots its places, and splitters the bounds that are near enough or nearest."""
    rng = random.Random(7 + hot)
    rows = [(i, rng.choice("xyzé") * rng.randint(0, 400) + str(i % 400)) for i in range(700)] + [(2000 + i, "hot text " * 9) for i in range(hot)]
    key = lambda d, t: (int(hashlib.md5(t.encode()).hexdigest()[:15], 16), d >> 1, d)
    order = sorted(rows, key=lambda r: key(*r))
    got = {r.doc_id: (r.shard, r.slot) for r in S.assign_shards(frame(spark, rows), shards=8, cell_rows=50).collect()}
    shards = [got[d][0] for d, _ in order]
    assert shards == sorted(shards) and set(shards) == set(range(8))
    assert [got[d][1] for d, _ in order] == [k - shards.index(s) for k, s in enumerate(shards)]
    below, at = [0], 0
    for d, t in order:
        below.append(at := at + len(t.encode()) + 16)
    cuts = [k for k in range(1, len(order)) if key(*order[k])[:2] != key(*order[k - 1])[:2]]  # where a splitter can stand
    for s in range(1, 8):
        target, cut = at * s // 8, below[shards.index(s)]
        assert shards.index(s) in cuts
        assert abs(cut - target) <= max(0.001 * at / 8, min(abs(below[k] - target) for k in cuts))


def test_copies_without_doc_id_are_cut_apart(spark):
    rows = [(i, f"text {i} " * 3) for i in range(200)] + [(None, "copied text ")] * 2000 + [(500 + i, "copied text ") for i in range(300)]
    docs = frame(spark, rows).repartition(5)
    out = S.assign_shards(docs, shards=10, cell_rows=60).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    share, _ = held(rows, 10, 0.001)
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(abs(sizes[k] - share) <= 0.05 * share for k in range(10))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = Counter()
    for r in S.sharded(docs, shards=10).collect():
        got[r.shard] += len(r.text) + 16
    assert len(got) == 10 and max(got.values()) <= 1.3 * share
