"""Ordered first-match clusters against the sequential definition."""

import random
import re

import pytest

from tallyworks.operators import first_match
from tallyworks.operators.first_match import KEY_STOP_WORDS, first_match_clusters
from tallyworks.operators.similarity import ANCHORS, MAJOR_ENTITIES

KIND = "id long, ts double, urls array<string>, tokens array<string>, en array<string>, key string, entity string"


def specific(e):
    parts = e.split("-")
    return any(c.isdigit() for c in e) or len(parts) > 1 and any(p in ("image", "coder", "vl", "vlm", "math", "distill", "turbo", "flash", "pro", "ultra") for p in parts)


def similar(a, b):
    if a == b:
        return True
    x, y = (set(re.findall("[a-z0-9]+", k.lower())) - set(KEY_STOP_WORDS) for k in (a, b))
    return len(x & y) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.5


def gate(a, b):
    return any(set(p) <= a and set(p) <= b for p in ANCHORS) or len(a & b) >= 3 and len(a & b) / min(len(a), len(b)) >= 0.55


def sequential(rows, near=(), hours=72.0):
    clusters, out = [], {}
    for i, ts, urls, tokens, en, key, entity in sorted(rows, key=lambda r: r[0]):
        urls, tokens, en, key, entity = {u for u in urls or () if u}, set(tokens or ()), set(en or ()), key or "", entity or ""
        for c in clusters:
            x, y = tokens & set(MAJOR_ENTITIES), c["tokens"] & set(MAJOR_ENTITIES)
            if x and y and x != y:
                continue
            if urls & c["urls"]:
                break
            if ts and c["ts"] and abs(ts - c["ts"]) / 3600 > hours:
                continue
            if len(entity) >= 3 and entity == c["entity"] and specific(entity):
                break
            if key and c["key"] and similar(key, c["key"]):
                break
            if en and c["en"] and len(en & c["en"]) / len(en | c["en"]) >= 0.5:
                break
            if (i, c["hub"]) in near or (c["hub"], i) in near:
                break
            if tokens and c["own"] and gate(tokens, c["own"]):
                break
        else:
            clusters.append({"hub": i, "ts": ts, "urls": urls, "tokens": set(tokens), "own": tokens, "en": set(en), "key": key, "entity": entity})
            out[i] = i
            continue
        out[i] = c["hub"]
        c["urls"] |= urls
        c["tokens"] |= tokens
        c["en"] |= en
        c["entity"] = c["entity"] or entity
    return out


@pytest.mark.parametrize("seed", [3])
def test_every_item_joins_the_first_cluster(spark, seed):
    rng = random.Random(seed)
    words = [f"w{int(70 * rng.random() ** 2)}" for _ in range(300)] + MAJOR_ENTITIES[:4] * 2 + [w for p in ANCHORS[:4] for w in p]
    some = lambda n: [rng.choice(words) for _ in range(rng.randint(0, n))]
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.25:
            _, _, urls, tokens, en, key, entity = rng.choice(rows)
            if rng.random() < 0.5:
                tokens, en = (tokens or []) + some(1), (en or [])[1:] + some(2)
        else:
            urls, tokens, en = rng.choice([None, [], [f"u{rng.randint(0, 60)}", ""]]), some(7), some(6)
            key = rng.choice([None, "", "-".join(sorted({rng.choice("abcdef") * 3 for _ in range(4)}))])
            entity = rng.choice([None, "", "broad", "gpt-4", "qwen-coder", "v1"])
        ts = rng.choice([None, 0.0, 3600.0 * (i + 1), 3600.0 * (i + 1), 3600.0 * rng.randint(1, 250)])
        rows.append((i * 2, ts, urls, tokens, en, key, entity))
    near = {(rows[rng.randrange(220)][0], rows[rng.randrange(220)][0]) for _ in range(20)}
    near = {p for p in near if p[0] != p[1]}
    got = {r.id: r.hub for r in first_match_clusters(spark.createDataFrame(rows, KIND), spark.createDataFrame(sorted(near), "id long, other long")).collect()}
    expect = sequential(rows, near)
    assert got == expect
    assert 20 < len(set(expect.values())) < 215


def test_chains_hot_values_and_nothing(spark):
    """A cluster's words grow step by step; a third of all rows share a URL, but not their entities; rows without anything."""
    grow = [(i, None, [], [], [f"c{k}" for k in range(i, i + 4)], "", "") for i in range(12)]
    hot = [(100 + i, 3600.0 * 400 * i + 1, ["hot"], [MAJOR_ENTITIES[i % 3]] if i % 2 else ["plain"], [], "", "") for i in range(40)]
    bare = [(200 + i, None, None, None, None, None, None) for i in range(5)]
    rows = grow + hot + bare
    frame = spark.createDataFrame(rows, KIND)
    expect = sequential(rows)
    assert {r.id: r.hub for r in first_match_clusters(frame).collect()} == expect
    assert len({expect[i] for i in range(12)}) < 12 and len({h for i, h in expect.items() if i >= 200}) == 5
    assert first_match_clusters(frame.limit(0)).count() == 0


def test_the_query_matches_over_a_whole_table(spark):
    from tallyworks.plans import stories

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in stories.story_items(spark, sf).collect()]
    expect = sequential(rows)
    assert {r.doc_id: r.cluster for r in stories.first_match_stories(spark, sf).collect()} == expect
    assert len(expect) == 200 and len(set(expect.values())) < 200


def test_ranges_hand_on_what_can_still_be_met(spark):
    """Feeds in order, with some rows out of it or without a time, and URLs that come again much later."""
    rng = random.Random(8)
    words = [f"w{int(200 * rng.random() ** 2)}" for _ in range(400)] + MAJOR_ENTITIES[:3]
    rows = []
    for i in range(300):
        tokens, en = ([rng.choice(words) for _ in range(rng.randint(0, 8))] for _ in range(2))
        if rows and rng.random() < 0.4:
            tokens, en = list(rows[-rng.randint(1, min(40, len(rows)))][3]), list(rows[-1][4])
        ts = 7200.0 * (i + 1) if rng.random() < 0.9 else rng.choice([None, 7200.0 * rng.randint(1, 300)])
        rows.append((i, ts, [f"u{rng.randint(0, 150)}"], tokens, en, "", rng.choice(["", "gpt-4", "broad"])))
    timed = [(i, ts or 7200.0 * (i + 1), *rest) for i, ts, *rest in rows]
    for data, n in ((rows, 17), (timed, 23), (timed, 300)):
        expect = sequential(data)
        got = {r.id: r.hub for r in first_match_clusters(spark.createDataFrame(data, KIND), rows=n).collect()}
        assert got == expect and 20 < len(set(expect.values())) < 290


def test_work_does_not_grow_with_the_chain(spark, monkeypatch):
    """All titles are alike, so that each cluster's first item depends on the cluster before, over fifty windows of time."""
    rows, calls = [(i, 3600.0 * (25 * i + 1), None, ["a", "b", "c"], ["a", "b"], None, None) for i in range(150)], []
    monkeypatch.setattr(first_match, "written", lambda df, name, write=first_match.written: (calls.append(name), write(df, name))[1])
    got = {r.id: r.hub for r in first_match_clusters(spark.createDataFrame(rows, KIND)).collect()}
    assert got == sequential(rows) and len(set(got.values())) == 50
    assert len(calls) < 12


def test_forgotten_clusters_cost_no_words():
    """Of a cluster that only a URL can lead to its place, entities and URL stay."""
    held = first_match.Clusters()
    base = {"ts": 5.0, "until": 3, "mask": 2, "entity": 9, "tokens": {1, 2, 3}, "parts": set(), "en": {4}, "own": {7}}
    held.add(base | {"hub": 0, "urls": {11: 50, 12: 2}})
    held.add(base | {"hub": 1, "urls": {}})
    held.add(base | {"hub": 2, "urls": {}, "until": 60})
    kept = held.kept(10).held
    assert [(c["hub"], c["mask"], c["urls"], len(c["tokens"])) for c in kept] == [(0, 2, {11: 50}, 0), (2, 2, {}, 3)]
