"""Postings against a scan, horizons against brute force, stored merges file by file."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from tallyworks.operators import horizons, postings, search
from tallyworks.sources import stored


def test_postings_find_what_a_scan_finds(spark, monkeypatch):
    rng = random.Random(1)
    parts = ["abc", "Abd", "é", "ÉÀ", "😀", " ", "\n", "xyz", "%", "_", "b"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), rng.choice([None, "Title abc", "xyz"])) for i in range(300)]
    rows += [(900, None, None), (901, "", ""), (902, "long " * 50_000 + "needle", None), (None, "abc", "abc"), (903, "abc", "same"), (903, "abc", "same")]
    df = spark.createDataFrame(rows, "id long, text string, title string").repartition(3)
    monkeypatch.setattr(postings, "BLOCK_CHARS", 500)
    index = postings.build(df, "id", ["text", "title"])
    fields = [F.col("text"), F.col("title")]
    texts = ["ABC xyz", "b", "éà 😀", "% _", "needle", "abdxyz title", "nothing", " "]
    for named in (1000, 3):
        monkeypatch.setattr(postings, "NAMED", named)
        for t in texts:
            got = sorted(tuple(r) for r in postings.search(index, df, "id", ["text", "title"], t).select("id", F.md5("text")).collect())
            assert got == sorted(tuple(r) for r in df.where(search.matches_tokens(t, fields) & F.col("id").isNotNull()).select("id", F.md5("text")).collect()), t
    plan = postings.candidates(index, "needle abc")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "text" not in plan
    assert postings.search(postings.build(df.limit(0), "id", ["text"]), df, "id", ["text"], "abc").count() == 0


def test_horizons_match_brute_force(spark):
    rng = random.Random(2)
    begin = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2, None]), begin + dt.timedelta(hours=rng.choice([rng.uniform(0, 900), 30])), rng.choice([None, round(rng.uniform(-5, 5), 2)])) for _ in range(500)] + [(1, None, 3.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, value double")
    got = horizons.horizons(horizons.panes(df, "k", "ts", "value"), "k").collect()
    pane = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() // 21600)
    assert {(r.k, r.pane) for r in got} == {(k, pane(t)) for k, t, _ in rows if t}
    for r in got:
        for h in horizons.HORIZON_HOURS:
            held = [v for k, t, v in rows if t and k == r.k and r.pane - h // 6 < pane(t) <= r.pane]
            known = [v for v in held if v is not None]
            assert r[f"n_{h}h"] == len(held)
            assert abs((r[f"total_{h}h"] or 0) - sum(known)) < 1e-9
            assert r[f"delta_{h}h"] == (max(known) - min(known) if known else None)


def files(path):
    return {os.path.relpath(f"{d}/{f}", path): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_writes_only_buckets_that_change(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, n int, payload string"
    body = lambda **kw: json.dumps(kw)
    old = [(i, i % 7, body(title_ko=f"old {i}", tags=["a"], **({"ai_enrichment": {"by": [i]}} if i % 2 else {}))) for i in range(400)]
    stored.create(spark.createDataFrame(old, schema), path, "k", 32)
    before = files(path)
    assert len({f.split("/")[0] for f in before}) == 32
    new = [(3, 1, body(title_ko="new 3", x=1.5)), (4, 9, body(x=None)), (5, 0, body(ai_enrichment={"by": "new"})), (1000, 5, None), (6, 6, old[6][2])]
    frame = spark.createDataFrame(new, schema)
    assert 0 < stored.merge_into(path, schema, frame, "k", {"n": "greatest"}, "payload", 32) <= 4
    after = files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert len({f.split("/")[0] for f in kept}) >= 28
    assert stored.merge_into(path, schema, frame, "k", {"n": "greatest"}, "payload", 32) == 0 and files(path) == after
    assert stored.merge_into(path, schema, frame.limit(0), "k", {"n": "greatest"}, "payload", 32) == 0
    got = {r.k: (r.n, json.loads(r.payload) if r.payload else None) for r in stored.read(spark, path, schema).collect()}
    assert len(got) == 401 and got[7] == (0, json.loads(old[7][2]))
    assert got[3] == (3, {"title_ko": "old 3", "x": 1.5, "ai_enrichment": {"by": [3]}, "multilingual": None, "description_ko": None})
    assert got[4] == (9, {"x": None}) and got[5] == (5, {"ai_enrichment": {"by": "new"}}) and got[1000] == (5, None) and got[6] == (6, json.loads(old[6][2]))
