import datetime as dt
import gzip
import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import clustering, graph, merge, nearest, ranking, search, similarity, trees
from tallyworks.sources import feeds, sinks
from tallyworks.sources import http as sources_http


def test_nearest_is_strict_and_takes_the_closest(spark):
    t0 = dt.datetime(2024, 1, 1, 12)
    s = lambda n: t0 + dt.timedelta(seconds=n)
    left = spark.createDataFrame([(1, s(0)), (2, s(10_000)), (3, s(20_000)), (4, s(30_000))], "id long, ts timestamp_ntz")
    right = spark.createDataFrame([(10, s(-299)), (11, s(299)), (12, s(100)), (20, s(10_300)), (30, s(20_299)), (31, s(19_702))], "rid long, rts timestamp_ntz")
    got = {r.id: r.rid for r in nearest.nearest_within(left, right, "id", "ts", "rid", "rts").collect()}
    assert got == {1: 12, 2: None, 3: 31, 4: None}


@pytest.mark.parametrize("range_rows", [100_000, 7])
def test_nearest_of_dense_times_has_two_candidates_a_row(spark, range_rows):
    """A hundred times the density of the tolerance, equal times and a third of all rows at one moment, against brute force."""
    import bisect
    import random

    rng, begin = random.Random(range_rows), dt.datetime(2024, 1, 1)
    at = lambda s: begin + dt.timedelta(seconds=s)
    left = [(i, at(rng.choice([rng.randint(0, 3000), 700, round(rng.uniform(0, 3000), 3)]))) for i in range(600)] + [(9001, None), (9002, at(90_000)), (9003, at(90_300))]
    right = [(i, at(rng.choice([rng.randint(0, 3000), 700, 2500]))) for i in range(900)] + [(9001, None), (9002, at(90_600)), (9003, at(89_700.5)), (9004, at(90_600))]
    a, b = spark.createDataFrame(left, "id long, ts timestamp"), spark.createDataFrame(right, "rid long, rts timestamp")
    out = nearest.nearest_within(a, b, "id", "ts", "rid", "rts", 300, range_rows)
    assert out.columns == ["id", "ts", "rid", "gap_s"]
    by_time = sorted((t, r) for r, t in right if t)
    times = [t for t, _ in by_time]

    def brute(t):
        lo, hi = bisect.bisect_left(times, t - dt.timedelta(seconds=300)), bisect.bisect_right(times, t + dt.timedelta(seconds=300))
        return min(((abs((u - t).total_seconds()), r) for u, r in by_time[lo:hi] if abs((u - t).total_seconds()) < 300), default=(None, None))

    assert sorted((r.id, r.gap_s, r.rid) for r in out.collect()) == sorted((i, *(brute(t) if t else (None, None))) for i, t in left)
    assert nearest.nearest_within(a, b.limit(0), "id", "ts", "rid", "rts").where("rid is null").count() == len(left)
    assert nearest.nearest_within(a.limit(0), b, "id", "ts", "rid", "rts").count() == 0


def test_knn_keeps_five_then_filters(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(100, None), (101, [0.0] * 8), (200, rows_same(x[0]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for block in (20_000, 2):
        got = {}
        for r in similarity.knn(df, df.where("vec_id % 10 = 0"), 5, block).collect():
            got.setdefault(r.a_id, []).append((r.rank_position, r.b_id))
        assert all(len(v) == 5 for v in got.values()) and set(got) == {0, 10, 20, 30, 40, 50, 200}
        full = {i: v for i, v in rows if v is not None and any(v)}
        for a, found in got.items():
            sims = sorted(((-np.dot(full[a], v) / np.linalg.norm(full[a]) / np.linalg.norm(v), b) for b, v in full.items() if b != a))
            assert [b for _, b in sorted(found)] == [b for _, b in sims[:5]]


def rows_same(v):
    return [float(2 * a) for a in v]


def test_jaccard_pairs_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, sorted({f"t{k}" for k in rng.integers(0, 14, rng.integers(0, 9))})) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    classes = {}
    for i, t in rows:
        if t:
            classes.setdefault(tuple(t), i)
    expect = {(min(a, b), max(a, b)) for s, a in classes.items() for t, b in classes.items() if a < b and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.6}
    assert {(r.a_id, r.b_id) for r in similarity.jaccard_pairs(df, "id", "tokens", 0.6).collect()} == expect and len(expect) > 20


def test_decisions_one_row_a_branch(spark):
    base = dict(sim=0.9, shared=3, specific=3, same=False, rel=False, ver=False, ent=False, hub=False, chan=False)
    cases = [(dict(sim=0.77), "BELOW_THRESHOLD"), (dict(rel=True), "REJECTED_RELEASE_CONFLICT"), (dict(hub=True, specific=1), "REJECTED_CANONICAL_HUB_LOCK"), (dict(ver=True), "REJECTED_VERSION_CONFLICT"), (dict(chan=True), "REJECTED_SAME_YOUTUBE_CHANNEL"), (dict(ent=True), "REJECTED_ENTITY_VETO"), (dict(same=True, specific=1), "REJECTED_SAME_PLATFORM_LOW_SPECIFIC_TOKENS"), (dict(sim=0.88, shared=1), "VECTOR_HIGH"), (dict(sim=0.78), "TOKEN_OVERLAP"), (dict(sim=0.8, specific=1), "REJECTED_AMBIGUOUS_LOW_OVERLAP")]
    rows = [tuple((base | c).values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "sim double, shared int, specific int, same boolean, rel boolean, ver boolean, ent boolean, hub boolean, chan boolean").coalesce(1)
    col = F.col
    got = df.select(similarity.decision(col("sim"), col("shared"), col("specific"), col("same"), col("rel"), col("ver"), col("ent"), col("hub"), col("chan")).alias("d"))
    assert [r.d for r in got.collect()] == [d for _, d in cases]


def test_components_are_order_free(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    expect = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    for e in (edges, [(b, a) for a, b in reversed(edges)]):
        assert {r.node: r.root for r in similarity.components(spark.createDataFrame(e, "a_id long, b_id long")).collect()} == expect


def test_merges(spark):
    old = spark.createDataFrame([(1, 5.0, "a", True), (2, 7.0, "b", None)], "k long, top double, tier string, flag boolean")
    new = spark.createDataFrame([(1, 5.0, "c", False), (2, 6.0, "d", True), (3, 1.0, None, None)], "k long, top double, tier string, flag boolean")
    got = {r.k: tuple(r)[1:] for r in merge.upsert(old, new, ["k"], {"top": "greatest", "tier": "new", "flag": "or"}).collect()}
    assert got == {1: (5.0, "c", True), 2: (7.0, "d", True), 3: (1.0, None, False)}
    best = {r.k: r.tier for r in merge.upsert_by_union(old, new, ["k"], ["top"], ["tier"], "top").collect()}
    assert best == {1: "c", 2: "b", 3: None}
    long = merge.longest_wins(spark.createDataFrame([(1, "aaa")], "k long, b string"), spark.createDataFrame([(1, "bb"), (2, "c")], "k long, b string"), "k", "b")
    assert {r.k: r.b for r in long.collect()} == {1: "aaa", 2: "c"}
    assert {r.k for r in merge.changed(old, new, "k", {"top": 0.5}, []).collect()} == {2, 3}
    assert merge.insert_missing(old, new, "k").count() == 3 and merge.replaced(old, new, "k").count() == 3


def test_tracked_series(spark):
    rows = [("a", i, v) for i, v in enumerate([100, 120, 120, 180])] + [("z", i, v) for i, v in enumerate([0, 40])]
    got = ranking.tracked(spark.createDataFrame(rows, "item string, at int, v long"), "item", ["at"], "v").orderBy("item", "at").collect()
    assert [(r.delta, r.step, r.growth_pct, r.is_spiking) for r in got[:4]] == [(0, 0, 0.0, False), (20, 20, 20.0, False), (20, 0, 20.0, False), (80, 60, 80.0, True)]
    assert got[3].history == "100,120,120,180" and got[5].growth_pct == 0.0


def test_search_guards(spark):
    df = spark.createDataFrame([(1, "Alpha Beta", None), (2, "alpha%", "archived"), (3, None, "x")], "id int, t string, s string")
    assert [r.id for r in df.where(search.matches_tokens("ALPHA beta", [F.col("t")])).collect()] == [1]
    assert [r.id for r in df.where(search.matches_tokens("%", [F.col("t")])).collect()] == [2]
    assert {r.id for r in df.where(search.not_archived(F.col("s"))).collect()} == {1, 3}
    groups = {"G": ["x"]}
    assert {r.id for r in df.where(search.in_alias_group(F.col("s"), groups, "REST", "REST")).collect()} == {1, 2}
    p = search.page(df, [F.col("id")], 2, 2).collect()
    assert [(r.id, r.total, r.total_pages, r.has_more) for r in p] == [(3, 3, 2, False)]


def test_graph(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    links = spark.createDataFrame([("a", "a", "r"), ("a", "b", "r"), ("a", "b", "r")], "source string, target string, relation string")
    assert {r.id: r.degree for r in graph.degrees(nodes, links).collect()} == {"a": 4, "b": 2, "c": 1}
    assert {r.id: r.predecessors for r in graph.neighbours(links).collect()} == {"a": ["a"], "b": ["a"]}
    hub = spark.createDataFrame([("h", f"t{i}") for i in range(50)], "source string, target string")
    parts = [r for r in graph.neighbours(hub, longest=10).collect() if r.id == "h"]
    assert len(parts) > 1 and sorted(t for r in parts for t in r.successors) == sorted(f"t{i}" for i in range(50))
    assert graph.add_missing(nodes, spark.createDataFrame([("c",), ("d",), ("d",)], "id string"), ["id"]).count() == 4
    clusters = spark.createDataFrame([(1, ["Llama", "Mistral"]), (2, ["llama 3"])], "n int, names array<string>")
    assert graph.first_matching(clusters, F.lit("llama 3.1"), "names", "n").first().n == 1


def test_session_picks(spark):
    pool = spark.createDataFrame([(i, f"f{i % 3}", float(i), [1, 1]) for i in range(12)], "item long, family string, weight double, priorities array<int>")
    picks = clustering.session_picks(pool, [["f0"], ["f1", "f2"]], 4).collect()
    assert len(picks) == 8 and len({p.item for p in picks}) == 8


def test_sources(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, body in (("a.json", '{"id": "1", "title": "T"}'), ("b.json", '{"id": "1", "title": "U"}'), ("_skip.json", '{"id": "9", "title": "S"}')):
        (tmp_path / "docs" / name).write_text(body)
    got = feeds.json_documents(spark, f"file://{tmp_path}/docs", "id string, title string", "id").collect()
    assert [(r.id, r.title) for r in got] == [("1", "T")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title> One </title><link>http://a/1</link><pubDate></pubDate><date>2024-01-02</date><description>short</description><encoded>much longer</encoded></item></channel></rss>")
    r = feeds.feed_entries(spark, f"file://{tmp_path}/feed.xml").first()
    assert (r.title, r.url, r.published, r.body) == ("One", "http://a/1", "2024-01-02", "much longer")
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    feeds.append_json_lines(df, f"{tmp_path}/vault")
    feeds.append_json_lines(df, f"{tmp_path}/vault")
    assert feeds.json_lines(spark, f"{tmp_path}/vault", "k long, v string").count() == 2
    (tmp_path / "graph.json").write_text('{"nodes": [{"id": "a"}], "links": [{"source": "a", "target": "b", "relation": "r"}]}')
    nodes, links = feeds.graph(spark, f"file://{tmp_path}/graph.json")
    assert nodes.count() == links.count() == 1


def test_threads_and_http(spark):
    rows = [(1, 10, None), (1, 11, 10), (1, 12, None), (1, 13, 11), (1, 14, 10), (2, 20, 99)]
    got = trees.flattened(spark.createDataFrame(rows, "item long, id long, parent_id long"), "item", cap=4).orderBy("place").collect()
    assert [(r.id, r.depth) for r in got] == [(10, 0), (11, 1), (13, 2), (14, 1)]

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"/a": json.dumps({"hits": [{"id": 1}, {"id": 2}]}).encode(), "/z": gzip.compress(b"<rss/>")}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    sources_http.register(spark)
    records = spark.read.format("http_json").option("urls", f"{base}/a {base}/gone").option("field", "hits").load()
    assert sorted(r.value for r in records.collect()) == ['{"id": 1}', '{"id": 2}']
    assert spark.read.format("http_text").option("urls", f"{base}/z").load().first().value == "<rss/>"
    server.shutdown()


def test_sinks(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([(d, v)], "d string, v long")
    path = str(tmp_path / "out")
    for frame in (day("a", 1), day("b", 2), day("a", 3)):
        sinks.overwrite_partitions(frame, path, "d")
    assert {(r.d, r.v) for r in spark.read.parquet(path).collect()} == {("a", 3), ("b", 2)}
    sinks.snapshot(spark.range(5).withColumn("bulk", F.lit("x")).orderBy("id"), str(tmp_path / "snap"), ["bulk"], 2)
    assert [r.id for r in spark.read.json(str(tmp_path / "snap")).collect()] == [0, 1]
