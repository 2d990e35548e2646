"""Story clusters against brute force, without blocks; entity veto and anchors."""

import random

from pyspark.sql import functions as F

from tallyworks.operators import similarity
from tallyworks.operators.similarity import ANCHORS, MAJOR_ENTITIES


def linked(a, b):
    x, y = a & set(MAJOR_ENTITIES), b & set(MAJOR_ENTITIES)
    if x and y and x != y:
        return False
    return any(set(p) <= a and set(p) <= b for p in ANCHORS) or (len(a & b) >= 3 and len(a & b) / min(len(a), len(b)) >= 0.55)


def brute(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if set(s) == set(t) or linked(set(s), set(t)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in rows}


def test_clusters_match_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{int(60 * rng.random() ** 2)}" for _ in range(400)] + MAJOR_ENTITIES * 3 + [w for p in ANCHORS for w in p]
    rows = [(i, list({rng.choice(words) for _ in range(rng.randint(3, 9))})) for i in range(90)]
    rows += [(100, ["breaking", "rocket", "lands", "safely"]), (101, ["again", "rocket", "lands", "safely"]), (102, ["openai", "rocket", "lands", "safely"]), (103, ["google", "launch", "pad", "burns"]), (104, ["openai", "launch", "pad", "burns"]), (105, ["chorleywood", "bread", "p1"]), (106, ["chorleywood", "bread", "x"]), (107, ["meta", "chorleywood", "bread"])]
    rows = [(d, t) for d, t in rows if len(t) >= 3]
    frame = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    got = {r.doc_id: r.cluster for r in similarity.story_components(frame).collect()}
    assert got == brute(rows)
    small = {r.doc_id: r.cluster for r in similarity.story_components(frame.where("doc_id >= 100")).collect()}
    assert small == {100: 100, 101: 100, 102: 100, 103: 103, 104: 104, 105: 105, 106: 105, 107: 105}


def test_gate_columns(spark):
    cases = [(["openai", "a", "b", "c"], ["google", "a", "b", "c"]), (["a", "b", "c", "d"], ["a", "b", "c", "e"]), (["a", "b"], ["a", "b"]), (["openai", "bot", "q"], ["openai", "bot", "z", "k"])]
    got = spark.createDataFrame(cases, "a array<string>, b array<string>").select(similarity.entity_veto(F.col("a"), F.col("b")), similarity.same_story(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (False, True)]


def test_pair_test_takes_first_rule(spark):
    day, none = 86400, []
    same, other = ["a", "b", "c", "d"], ["p", "q", "r", "s"]
    cases = [
        ((["u", ""], ["u"], False, 1, 30 * day, ["openai"], ["google"], 0.1, "", "", none, none), True),
        (([""], [""], False, 1, 2, same, other, None, "", "", none, none), False),
        ((none, none, False, 1, 8 * day, same, same, 0.95, "", "", none, none), False),
        ((none, none, True, 1, 8 * day, same, same, 0.95, "", "", none, none), True),
        ((none, none, False, 1, 2, ["openai", *same], ["google", *same], 0.95, "", "", none, none), False),
        ((none, none, False, 1, 2, same, same, 0.7, "k", "k", none, none), False),
        ((none, none, False, 1, 2, same, other, 0.8, "k", "k", none, none), False),
        ((none, none, False, 1, 2, same, other, None, "one-two-six", "one-two-six-ten", none, none), True),
        ((none, none, False, 1, 2, same, other, None, "", "", ["x", "y"], ["y", "x"]), True),
        ((none, none, False, 1, 2, same, same, None, "", "", none, none), True),
    ]
    names = "urls_a urls_b asset ts_a ts_b tokens_a tokens_b similarity key_a key_b entities_a entities_b".split()
    kinds = "array<string> array<string> boolean long long array<string> array<string> double string string array<string> array<string>".split()
    frame = spark.createDataFrame([c for c, _ in cases], ", ".join(map(" ".join, zip(names, kinds)))).coalesce(1)
    got = [r[0] for r in frame.select(similarity.duplicate_story(*[F.col(n) for n in names])).collect()]
    assert got == [e for _, e in cases]


def test_keys_link_unless_entities_veto(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["openai", "google"]
    rows = [(i, list({rng.choice(words) for _ in range(rng.randint(1, 5))}), f"u{rng.randint(0, 25)}" if rng.random() < 0.7 else "", f"k{rng.randint(0, 40)}" if rng.random() < 0.5 else None) for i in range(80)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def vetoed(a, b):
        x, y = a & set(MAJOR_ENTITIES), b & set(MAJOR_ENTITIES)
        return bool(x and y and x != y)

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s, t = set(a[1]), set(b[1])
            keyed = not vetoed(s, t) and any(a[k] and a[k] == b[k] for k in (2, 3))
            if s == t or keyed or linked(s, t):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    frame = spark.createDataFrame(rows, "doc_id long, tokens array<string>, url string, story string")
    got = {r.doc_id: r.cluster for r in similarity.story_components(frame, keys=["url", "story"]).collect()}
    assert got == {d: find(d) for d in root}


def test_session_picks_match_brute_force_over_the_whole_table(spark):
    from tallyworks.plans import upkeep
    from tallyworks.plans.inbox import inbox

    sf = "/root/testdata/sf0.001"
    rows = upkeep.session_candidates(inbox(spark, sf), "2024-01-20", 13).collect()
    used, expect = set(), []
    for s, families in enumerate(upkeep.SESSIONS.values()):
        ordered = sorted(rows, key=lambda r: (r.priorities[s], -r.weight, r.item))
        taken = []
        for family in families:
            for r in ordered:
                if r.family == family and r.item not in used:
                    taken.append(r)
                    used.add(r.item)
                    break
        while len(taken) < 4:
            r = next(r for r in ordered if r.item not in used)
            taken.append(r)
            used.add(r.item)
        expect += [(s + 1, n, r.item, r.family) for n, r in enumerate(taken, 1)]
    assert {r.priorities[0] for r in rows} == {1, 2, 3, 4}
    assert sorted(map(tuple, upkeep.session_picks(spark, sf).collect())) == expect


def test_greedy_stories_match_brute_force_over_the_whole_table(spark):
    import re

    from tallyworks.functions import text
    from tallyworks.registry import QUERIES
    from tallyworks import queries  # noqa: F401

    sf, rows = "/root/testdata/sf0.001", []
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", "text").collect():
        words = re.findall("[a-z0-9]+", r.text.split("\n")[0].lower().replace("red sea", " redsea "))
        held = sorted({m for w in words if len(m := text.ENTITY_WORDS.get(w, w)) > 1 and m not in text.ENTITY_STOP_WORDS})
        if len(held) >= 3:
            rows.append((r.doc_id, held))
    assert {r.doc_id: r.cluster for r in QUERIES["greedy_stories"](spark, sf).collect()} == brute(sorted(rows))
