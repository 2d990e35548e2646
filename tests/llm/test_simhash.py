import random

import xxhash

from tallyworks.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, radius=3):
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(nodes)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (nodes[a] ^ nodes[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_masks_cover_radius():
    masks, rng = S.covering_masks(3), random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & (m & (1 << 64) - 1) == 0 for m in masks)


def test_fingerprints_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "Cat\t", "É ", "ß\n", " ", "dog  ", "A", "\x1c"]) for _ in range(rng.randint(0, 40)))
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], []
    for k in range(12):
        base.append([rng.choice(words) for _ in range(rng.choice([5, 60, 300]))])
    for i in range(240):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i * 3 % 241, " ".join(b), "clash"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "one two", "x"), (1003, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    expect = brute_components({r[0]: brute_fingerprint(r[1] or "") for r in rows})
    for block in (2048, 3):
        got = S.near_duplicates(docs, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == expect[r.doc_id]
            assert r.fingerprint == f"{brute_fingerprint(dict((x[0], x[1]) for x in rows)[r.doc_id] or ''):016x}"
    assert len(set(expect.values())) < 200
    kept = {r.doc_id for r in S.one_of_each(docs).collect()}
    assert kept == {k for k, v in expect.items() if k == v}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 90)] + [(500, 501)], "a long, b long")
    assert {r.node: r.root for r in S.components(edges).collect()} == {i: 0 for i in range(1, 91)} | {501: 500}


def test_odd_rows_have_defined_results(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(5, long, 1), (3, long + " x", 1), (None, long, 1), (None, "only here and nowhere else", 1), (7, None, 1), (None, "", 1), (9, "same row", 1), (9, "same row", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (None, None), (7, 7), (None, 7), (9, 9), (9, 9)], key=str)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, None, None, 7, None, 9, 9], key=str)


def test_hot_bucket_is_dealt_out_again(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    nodes = {k: f for k, f in enumerate(sorted(fps))}
    frame = spark.createDataFrame([(S._signed(f),) for f in nodes.values()], "fp long")
    expect = brute_components(nodes)
    back = {S._signed(f): k for k, f in nodes.items()}
    for block in (16, 5000):
        root = {k: k for k in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in S.links(frame, 3, block).collect():
            x, y = sorted((find(back[r.a]), find(back[r.b])))
            root[y] = x
        assert {k: find(k) for k in nodes} == expect
