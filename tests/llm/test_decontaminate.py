import random

from tallyworks.llm import decontaminate as D


def brute(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def corpus():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(8, 50))]) for i in range(12)]
    docs = []
    for d in range(160):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 2:
            w = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(w) // 4)):
                p, op = rng.randrange(len(w)), rng.randrange(3)
                w[p : p + 1] = [[rng.choice(vocab)], [], [w[p], rng.choice(vocab)]][op]
            ws[len(ws) // 2 : len(ws) // 2] = w
        docs.append((d, " ".join(x.upper() + "," if rng.random() < 0.1 else x for x in ws)))
    return items, docs


def test_infix_distance_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        item, text = ([rng.choice("abcd") for _ in range(rng.randint(1, n))] for n in (8, 15))
        got = D.infix_distance(item, text, 99)
        assert got[0] == brute(item, text)


def test_leaks_match_brute_force(spark):
    items, docs = corpus()
    truth = {(d, i): e for d, t in docs for i, ws in items if (e := brute([w.encode() for w in ws], D.words_of(t))) <= D.max_edits(len(ws), 0.8)}
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items] + [(50, None), (51, ""), (None, "a b c d")], "item_id long, text string")
    for max_bytes in (1 << 20, 600):
        got = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(frame, bench, max_bytes=max_bytes).collect()}
        assert got.items() <= truth.items() and len(got) >= 0.97 * len(truth)
    kept = {r.doc_id for r in D.clean_only(frame, bench).collect()}
    assert kept == {r.doc_id for r in frame.collect()} - {d for d, _ in got}
    assert D.find_leaks(frame, bench.limit(0)).count() == 0 and D.clean_only(frame.limit(0), bench).count() == 0
    assert D.clean_only(frame, bench).columns == frame.columns


def test_recall_at_the_bound(spark):
    """Copies with exactly as many edits as are allowed, brute force says which are within the bound."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(8, 60))]) for i in range(40)]
    docs = []
    for d in range(600):
        i, w = rng.choice(items)
        w = list(w)
        for _ in range(D.max_edits(len(w), 0.8)):
            p, op = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + 1] = [[rng.choice(vocab)], [], [w[p], rng.choice(vocab)]][op]
        docs.append((d, i, [rng.choice(vocab) for _ in range(30)] + w + [rng.choice(vocab) for _ in range(30)]))
    index = D.Index([(i, [x.encode() for x in ws]) for i, ws in items], 0.8, D.walks_for(0.995, 0.8, 5, 12), 5, 12)
    found = index.leaks([" ".join(ws) for _, _, ws in docs])
    assert sum(i in {x[0] for x in leaks} for (_, i, _), leaks in zip(docs, found, strict=True)) >= 0.99 * len(docs)


def test_defined_results_for_odd_rows(spark):
    item = " ".join(f"k{j}" for j in range(30))
    long = "filler " * 200_000 + item
    rows = [(None, item, 1), (1, long, 1), (2, item, 1), (2, item, 1), (3, "", 1), (4, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, " ".join(f"m{j}" for j in range(20)))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in D.find_leaks(docs, bench).collect())
    assert got == sorted([("None", 7), ("1", 7), ("2", 7), ("2", 7)])
    assert sorted(r.doc_id for r in D.clean_only(docs, bench).collect()) == [3, 4]


def test_more_blocks_than_a_worker_holds(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)]
    docs = spark.createDataFrame([(i, "a b " + t, 0) for i, t in items], "doc_id long, text string, x int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.in_blocks(bench, max_bytes=150).n > D.HELD
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench, max_bytes=150).collect()) == [(i, i) for i in range(30)]
