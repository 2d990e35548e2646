import random
import re
import zlib
from collections import Counter

import numpy as np

from tallyworks.llm import mil
from tallyworks.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, cover, seen, dup = Counter(grams), set(), set(), 0
    for k, g in enumerate(grams):
        if count[g] > 1:
            cover |= set(range(k, k + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def sample():
    rng = random.Random(3)
    good = ["the", "cat", "sat", "on", "a", "mat", "über", "niño", "then", "walked", "home", "slowly", "again"]
    rows, labels = [], []
    for i in range(400):
        ws = [rng.choice(good) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(rng.randint(25, 200))]
        bad = rng.random() < 0.3
        if bad:
            ws = [w + rng.choice(["###", "$$$", "&&&"]) for w in ws]
        rows.append((i, " ".join(ws) + ".\n" + " ".join(ws[:3]), "clash"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_counts_match_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a\n", "é#", " ", "\n", "\x1c", "|x "]) for _ in range(rng.randint(0, 60)))
        assert Q.statistics(text)[0] == brute(text), repr(text)


def test_trees_are_monotone_and_learn(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trees = Q.train(docs, lab)
    x = np.array([Q.statistics(r[1])[1] for r in rows])
    names = list(Q.FEATURES)
    for f, sign in Q.FEATURES.items():
        if sign:
            up = x.copy()
            up[:, names.index(f)] += 0.05
            assert (sign * (trees.score(up) - trees.score(x)) >= -1e-12).all()
    out = Q.score_documents(docs, trees).collect()
    assert len(out) == 403
    truth = dict((a, b) for a, b, _ in labels)
    right = [r.kept == (truth[r.doc_id] == 1) for r in out if r.doc_id in truth and not r.base_failed]
    assert len(right) > 300 and np.mean(right) > 0.97
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = Q.keep_good(docs, trees)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert Q.train(docs, lab.limit(0)) is None and Q.score_documents(docs, None).where("kept").count() > 300
    assert Q.score_documents(docs.limit(0), trees).count() == 0 and Q.keep_good(docs.limit(0), trees).count() == 0


def test_attention_mil_gradient_and_accuracy(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([*labels, (5, None, 0)], "doc_id long, quality int, toxic int")
    model = mil.train(docs, lab)
    out = mil.score_documents(docs, model).collect()
    truth = dict((a, b) for a, b, _ in labels)
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    unseen = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(unseen) > 40 and np.mean(unseen) > 0.97
    flipped = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in mil.score_documents(docs, mil.train(docs, flipped)).collect()} == {r.doc_id: r.score for r in out}
    assert mil.train(docs, lab.limit(0)) is None and mil.score_documents(docs, None).first().score == 0.5
    assert mil.score_documents(docs.limit(0), model).count() == 0


def test_attention_weights_follow_the_bad_passage():
    clean, junk = "the cat sat on a mat. " * 40, "the### cat$$$ sat&&& " * 40
    x, owner = mil.encode([clean, clean + junk, junk])
    model = mil.fit(np.tile(x, (20, 1)), np.concatenate([owner + 3 * k for k in range(20)]), np.tile([1.0, 0.0, 0.0], 20), epochs=60, batch=20)
    f = model.forward(x, owner, 3)
    assert f["p"][0] > 0.5 > f["p"][1] and np.allclose(np.bincount(owner, f["a"]), 1)


def test_tree_verdict_matches_walking_node_by_node(spark):
    rows, labels = sample()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "word " * 300_000, "x")], "doc_id long, text string, kept string")
    trees = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def walk(x):
        total = trees.start
        for root in trees.roots:
            at = int(root)
            while trees.feature[at] >= 0:
                at = int(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
            total += trees.value[at]
        return total >= 0  # a probability of one half

    texts = {r[0]: r[1] for r in rows} | {900: "", 901: "word " * 300_000}
    for r in Q.score_documents(docs, trees).collect():
        assert r.kept == (not r.base_failed and walk(Q.statistics(texts[r.doc_id])[1]))


def small_model():
    rng = np.random.default_rng(1)
    return mil.Model(np.zeros(5), np.ones(5), rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=4), rng.normal(size=1))


def bag_score(m, bag):
    """One bag, one passage after another, in plain arithmetic."""
    hs, es = [], []
    for x in bag:
        h = np.tanh(np.clip((x - m.mean) / m.scale, -6, 6) @ m.w_in + m.b_in)
        hs.append(h)
        es.append(np.exp(np.clip(sum(np.tanh(h @ m.v[:, k]) / (1 + np.exp(-(h @ m.u[:, k]))) * m.w[k] for k in range(len(m.w))), -30, 30)))
    pooled = sum(e / sum(es) * h for e, h in zip(es, hs, strict=True))
    return 1 / (1 + np.exp(-(pooled @ m.c + m.c0[0])))


def test_attention_forward_and_gradient():
    rng, m = np.random.default_rng(2), small_model()
    x, owner, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    assert np.allclose(m.forward(x, owner, 4)["p"], [bag_score(m, x[owner == k]) for k in range(4)])
    loss = lambda: float(-np.mean([np.log(p if t else 1 - p) for t, p in zip(y, m.forward(x, owner, 4)["p"], strict=True)]))
    for name, grad in mil.gradients(m, x, owner, y).items():
        held = getattr(m, name)
        for at in np.ndindex(held.shape):
            old, step = held[at], 1e-5
            held[at] = old + step
            up = loss()
            held[at] = old - step
            down = loss()
            held[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6, name


def test_scores_match_one_document_at_a_time(spark):
    rows, labels = sample()
    long = " ".join(r[1] for r in rows[:200])
    docs = spark.createDataFrame([*rows[:60], (900, None, "x"), (901, "", "x"), (902, long, "x"), (None, "no id", "x")], "doc_id long, text string, score string")
    m = mil.train(docs, spark.createDataFrame(labels[:60], "doc_id long, quality int, toxic int"))
    texts = {r[0]: r[1] for r in rows} | {900: "", 901: "", 902: long, None: "no id"}
    got = mil.score_documents(docs, m).collect()
    assert len(got) == 64
    for r in got:
        x, _ = mil.encode([texts[r.doc_id]])
        assert abs(r.score - bag_score(m, x)) < 1e-9 and r.predicted == int(r.score >= 0.3) and r.n_passages == max(1, -(-len(texts[r.doc_id].split()) // mil.PASSAGE))


def test_long_documents_are_learned_from_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil, "fit", lambda x, owner, y: seen.append((len(x), np.bincount(owner).tolist(), y.tolist())))
    docs = spark.createDataFrame([(1, "good words " * 64 * 50), (2, "b### " * 10), (4, "fine " * 64 * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    assert all(zlib.crc32(str(i).encode()) % 5 for i in (1, 2, 4))
    mil.train(docs, labels)
    mil.train(docs, labels, max_passages=20)
    assert (seen[0][0], sorted(seen[0][1]), sorted(seen[0][2])) == (104, [1, 3, 100], [0, 1, 1])
    assert (seen[1][0], sorted(seen[1][1]), sorted(seen[1][2])) == (4, [1, 3], [0, 1])
