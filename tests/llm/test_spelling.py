import random
import re
import zlib
from collections import Counter

import pytest

from tallyworks.llm import spelling as S


def apart(a, b):
    """Exactly one inserted, deleted or replaced code point, straight from the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            count[low] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def brute(n):
    near = {w: [x for x in n if apart(w, x)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b if n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if form.get(w) else None) for w in n)


def corpus(seed, docs=250, vocab=60):
    rng = random.Random(seed)
    letters = "abeiéÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(vocab)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 80)):
            w = base[min(rng.randrange(vocab) for _ in range(3))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i - 3, rng.choice([" ", "\n", "-", "9", "Ā"]).join(text)))
    return rows


@pytest.mark.parametrize(("seed", "weight"), [(1, 1 << 20), (2, 60), (3, 12)])
def test_whole_result_matches_brute_force(spark, seed, weight):
    rows = corpus(seed) + [(6, "laternens " * 3 + "Laternen " * 9 + "LATERNE " * 30), (None, None), (None, "laterne"), (7, ""), (8, "laterne " * 4), (8, "laterne " * 4)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    expect = brute(brute_words(rows))
    assert sorted(tuple(r) for r in S.variants(docs, weight=weight).collect()) == expect
    assert sum(r[1] is not None for r in expect) > 20 and any(r[2] != r[1] and r[1] for r in expect)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "a bb 123"), (2, None)], "doc_id long, text string")
    assert S.variants(docs).count() == 0 and S.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_tries_find_each_pair_once(seed):
    rng = random.Random(seed)
    found = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(0, 8))) for _ in range(250)})
    got = Counter()
    S.near_in_trie(found, lambda a, b: got.update([tuple(sorted((a, b)))]))
    assert got == Counter((a, b) for i, a in enumerate(found) for b in found[i + 1 :] if apart(a, b))


def test_hot_stem_and_very_long_words(spark):
    """Thousands of words share half of their letters; some words are a hundred thousand letters long."""
    rng = random.Random(9)
    hot = ["hotstem" + "".join(rng.choice("abcde") for _ in range(rng.choice([6, 7]))) for _ in range(1500)]
    long = "x" * 100_000
    rows = [(i, f"{w} {w} {w}" + (f" {w}" * 9 if i % 7 == 0 else "")) for i, w in enumerate(hot)] + [(5000, f"{long} {long} {long}\n" + f"{long[:-1]}y " * 8), (5001, f"{long[:-1]} " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = brute_words(rows)
    buckets = {}
    for w in n:
        for k in {w[:k] + "?" + w[k + 1 :] for k in range(len(w))} | {w[:k] + "?" + w[k:] for k in range(len(w) + 1)} if len(w) < 100 else {w[:9]}:
            buckets.setdefault(k, set()).add(w)
    near = {w: set() for w in n}
    for held in buckets.values():
        for a in held:
            near[a] |= {b for b in held if a != b and (len(a) < 100 or len(b) >= 100) and apart_fast(a, b)}
    got = {r.word: (r.n, r.n_near) for r in S.variants(docs, weight=4000).collect()}
    assert got == {w: (n[w], len(v)) for w, v in near.items()}


def apart_fast(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]
