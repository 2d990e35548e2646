"""Dictionaries as tables against substring search, whatever the blocks."""

import random

import pytest

from tallyworks.operators import dictionary


@pytest.mark.parametrize("block_words", [100_000, 7])
def test_matches_are_those_of_a_search(spark, block_words):
    rng = random.Random(block_words)
    words = [None, "", "É", "abab"] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts = [(i, "".join(rng.choice("abBÉ x") for _ in range(rng.randint(0, 30))), "clash") for i in range(80)] + [(200, None, "x"), (201, "", "x"), (202, "ab" * 100_000, "x")]
    frame = spark.createDataFrame(texts, "id int, body string, word string").repartition(3)
    got = {(r.id, r.word): r.n for r in dictionary.matches(frame, spark.createDataFrame([(w,) for w in words], "word string"), "id", "body", block_words).collect()}
    count = lambda t, w: sum(t.startswith(w, k) for k in range(len(t)))
    low = {w.lower() for w in words if w}
    assert got == {(i, w): n for i, t, _ in texts if t for w in low if (n := count(t.lower(), w))}
    assert dictionary.matches(frame, spark.createDataFrame([], "word string"), "id", "body").count() == 0
    assert dictionary.matches(frame.limit(0), spark.createDataFrame([("a",)], "word string"), "id", "body").count() == 0


def test_domains_and_best_entries(spark):
    texts = spark.createDataFrame([(1, "A gpu and a Model"), (2, "nothing"), (3, None), (4, "model tokens gpu")], "id int, text string")
    entries = spark.createDataFrame([("infra", "GPU"), ("ai", "model"), ("ai", "model"), ("ai", "token")], "domain string, word string")
    assert {r.id: r.domains for r in dictionary.domains(texts, entries, "id", "text").collect()} == {1: "ai,infra", 2: "general", 3: "general", 4: "ai,infra"}
    scored = spark.createDataFrame([("x", "gpu", 2), ("x", "token", 3), ("y", "model", 2), ("z", "nothing", 1)], "entry string, word string, weight int")
    assert {r.id: (r.entry, r.score) for r in dictionary.best_entry(texts, scored, "id", "text", 2).collect()} == {1: ("x", 2), 4: ("x", 5)}


def test_ten_thousand_words(spark):
    words = spark.range(10_000).selectExpr("concat('w', id, 'x') as word")
    texts = spark.range(300).selectExpr("id", "concat('a w', id * 31, 'x and w', id * 33, 'xw', id, 'x') as text")
    got = {(r.id, r.word) for r in dictionary.matches(texts, words, "id", "text", 3000).collect()}
    assert got == {(i, f"w{k}x") for i in range(300) for k in (i * 31, i * 33, i) if k < 10_000}
