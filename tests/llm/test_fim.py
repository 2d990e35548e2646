import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import fim as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["the ", "Cat\t", "É ", "ß\n", " ", "dog  ", "A", "\x1c", "\x0b", "\x85", "😀", "中文 ", "<P", ">", "<", "S>", "0", "1"]


def brute(doc_id, text):
    w = TOKEN.findall(text)
    n = len(w)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_ends_and_ranked_bits():
    for t in [*texts(1), "", " ", "a", " a", "a ", "\n\n", "a  b \t c  "]:
        ends, at = [], 0
        for w in TOKEN.findall(t):
            ends.append(at := at + len(w))
        bits = M.token_ends(t)
        assert bits.bit_count() == len(ends)
        assert [M.cut_after(bits, len(t), len(ends), k) for k in range(len(ends) + 1)] == [0, *ends]


def test_every_row_matches_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts(2))] + [(0, "same row again", "x"), (0, "same row again", "x"), (None, "no id here", "x"), (-5, "below zero ", "x"), (900, None, "x"), (901, "", "x"), (902, "has <M> in it", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = sorted((tuple(r) for r in M.fill_in_middle(docs).collect()), key=str)
    assert got == sorted(((d, *brute(d, t or "")) for d, t, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expect = sorted(((d, *(b := brute(d, t or ""))[:4], digest(b[4]), digest(t or "")) for d, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in M.digests(docs).collect()), key=str) == expect
    assert M.digests(docs.limit(0)).count() == 0


def test_long_texts_in_linear_time():
    long = "word " * 400_000 + "x" * 1_000_000 + " " * 1_000_000
    assert M.transformed(long, M.dice(42, 3), 100, 80, M.MARKS)[0] == 400_002


def test_other_marks_and_rates(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with <P> in it") for i in range(60)], "doc_id long, text string")
    marks = ("⟪pre⟫", "⟪suf⟫", "⟪mid⟫")
    out = M.fill_in_middle(docs, rate=100, spm_rate=0, marks=marks).withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in out} == {"psm"} and all(r.back == f"text number {r.doc_id} with <P> in it" for r in out)
    with pytest.raises(ValueError):
        M.fill_in_middle(docs, marks=("<P>", "<P>", "<M>"))
