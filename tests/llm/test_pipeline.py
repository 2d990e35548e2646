"""The pipeline against a brute-force version of each stage, on a small corpus with planted cases."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tallyworks.llm import decontaminate, quality_rules
from tallyworks.llm.common import table

from .test_decontaminate import brute as infix
from .test_quality import brute as counts
from .test_secrets import brute as secret_spans


def corpus():
    rng = random.Random(11)
    vocab = [f"{a}{b}" for a in ("the", "ing", "or", "mar", "sol", "ten") for b in ("an", "er", "ion", "ly", "es", "ad", "um")]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels = [], []
    item = make(24)
    for i in range(160):
        t = make(rng.randint(25, 120)) + ".\n" + make(10)
        if i % 10 == 3:
            t = docs[i - 1][1]
        elif i % 10 == 5:
            t = " ".join(w + "###$$$" for w in t.split())
        elif i % 20 == 14:  # one word of an earlier document is another
            w = docs[i - 12][1].split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        elif i % 10 == 7:
            t += f'\nour token = "{rng.getrandbits(160):040x}" here'
        elif i % 20 == 9:
            t += " " + item.upper() + " " + make(5)
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        labels.append((i, 0 if i % 10 == 5 else 1, 0))
    docs += [(500, None, "en", "src0", None), (501, "", "en", "src0", 0), (502, "too short", None, None, 9)]
    return docs, labels, [(1, item), (2, make(30))]


def similar(a, b):
    """Jaccard similarity of 0.8 or more between the five-word shingles; shorter texts are one shingle."""
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t).strip(" \t\n\x0b\x0c\r")) for t in (a, b)))
    return len(x & y) >= 0.8 * len(x | y)


def first_of_each(texts):
    """The smallest id that chains of similar texts reach, pair by pair."""
    root = {d: d for d in texts}
    changed = True
    links = [(a, b) for a in texts for b in texts if a < b and similar(texts[a], texts[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    trees = quality_rules.train(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"))

    kept = {}
    for d, t, *_ in docs:
        n = counts(t or "")
        score = trees.score(np.array([quality_rules.statistics(t or "")[1]]))[0]
        if n[0] >= 20 and 100 * n[4] <= 30 * n[0] and score >= 0.5:
            kept[d] = t
    assert {d for d, *_ in docs if d % 10 == 5 and d < 160}.isdisjoint(kept) and len(kept) > 130
    first = first_of_each(kept)
    assert sum(first[d] == d - 12 and kept[d] != kept[d - 12] for d in kept if d % 20 == 14 and d - 12 in kept) >= 3
    kept = {d: t for d, t in kept.items() if first[d] == d}
    assert not any(d % 10 == 3 and d - 1 in kept for d in kept)
    items = [decontaminate.words_of(t) for _, t in bench]
    kept = {d: t for d, t in kept.items() if all(infix(i, decontaminate.words_of(t)) > decontaminate.max_edits(len(i), 0.8) for i in items)}
    assert not any(d % 20 == 9 for d in kept)
    for d, t in kept.items():
        if spans := secret_spans(t):
            out, at = "", 0
            for a, _, b in spans:
                if a >= at:
                    out += t[at:a] + "[SECRET]"
                at = max(at, b)
            kept[d] = out + t[at:]
    assert sum("[SECRET]" in t for t in kept.values()) > 10
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    expect = sorted((d, len(i := encode(t)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in kept.items())
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expect
    frame = table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name


def test_stages_keep_columns_of_any_name_and_judge_repeated_rows_each(spark, tmp_path):
    docs, labels, bench = corpus()
    rows = [(*d, 1, "s", True) for d in docs + docs[:3]] + [(None, docs[0][1], "en", "src0", 9, 1, "s", False), (700, "word " * 200_000, "en", "src1", 1_000_000, 1, "s", False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, spans string, gone boolean")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns, name
        kept = [r.doc_id for r in out.collect()]
        assert kept.count(0) == 2 and kept.count(1) == 2, name
        assert (None in kept) and (700 in kept) == (name != "quality"), name
