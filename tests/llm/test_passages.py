import hashlib
import random
import re

import duckdb

from tallyworks.llm import passages as P


def brute_runs(rows, size):
    """Every window of every text against all that stand before it, in a plain dictionary; runs word by word. Also the words that each covered word repeats."""
    letter = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
    first, out, source = {}, [], {}
    for d, t in sorted({(d, t) for d, t in rows if t and d is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest())):
        found = list(re.finditer(f"[{letter}]|[^{letter} \t\n\x0b\x0c\r]+", t))
        words = ["".join(c.lower() if c.isascii() else c for c in m[0]) for m in found]
        covered = {}
        for i in range(len(words) - size + 1):
            at = first.setdefault(tuple(words[i : i + size]), (d, t, i, found[i].start()))
            if at[:3] != (d, t, i):
                for j in range(size):
                    covered.setdefault(i + j, (at[0], at[3]))
                    source.setdefault((d, t, i + j), (*at[:2], at[2] + j))
        for i in sorted(covered):
            if i - 1 not in covered:
                stop = next(j for j in range(i, len(words) + 1) if j not in covered)
                out.append((d, found[i].start(), found[stop - 1].end(), stop - i, *covered[i]))
    return sorted(out), source


def short_sentences(k, n, each=7):
    return " ".join(f"{'W' if i % each == 0 else 'w'}{k}x{i}{'.' if i % each == each - 1 else ''}" for i in range(n))


def test_passages_of_short_sentences_and_of_none(spark):
    """No piece of these passages is a sentence of fifteen words with both ends in it, so no unit of line_dedup is."""
    short, bare = short_sentences(1, 60), " ".join(f"b{i}" for i in range(55))
    rows = [(1, f"Own words here {short} and after"), (2, f"Other start\n{short.replace(' ', chr(10))}\nother end"), (3, f"x {bare} y"), (4, f"no {bare.upper()} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.repeated_passages(docs).collect()}
    assert set(got) == {2, 4} and (got[2].words, got[4].words) == (60, 55)
    assert (got[2].kept_doc_id, got[2].kept_start, got[4].kept_doc_id, got[4].kept_start) == (1, 15, 3, 2)
    assert {r.doc_id: r.text for r in P.without_passages(docs).collect()} == {1: rows[0][1], 2: "Other start\n\nother end", 3: rows[2][1], 4: "no  more"}


def test_one_word_less_is_no_passage(spark):
    bare = " ".join(f"b{i}" for i in range(49))
    for tail, n in (("", 0), (" end", 1)):
        docs = spark.createDataFrame([(1, f"a {bare}{tail} c"), (2, f"d {bare}{tail} e")], "doc_id long, text string")
        assert P.repeated_passages(docs).count() == n


def test_runs_match_brute_force_and_sql(spark):
    rng, rows = random.Random(5), []
    parts = [short_sentences(k, rng.randint(40, 130), rng.randint(3, 30)) for k in range(6)]
    parts += ["the " * 120, "la la lu " * 30, "".join(chr(0x4E00 + 7 * k) for k in range(70)), " ".join(f"Ä{k}İ É" for k in range(40))]
    for d in range(60):
        held = [p if rng.random() < 0.6 else " ".join(p.split()[rng.randint(0, 9) : rng.randint(30, 140)]) for p in rng.sample(parts, 3)]
        held.insert(rng.randint(0, 3), short_sentences(100 + d, rng.randint(1, 80)))
        rows.append((d % 50, rng.choice([" ", "\n", "\r\n \t", ". "]).join(held)))
    rows += [(70, None), (71, ""), (72, " \n"), (None, parts[0]), rows[3], (73, f"\n {parts[1]}"), (74, parts[1].upper())]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row_key string")
    got = sorted(tuple(r) for r in P.repeated_passages(docs).collect())
    assert got == brute_runs(rows, 50)[0] and len(got) > 50 and any(r[0] == r[4] for r in got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(P.SQL).fetchall()) == got
    for size in (1, 2, 7):
        assert sorted(tuple(r) for r in P.repeated_passages(docs, size).collect()) == brute_runs(rows, size)[0]
    left = P.without_passages(docs)
    assert left.columns == docs.columns and left.count() == len(rows) and P.repeated_passages(docs.limit(0)).count() == 0


def test_no_word_is_lost():
    """Each word of a run leads over earlier equal ones to a word that stays."""
    rows = [(d, " ".join(random.Random(d).choices("abc", k=200))) for d in range(20)] + [(30, "x " * 300)]
    runs, source = brute_runs(rows, 6)
    assert runs
    for here in source:
        seen = here
        while seen in source:
            seen = source[seen]
        assert here[1].split()[here[2]] == seen[1].split()[seen[2]]


def test_minimizers_are_of_the_words_alone():
    words = [f"w{i * i % 97}".encode() for i in range(400)]
    whole, grams = P.minimizers(words)
    for shift in (1, 13, 60):
        at, again = P.minimizers(words[shift:])
        assert (again == grams[shift:]).all() and (at + shift == whole[shift:]).all()
    assert len(P.minimizers(words[:49])[0]) == 0 and len(P.minimizers(words[:50])[0]) == 1


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in P.repeated_passages(docs).collect()) == brute_runs(rows, 50)[0]
