import hashlib
import re
import textwrap
from collections import Counter

import duckdb

from tallyworks.llm import line_dedup as L
from tallyworks.llm import pii as P

KEY = b"k"


def test_kinds_and_formats_are_kept():
    text = "Mail Ann.Lee7@Mail5.example.com or call +1 (743) 555-3824, IP 70.23.22.57, card 4111 1111 1111 1111; SSN 123-45-6789. Frau Müller met Mr. John Smith and г-жа Анна Петрова. IBAN DE89 3704 0044 0532 0130 00"
    out, found = P.replace(text, KEY, {})
    kinds = [m[2] for m in found]
    assert kinds == ["email", "phone", "ip", "card", "ssn", "family", "given_m", "family", "given_f", "family", "iban"]
    again = P.mentions(out)
    assert [m[2] for m in again] == kinds
    assert not {m[3] for m in found} & {m[3] for m in again}
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}, IP (\d+\.){3}\d+, card (\d{4} ){3}\d{4};", out)
    assert re.search(r"г-жа [А-Я][а-я]+а [А-Я][а-я]+", out)
    assert P._luhn(re.sub(r"\D", "", re.search(r"card ([\d ]+);", out)[1])) == 0


def test_mentions_refer_to_one_entity():
    a = P.replace("x +1 (743) 555-3824 y", KEY, {})[0]
    b = P.replace("x +1 743-555-3824 y", KEY, {})[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "17435553824"
    assert P.replace("no data 12 here", KEY, {})[0] == "no data 12 here"


def test_collisions_are_settled(spark):
    rows = [(i, f"Mr. Aa Bob{chr(97 + i % 26)}{chr(97 + i // 26)} at 20.0.{i}.9 and 20.0.{i}.9", "x") for i in range(30)] + [(900, None, "x"), (901, "", "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    real = P.surrogate

    def narrow(key, kind, norm, attempt=0):  # so few addresses that they must collide, some of them real ones
        return f"20.0.{(int(norm.split('.')[2]) * 7 + attempt * 13) % 90}.9" if kind == "ip" else real(key, kind, norm, attempt)

    texts = []
    for few in (20_000, 0):
        got = P.pseudonymise(docs, KEY, max_exceptions=few, make=narrow).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        texts.append({r.doc_id: r.text for r in got})
        named = [[m[3] for m in P.mentions(r.text) if m[2] == "ip"] for r in got if r.text]
        assert all(len(set(x)) == 1 for x in named)
        after = {x[0] for x in named}
        assert len(after) == 30 and not after & {f"20.0.{i}.9" for i in range(30)}
    assert texts[0] == texts[1] and texts[0][900] is None and texts[0][901] == ""
    assert P.pseudonymise(docs.limit(0), KEY).count() == 0


def test_distinct_entities_stay_distinct(spark):
    rows = [(i, f"ip {i % 7}.{i}.3.{i} mail a{i}@b.com", "x") for i in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    seen = Counter(m[3] for r in P.pseudonymise(docs, KEY).collect() for m in P.mentions(r.text))
    assert len(seen) == 398 and set(seen.values()) == {1}
    entities = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(300)], "kind string, norm string")
    assert P.exceptions(entities, KEY).columns == ["space", "norm", "value"]


def brute_pseudonymise(texts, key, make):
    """Entities resolved quadratically, surrogates given out one after another in plain dictionaries; names by all of their titles."""
    spans = []
    for t in texts:
        held = []
        for c in P.candidates(t or ""):
            if all(c[1] <= h[0] or c[0] >= h[1] for h in held):
                held.append(c)
        spans.append(sorted(held))
    kinds = {}
    for held in spans:
        for _, _, k, n in held:
            kinds.setdefault((k if k in ("email", "card", "iban", "ssn", "ip", "phone") else "name", n), set()).add(k)

    def one(kind, found):
        if kind != "name":
            return kind
        role = next((r for r in ("full", "given") if any(k.startswith(r) for k in found)), "family")
        sexes = {k[-1] for k in found if k[-2:] in ("_m", "_f")}
        return role if role == "family" else f"{role}_{sexes.pop() if len(sexes) == 1 else 'u'}"

    entities = sorted((s, n, one(s, found)) for (s, n), found in kinds.items())
    real, given, values, attempt = {e[:2] for e in entities}, set(), {}, 0
    left = entities
    while left:
        tried = [(s, n, make(key, k, n, attempt)) for s, n, k in left]
        for s, n, v in tried:  # the smallest norm comes first
            if (s, v) not in given and ((s, v) not in real or attempt >= 16):
                given.add((s, v))
                values[s, n] = v
        left, attempt = [e for e in left if e[:2] not in values], attempt + 1
    out = []
    for t, held in zip(texts, spans, strict=True):
        for a, b, k, n in reversed(held):
            t = t[:a] + P.render(t[a:b], k, values.get((k, n)) or values["name", n]) + t[b:]
        out.append(t)
    return out


def test_a_name_is_one_entity_whatever_its_titles(spark):
    """Resolved here without the library: the same two words stand for the same two in every document, no word for two names."""
    titles = ["Mr.", "Mrs.", "Dr.", "Prof.", "Herr", "Lady"]
    given = [f"{a}{b}{c}" for a in "BDGKL" for b in "aeio" for c in ("nn", "rt", "lf")]
    family = [f"{a}{b}{c}" for a in "MNPRS" for b in "aeou" for c in ("ckel", "ssen", "ndt")]
    people = [(given[i % 60], family[(i * 7) % 60]) for i in range(180)]
    rows = [(i, f"{titles[(i * 5 + i // 60) % 6]} {g} {f} came. {titles[i % 6]} {f} left, {g} stayed.") for i, (g, f) in enumerate(people)]
    rows += [(1000 + i, f"Dr. {g} spoke.") for i, g in enumerate(given)]  # given names taken for family names
    rows += [(5000, "Mr. John Smith"), (5001, "Dr. John Smith")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (20_000, 0):
        out = {r.doc_id: r.text for r in P.pseudonymise(docs, KEY, max_exceptions=few).collect()}
        means = {}
        for i, text in rows:
            before, after = (re.findall(r"[^\W\d_]+", t) for t in (text, out[i]))
            assert len(before) == len(after)
            for x, y in zip(before, after, strict=True):
                if x in given or x in family or x in ("John", "Smith"):
                    assert means.setdefault(x, y) == y != x
        assert len(set(means.values())) == len(means) == 122
        assert out[5000].split()[1:] == out[5001].split()[1:]
    women = {g for i, (g, _) in enumerate(people) if titles[(i * 5 + i // 60) % 6] in ("Mrs.", "Lady")}
    men = {g for i, (g, _) in enumerate(people) if titles[(i * 5 + i // 60) % 6] in ("Mr.", "Herr")}
    assert women - men and all(means[g].endswith("a") for g in women - men)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    narrow = lambda key, kind, norm, attempt=0: P.surrogate(key, kind, norm, attempt) if kind != "ip" else f"10.0.{(sum(norm.encode()) + 31 * attempt) % 256}.{attempt}"
    for make in (P.surrogate, narrow):
        got = {r.doc_id: r.text for r in P.pseudonymise(docs, KEY, make=make).collect()}
        assert got == dict(zip([r.doc_id for r in rows], brute_pseudonymise([r.text for r in rows], KEY, make), strict=True))


def test_names_are_followed_through_the_text():
    text = "Mr. John Smith called. Smith said John was late; Dr. Jane Roe, Prof. Lee and Sir John Hall agreed. Ms. Jane Roe left. Roe's smith."
    out, found = P.replace(text, KEY, {})
    assert not re.search(r"\b(John|Smith|Jane|Roe|Lee|Hall)\b", out) and out.endswith("'s smith.")
    assert {m[3]: m[2] for m in found} == {"john": "given_m", "smith": "family", "jane": "given_f", "roe": "family", "lee": "family", "hall": "family"}
    words = re.findall(r"[A-Z][a-z]+", out)
    assert words[1] == words[4] and words[2] == words[3]  # John ... John, Smith ... Smith


def test_scripts_without_case():
    for text, kind in (("王偉明先生說王偉明來了", "full_m"), ("김민준 씨가 왔다. 김민준", "full_u"), ("السيد محمد وصل ثم محمد ذهب", "given_m")):
        out, found = P.replace(text, KEY, {})
        assert [m[2] for m in found] == [kind] * 2 and len({m[3] for m in found}) == 1
        assert found[0][3] not in out and P.script_of(out) == P.script_of(text) and len(out.split()) == len(text.split())


def test_small_spaces_widen(spark):
    entities = [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = P.exceptions(spark.createDataFrame(entities, "kind string, norm string"), KEY)
    assert got.select("value").distinct().count() == got.count() > 0


def test_very_long_text_is_linear():
    text = " ".join(f"a{i}@b{i}.org" for i in range(60_000))
    assert len(P.mentions(text)) == 60_000


def brute_units(rows, least=15):
    """Quadratic: pieces cut character by character, each compared with all that stand before it."""
    blanks, units = " \t\n\x0b\x0c\r", []
    for d, t in sorted({(d, t) for d, t in rows if t and d is not None}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest())):
        at, i = 0, 0
        while i < len(t):
            j = i + 1
            while j < len(t) and t[j] in blanks:
                j += 1
            blank_line = t[i] == "\n" and "\n" in t[i + 1 : j]
            if t[i] in ".!?" and j > i + 1 or t[i] in "。！？" or blank_line:
                units.append((d, at, j, t[at:j]))
                at = j
            i = j if at == j else i + 1
        if at < len(t):
            units.append((d, at, len(t), t[at:]))
    plain = [" ".join(w for w in re.split(f"[{blanks}]+", u[3]) if w).lower() for u in units]
    out = []
    for n, (d, a, b, _) in enumerate(units):
        letters = sum(any(x <= c <= y for x, y in ("\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u3400\u9fff")) for c in plain[n])
        if (plain[n].count(" ") + 1 >= least or letters >= 24) and plain[n] in plain[:n]:
            k = plain.index(plain[n])
            out.append((d, a, b, plain[n].count(" ") + 1, units[k][0], units[k][1]))
    return sorted(out)


def sentence(k, n):
    return "W" + " ".join(f"{k}x{i}" for i in range(n)) + "."


def test_repeated_units_match_brute_force_and_sql(spark):
    a, b, c = sentence(1, 60), sentence(2, 15), "Ä " + sentence(3, 20)
    rows = [(3, f"{a}\nShort. {a.upper()}  "), (1, f"Short.\n\n{b}\n{c}"), (2, f"{b.replace(' ', '  ')}\r\n\n{c}\nown\n{a}\nshort"), (5, f"x {b}\n{b}\nshort\nown words\n{c}"), (7, None), (8, ""), (9, "short"), (None, a), (4, f"É {b}\n" * 3), (2, f"{b.replace(' ', '  ')}\r\n\n{c}\nown\n{a}\nshort"), (12, f"長い文。{c}! {b}")]
    han, thai = "".join(chr(0x4E00 + 7 * k) for k in range(24)), "".join(chr(0x0E01 + k) for k in range(30))
    rows += [(20, f"x {han}。短い文。{thai}"), (21, f"{han[1:]}。短い文。\n\n{thai}"), (22, f"x {han}。{han[1:]}。短い文。")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row_key string")
    got = sorted(tuple(r) for r in L.repeated_units(docs).collect())
    assert got == brute_units(rows) and {r[0] for r in got} == {2, 3, 4, 5, 12, 21, 22}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(L.SQL).fetchall()) == got
    left = {r.doc_id: r.text for r in L.without_repeats(docs).collect()}
    assert left[1] == rows[1][1] and left[3] == f"{a}\nShort. " and left[7] is None and left[9] == "short" and left[5] == f"x {b}\nshort\nown words\n{c}"
    assert L.without_repeats(docs).columns == docs.columns and L.without_repeats(docs).count() == len(rows) and L.repeated_units(docs.limit(0)).count() == 0


def test_every_piece_counts_with_a_least_length_of_one(spark):
    rows = [(1, "One line. Two"), (2, "two\n\nOne line. Three! 短い。"), (3, "短い。 four")]
    got = L.repeated_units(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()
    assert sorted(tuple(r) for r in got) == brute_units(rows, 1) and len(got) == 3


def test_wrapping_and_place_in_a_line_do_not_matter(spark):
    passage = [sentence(k, 17) for k in range(4)]
    wrapped = "\n".join(textwrap.wrap(" ".join(passage), 40))
    rows = [(1, f"Some words before {' '.join(passage)} and after."), (2, f"Other start. {wrapped} Other end."), (3, "Clean text, nothing of it elsewhere, of more than fifteen words, so that it would count as a unit.")]
    got = L.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.words) for r in got} == {(2, 17)} and len(got) == 3  # the first sentence is glued to words before it in document 1


def test_texts_of_one_id_are_cut_apart(spark):
    a, b = sentence(1, 20), sentence(2, 20)
    rows = [(1, f"{a} Tail."), (2, f"{a} {b}"), (2, f"{b} Own {a}")]
    got = {r.text for r in L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_key = sorted(rows[1:], key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    first = by_key[0][1] == rows[1][1]
    assert got == ({rows[0][1], b, f"Own {a}"} if first else {rows[0][1], "", f"{b} Own {a}"})


def test_very_long_text(spark):
    text = " ".join(sentence(k, 16) for k in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert L.repeated_units(docs).count() == 20_000
    assert [r.text for r in L.without_repeats(docs).orderBy("doc_id").collect()] == [text, ""]
