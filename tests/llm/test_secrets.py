import hashlib
import random
import re
import zlib

from tallyworks.llm import secrets as S

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def signed(prefix, body):
    v, d = zlib.crc32(body.encode()), ""
    for _ in range(6):
        v, k = divmod(v, 62)
        d = S.BASE62[k] + d
    return prefix + body + d


def test_base_spans_match_brute_force():
    rng, words = random.Random(5), S.automaton()
    bits = ["password", "Secret", "TOKEN", "api_key", "ApiKey", "=", ": ", '"', "'", " ", "AKIA", "akia", "ABCD1234", "deadbeef", "0123456789abcdef", "İ", "K", "ſ", "é", "x", "\n", "toKen=secret:", "abcdef123456"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in S.find_secrets(text, words) if s[1] < 3] == brute(text), text


def test_checksums_decide():
    words = S.automaton()
    good = signed("ghp_", "aB3" * 10)
    assert S.listed(S.find_secrets(f"x {good} y", words)) == "github:2:42"
    assert S.find_secrets(f"x {good[:-1]}{'A' if good[-1] != 'A' else 'B'} y", words) == []
    assert S.find_secrets(signed("npm_", "Q7z" * 10), words) == [(0, 4, 40)]


def test_redaction_joins_overlaps(spark):
    rows = [(1, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b', "t", 53), (2, None, "t", None), (3, "", "t", 0), (4, "clean", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    out = {r.doc_id: r for r in S.redacted(docs).collect()}
    assert out[1].text == 'a [SECRET]" b' and out[1].n_chars == 13
    assert out[2].text is None and out[3].text == "" and out[4].n_chars == 5
    got = {r.doc_id: r for r in S.scan(docs).collect()}
    assert (got[1].n_assign, got[1].n_hex) == (1, 1) and got[2].spans == "" and len(got) == 4
    assert S.scan(docs.limit(0)).count() == 0


def test_base_digest_matches_brute_force_of_long_and_repeated_rows(spark):
    rng = random.Random(9)
    parts = ["password = ", "Secret: '", "AKIA", "ABCDEFGH1234567890", "deadbeefdeadbeef", "api_key=", "x" * 15, " ", "\n", "é", "ß", "token\"", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["filler word " * 100_000 + " password=abcdefghijkl0 " + "tail " * 100_000]

    def base(t):
        rules = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 0, 18), ("hex", r"[0-9a-f]+", 0, 0, 16))
        spans = [(m.start(), n, m.end(), kind) for n, (kind, p, flags, group, least) in enumerate(rules) for m in re.finditer(p, t, flags) if len(m[group]) >= least]
        return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()

    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[1], 1), (1000, None, 1)]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string, n_hex int")).collect()
    expect = sorted((str(d), base(t or "")) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == expect
