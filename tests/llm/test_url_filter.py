import fnmatch
import random

import pytest

from tallyworks.llm import url_filter as U


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = [r for r in U.RULES if ("." + host).endswith("." + r.host) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict, None
    for g in U.GLOBS:
        if fnmatch.fnmatchcase(f".{host}#{path}", g.pattern):
            return host, path, None, g.verdict, g.pattern
    return host, path, None, "allow", None


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1", "http://net", "http://net/", "http://x.net?/a", "http://notexample.net/de", "http://example.com/de/", "http://example.com/de", "http://user@www.example.com:80/de/x", "http://É.ORG/fr/ü", "ftp://example.org/fr/?q=http://net/", "http://a.org/x.net/", "http://a.org/x://b.net/", "http://spam-farm.example.org/en/", "http://1.2.3.4/x", "http://10.0.0.255:8/x", "http://a.org/cheap-pills", "http://a.com/logo.png?x", "http://a.com/a.png/", "://org/fr/", "http://.net/", "http://a.com/\n.js", "http://😀.com/😀*[x]"]


def test_every_url_matches_brute_force(spark):
    rng = random.Random(4)
    hosts = ["net", "example.net", "www.example.net", "Example.COM", "org", "m.example.org", "spam-farm.x.org", "casino", "1.2.3.4", ""]
    paths = ["", "/", "/en/", "/en", "/de/a", "/fr/b.jpg", "?x=1", "#f", "/en/?a", "/a.css"]
    urls = URLS + [rng.choice(["http://", "https://", "x", "://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "z", "?q", "/.."]) for _ in range(600)]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, "http://net/", "x"), (0, "http://net/", "x"), (None, "http://net/" + "long/" * 20_000 + ".png", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted((tuple(r) for r in U.judge(pages).collect()), key=str)
    assert got == sorted(((p, *brute(u)) for p, u, _ in rows), key=str)
    assert {r[3] for r in got} == {"net/", "example.net/en/", "example.com/de/", "org/fr/", None} and len({r[5] for r in got}) > 4
    assert U.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_globs(seed):
    rng = random.Random(seed)
    letters = "ab*?.é😀"
    globs = ["".join(rng.choice([*letters, "[ab]", "[!a]", "[a-c]", "*"]) for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["a" * 200 + "*b", "*" + "ab" * 70, "", "*", "[!a-c]*", "[[]x"]
    texts = ["".join(rng.choice("aabb.é😀c[") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["a" * 200 + "xb", "ab" * 90, "", "[x"]
    got = U.Automaton(globs).matches(texts)
    assert [[bool(x) for x in row] for row in got] == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_longest_rule_first_of_equal_length_and_other_defaults(spark):
    rules = [U.Rule("block", "a.b", "/"), U.Rule("allow", "b", "/cd"), U.Rule("allow", "b", "/*[x")]
    pages = spark.createDataFrame([(1, "x://a.b/cd"), (2, "x://b/c"), (3, "x://b/*[x?")], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(pages, rules, [], "block").collect()}
    assert got == {1: ("a.b/", "block"), 2: (None, "block"), 3: ("b/*[x", "allow")}
