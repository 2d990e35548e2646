"""Classification columns: language, source axis, platform family, weights and ladders. Rules are data; the first that holds wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CODE_NAMES = "github hugging arxiv code paper model deepmind openai anthropic research".split() + ["hf "]
CODE_HOSTS = "github.com huggingface.co arxiv.org deepmind.google openai.com anthropic.com claude.dev research.google".split()
TALK_NAMES = ["hacker news", "reddit", "geeknews", "lobsters", "hada.io", "youtube", "twitter", "community", "forum", "v2ex"]
TALK_HOSTS = "ycombinator.com reddit.com hada.io youtube.com youtu.be x.com".split()


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def first_match(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def source_axis(platform: Column, url: Column) -> Column:
    """PRESS, COMMUNITY or CODE."""
    p, u = F.lower(F.coalesce(platform, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    korean = any_of(p, ["pytorchkr", "pytorch.kr"]) | u.contains("discuss.pytorch.kr")
    code = any_of(p, CODE_NAMES) | any_of(u, CODE_HOSTS)
    talk = (any_of(p, TALK_NAMES) | any_of(u, TALK_HOSTS)) & ~p.contains("the hacker news")
    return first_match([(korean, "COMMUNITY"), (code, "CODE"), (talk, "COMMUNITY")], "PRESS")


def source_axis_joined(platform: Column, url: Column) -> Column:
    """The axis as the enrichment worker reads it: patterns over name and URL together."""
    x = F.lower(F.concat_ws(" ", F.coalesce(platform, F.lit("")), F.coalesce(url, F.lit(""))))
    code = x.rlike(r"github|hugging|hf |arxiv|code|paper|model|deepmind|openai|anthropic|claude\.dev|research")
    talk = (x.rlike("hacker news|ycombinator") & ~x.contains("the hacker news")) | x.rlike(r"reddit|geeknews|lobsters|hada\.io|youtube|youtu\.be|twitter|x\.com|community|forum")
    return first_match([(x.rlike(r"pytorchkr|pytorch\.kr|discuss\.pytorch\.kr"), "COMMUNITY"), (code, "CODE"), (talk, "COMMUNITY")], "PRESS")


def source_axis_hosts(platform: Column, url: Column) -> Column:
    """The axis as the list of sources shows it: names and hosts apart, `space` counts as code."""
    p, u = F.lower(F.coalesce(platform, F.lit(""))), F.lower(F.coalesce(url, F.lit("#")))
    korean = any_of(p, ["pytorchkr", "pytorch.kr"]) | u.contains("discuss.pytorch.kr")
    code = any_of(p, ["github", "space", "hugging", "hf ", "arxiv", "deepmind", "openai", "anthropic", "research"]) | any_of(u, ["github.com", "/spaces/", "huggingface.co", "arxiv.org", "deepmind.google", "openai.com", "anthropic.com", "claude.dev", "research.google", "ai.meta.com"])
    forum = (p.contains("hacker news") | u.contains("ycombinator.com")) & ~p.contains("the hacker news")
    talk = forum | any_of(p, ["reddit", "geeknews", "youtube", "twitter", " x", "lobsters", "v2ex", "community", "forum"]) | any_of(u, ["reddit.com", "hada.io", "youtube.com", "youtu.be", "x.com", "twitter.com"])
    return first_match([(korean, "COMMUNITY"), (code, "CODE"), (talk, "COMMUNITY")], "PRESS")


def language(text: Column) -> Column:
    """KO, JA, ZH by script, else EN."""
    t = F.coalesce(text, F.lit(""))
    return first_match([(t.rlike("[가-힣]"), "KO"), (t.rlike("[぀-ヿ]"), "JA"), (t.rlike("[一-鿿]"), "ZH")], "EN")


def platform_family(platform: Column) -> Column:
    p = F.lower(F.coalesce(platform, F.lit("")))
    return first_match([(p.contains("github"), "GitHub"), (p.contains("hugging"), "HuggingFace"), (p.contains("arxiv") | p.contains("paper"), "ArXiv"), (p.contains("hacker"), "HackerNews"), (p.contains("geek"), "GeekNews")], "TechMedia")


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step that value reaches; steps from the highest down."""
    return first_match([(value >= least, name) for least, name in steps], otherwise)
