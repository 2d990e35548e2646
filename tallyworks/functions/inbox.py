"""Columns of the inbox: facets, audit filters, sort orders, view filters, and the lean row that a list shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import any_of, first_match
from .payload import SOURCES, Parsed, array_length, get, path, sources

# Words by which a source counts as community or press, platforms and hosts by language.
COMMUNITY_WORDS = ["hacker news", "ycombinator", "reddit", "geeknews", "hada.io", "pytorch", "github", "huggingface", "spaces", "arxiv", "youtube", "twitter", "x.com"]
KO_PLATFORMS, KO_HOSTS = r"(?i)daum|geeknews|hada\.io|chosun|donga|yonhap|naver", r"(?i)daum\.net|hada\.io|naver\.com"
ZH_PLATFORMS = r"(?i)weibo|zhihu|36kr|ithome|sspai|bilibili|wechat|qq\.com|sina|baidu|jiqizhixin|qbitai|v2ex|geekpark|oschina|infoq"
ZH_HOSTS = r"(?i)\.cn|\.com\.cn|weibo\.com|zhihu\.com|36kr\.com|ithome\.com|sspai\.com|bilibili\.com|v2ex\.com"
DOMAIN_WORDS = {
    "frontend": (["design", "frontend", "media"], ["design", "media"], ["taste", "concat"]),
    "agent": (["agent"], ["agent"], ["openworker", "praxist"]),
    "scraping": (["scraping", "browser"], ["scraping"], ["watercrawl", "obscura"]),
    "doc": (["doc", "ocr"], ["doc"], ["docling", "anydoc"]),
    "3d": (["3d", "graphics"], ["3d"], ["three"]),
    "rust": ([], [], ["rust", "omarchy", "serverbox"]),
}
STANDARD_WORDS = ["design", "frontend", "media", "agent", "scraping", "doc", "3d"]


def _or(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def facet(name: str, payload: Column, platform: Column, category: Column, item_type: Column) -> Column:
    """MODEL, TOOL or NEWS; several may hold. False where the rule is unknown because a value is missing."""
    kind, family = F.get_json_object(payload, "$.facet_type"), F.get_json_object(payload, "$.model_family")
    artifact = F.get_json_object(payload, "$.artifact_type")
    no_family = F.coalesce(family, F.lit("")).isin("", "standalone")
    rules = {
        "MODEL": [kind == "MODEL", F.get_json_object(payload, "$.is_model") == "true", ~no_family, platform.ilike("%model%"), platform.ilike("%space%"), category.ilike("%model%")],
        "TOOL": [kind == "TOOL", platform.ilike("%github%"), artifact.ilike("%agent%"), artifact.ilike("%skill%"), category.ilike("%devtool%")],
        "NEWS": [kind == "NEWS", item_type == "NEWS", F.get_json_object(payload, "$.ai_enrichment.type_classification") == "NEWS", (F.coalesce(kind, F.lit("")) != "MODEL") & no_family & ~platform.ilike("%github%") & ~platform.ilike("%space%")],
    }[name]
    return F.coalesce(_or(rules), F.lit(False))


def source_matches(platform: Column, wanted: str) -> Column:
    """The wanted text somewhere in the name; % and _ in it are wildcards."""
    return F.coalesce(platform.ilike(f"%{wanted}%"), F.lit(False))


def pending(payload: Column, classified: Column) -> Column:
    """Not enriched, or not classified, or enriched without a date."""
    return F.get_json_object(payload, "$.ai_enrichment.enriched_at").isNull() | ~classified


def number_of(payload: Column | Parsed, at: str) -> Column:
    return F.nullif(get(payload, at), F.lit("")).try_cast("double")


def sort_orders(payload: Column, rank: Column | None = None) -> dict[str, list[Column]]:
    """The named orders of a list of items; every one ends with the unique id."""
    col, down = F.col, F.desc("id")
    delta = F.get_json_object(payload, "$.metric_tracking.delta")
    newest, live = F.desc("created_at"), F.coalesce(col("live_spike_score"), number_of(payload, "spike_analysis.score"), col("viral_score"), F.lit(0.0))
    orders = {
        "created": [col("created_at").desc_nulls_last(), down],
        "pending": [col("created_at").desc_nulls_last(), down],
        "viral-score-desc": [live.desc(), array_length(payload, "sources").desc(), newest, down],
        "growth-delta-desc": [F.when(delta.rlike("^[0-9]+$"), delta.cast("double")).otherwise(0.0).desc(), newest, down],
        "date-source-desc": [col("harvested_date").desc_nulls_last(), newest, down],
        "date-source-asc": [col("harvested_date").asc_nulls_last(), F.asc("created_at"), F.asc("id")],
        "id": [down],
        "date-audit-desc": [col("updated_at").desc_nulls_last(), down],
        "date-audit-asc": [col("updated_at").asc_nulls_last(), F.asc("id")],
        "updated": [col("updated_at").desc_nulls_last(), down],
    }
    if rank is not None:
        orders["spike-date"] = [rank.asc_nulls_last(), F.coalesce("peak_spike_score", "live_spike_score", F.lit(0.0)).desc(), down]
    return orders


def freshest_text(*times: Column) -> Column:
    """The largest of several ISO strings; missing ones count as empty."""
    return F.greatest(*[F.coalesce(t.cast("string"), F.lit("")) for t in times])


def freshest_millis(*times: Column) -> Column:
    """The latest of several dates in milliseconds; missing and broken ones count as 0."""
    return F.greatest(*[F.coalesce(F.unix_millis(t.try_cast("timestamp")), F.lit(0)) for t in times])


def source_language(payload: Column | Parsed, title: Column, platform: Column, url: Column) -> Column:
    """The enrichment's language if it is one of four, else by script, platform and host."""
    named, t, p, u = F.upper(path(payload, "ai_enrichment.source_lang")), F.coalesce(title, F.lit("")), F.coalesce(platform, F.lit("")), F.coalesce(url, F.lit(""))
    rules = [(named.isin("KO", "EN", "ZH", "JA"), named), (t.rlike("[가-힣]") | p.rlike(KO_PLATFORMS) | u.rlike(KO_HOSTS), F.lit("KO")), (t.rlike("[぀-ヿ]"), F.lit("JA")), (t.rlike("[一-鿿]") | p.rlike(ZH_PLATFORMS) | u.rlike(ZH_HOSTS), F.lit("ZH"))]
    return first_match(rules, "EN")


def plain_description(text: Column) -> Column:
    """Without the score line of a forum and the heading of an abstract."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^HN\s*Score:\s*\d+\s*pts\s*(\|\s*Comments:\s*\d+\s*)?(\|\s*)?", "")
    return F.trim(F.regexp_replace(cut, r"(?i)^Abstract:\s*", ""))


def with_own_source(payload: Column | Parsed, platform: Column, url: Column) -> Column:
    """(platform, url) of the sources in lower case, the item's own first where its URL isn't among them."""
    low = lambda s: F.struct(_low(F.coalesce(s["platform"], s["source_name"])).alias("p"), _low(s["url"]).alias("u"))
    held = F.coalesce(sources(payload), F.array().cast(SOURCES))
    own = F.struct(_low(platform).alias("p"), _low(url).alias("u"))
    missing = platform.isNotNull() & ~F.exists(held, lambda s: s["url"].eqNullSafe(url))
    return F.when(missing, F.concat(F.array(own), F.transform(held, low))).otherwise(F.transform(held, low))


def is_community(s: Column) -> Column:
    return any_of(s["p"], COMMUNITY_WORDS) | any_of(s["u"], COMMUNITY_WORDS)


def earliest(own: list[Column], nested: Column) -> Column:
    """The earliest time among columns and an array of texts; null if there is none that parses."""
    times = F.concat(F.array(*own), F.transform(nested, lambda x: x.try_cast("timestamp_ntz")))
    return F.array_min(F.array_compact(times))


def news_view(facet_name: str, payload: Column, platform: Column, category: Column) -> Column:
    """The list of news as its view filters it; these rules differ from those of facet()."""
    kind, artifact = _low(F.get_json_object(payload, "$.facet_type")), F.coalesce(F.get_json_object(payload, "$.artifact_type"), F.lit(""))
    model = F.coalesce(F.get_json_object(payload, "$.is_model") == "true", F.lit(False))
    github = _low(platform).contains("github")
    return {
        "CROSS_SPIKE": F.coalesce(F.get_json_object(payload, "$.is_cross_spiking") == "true", F.lit(False)) | (array_length(payload, "sources") > 1),
        "MODEL": model | (kind == "model"),
        "TOOL": (kind == "tool") | github | artifact.contains("agent") | artifact.contains("skill") | _low(category).contains("devtool"),
        "NEWS": ~(model | (kind == "model") | github),
    }[facet_name]


def any_source(payload: Column, platform: Column, wanted: str) -> Column:
    """The wanted text in the platform's name or in that of some source or cross post."""
    names = lambda at: F.coalesce(F.from_json(F.get_json_object(payload, f"$.{at}"), "array<struct<platform:string,source_name:string>>"), F.array().cast("array<struct<platform:string,source_name:string>>"))
    nested = _or([F.exists(names(at), lambda s: _low(F.coalesce(s["platform"], s["source_name"])).contains(wanted.lower())) for at in ("sources", "cross_posts")])
    return _low(platform).contains(wanted.lower()) | nested


def model_view(family: Column, modality: Column, artifact: Column, searchable: Column, wanted_family: str = "ALL", wanted_modality: str = "ALL", wanted_artifact: str = "ALL", search: str = "") -> Column:
    """The list of models: modality and artifact are equal, a family is contained, all words of the search stand somewhere."""
    fam, conditions = _low(family), [F.lit(True)]
    if wanted_modality != "ALL":
        conditions.append(_low(modality) == wanted_modality.lower())
    if wanted_family == "Standalone":
        conditions.append(any_of(fam, ["standalone", "독립"]) | (fam == ""))
    elif wanted_family == "Audio / Speech":
        conditions.append(any_of(fam, ["audio", "speech", "tts", "whisper"]))
    elif wanted_family != "ALL":
        conditions.append(fam.contains(wanted_family.lower()))
    if wanted_artifact != "ALL":
        conditions.append(F.coalesce(artifact, F.lit("WEIGHTS")) == wanted_artifact)
    q = search.lower().strip()
    if q:
        text = F.lower(searchable)
        conditions.append(text.contains(q) | reduce(lambda a, b: a & b, [text.contains(t) for t in q.split()]))
    return reduce(lambda a, b: a & b, conditions)


def portfolio_domain(domain: str, category: Column, cluster: Column, text: Column) -> Column:
    """Whether a case belongs to a domain by words of its category, cluster and full text; `other` has none of the standard words."""
    cat, clus, full = _low(category), _low(cluster), F.lower(text)
    if domain == "other":
        return ~(any_of(cat, STANDARD_WORDS) | full.contains("rust"))
    if domain not in DOMAIN_WORDS:
        return F.lit(True)
    in_category, in_cluster, in_text = DOMAIN_WORDS[domain]
    return _or([any_of(c, words) for c, words in ((cat, in_category), (clus, in_cluster), (full, in_text)) if words])


def platform_weight(name: Column) -> Column:
    """How much a platform counts when one of several is shown."""
    n = _low(name)
    steps = [(n.contains("github"), 100), (n.contains("space"), 96), (any_of(n, ["hugging", "hf"]), 95), (n.contains("arxiv"), 90), (any_of(n, ["hacker news", "ycombinator"]), 85), (n.contains("pytorch"), 80), (any_of(n, ["geeknews", "hada.io"]), 75), (n.contains("reddit"), 60)]
    return first_match(steps, 50)


#: Short names of platforms by their lower-case name. Fixed values.
SHORT_NAMES = {
    "the hacker news": "The Hacker News", "the hacker news (security)": "The Hacker News", "the new york times": "NYT", "the wall street journal": "WSJ", "the guardian": "The Guardian", "the verge": "The Verge", "the verge ai": "The Verge",
    "techcrunch ai": "TechCrunch", "techcrunch": "TechCrunch", "hacker news": "HN", "geeknews": "GeekNews", "reddit r/technology": "Reddit", "reddit": "Reddit", "reuters": "Reuters", "bloomberg": "Bloomberg", "politico": "Politico", "bbc": "BBC", "cnn": "CNN",
    "cbs news": "CBS", "abc news": "ABC", "breaking news, latest news and videos": "ABC News", "usa today": "USA Today", "al jazeera": "Al Jazeera", "axios": "Axios", "cnet": "CNET", "wired": "WIRED", "ft.com": "FT", "npr.org": "NPR", "npr": "NPR", "time.com": "TIME", "time": "TIME",
    "vietnam.vn": "Vietnam.vn", "nextgov.com": "NextGov", "newser": "Newser",
}


def platform_name(raw: Column) -> Column:
    """The name to show: out of Press(...), without a topic in brackets, short where a short name is known."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    inner = F.regexp_extract(name, r"(?i)^(?:Press|News|YouTube)\s*\((.*?)\)$", 1)
    name = F.when(inner != "", F.trim(inner)).otherwise(name)
    name = F.trim(F.regexp_replace(name, r"(?i)\s*\((?:Security|Tech|AI|IT|SW)\)$", ""))
    short = F.element_at(F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv]), F.lower(name))
    return F.when(F.coalesce(raw, F.lit("")) == "", "News").when(F.lower(name).startswith("reddit"), "Reddit").when(name.contains("조코딩"), "YouTube (조코딩)").otherwise(F.coalesce(short, name))


def primary_platform(platform: Column, payload: Column) -> Column:
    """The platform of most weight among the item's own and its sources, the first of equals, as it is shown."""
    own = F.coalesce(platform, F.lit("Tech News"))
    nested = F.coalesce(F.transform(sources(payload), lambda s: F.coalesce(s["platform"], s["source_name"], F.lit(""))), F.array().cast("array<string>"))
    best = F.aggregate(nested, own, lambda held, n: F.when(platform_weight(n) > platform_weight(held), n).otherwise(held))
    return platform_name(best)


def facet_of(is_model: Column, platform: Column) -> Column:
    return first_match([(is_model, "MODEL"), (_low(platform).contains("github"), "TOOL")], "NEWS")


def distinct_urls(urls: Column) -> Column:
    """URLs without fragments, each once; '#' alone stands for none and is kept each time."""
    plain = F.transform(urls, lambda u: F.regexp_replace(F.lower(F.trim(F.coalesce(u, F.lit("#")))), "#.*$", ""))
    return F.filter(plain, lambda u, i: (u == "") | (F.array_position(plain, u) == i + 1))


def collection_orders() -> dict[str, list[Column]]:
    """Orders of a shown collection by columns a (audit time), s (source time), v (score), title and inbox_id."""
    c = F.col
    return {
        "date-source-desc": [F.desc("s"), F.desc("inbox_id")],
        "date-source-asc": [c("s"), c("inbox_id")],
        "date-audit-desc": [F.desc("a"), F.desc("s"), F.desc("inbox_id")],
        "date-audit-asc": [c("a") == 0, c("a"), c("s"), c("inbox_id")],
        "title-asc": [c("title"), c("inbox_id")],
        "viral-desc": [F.desc("v"), F.desc("s"), F.desc("inbox_id")],
        "viral-asc": [c("v"), c("s"), c("inbox_id")],
    }
