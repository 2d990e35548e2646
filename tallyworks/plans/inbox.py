"""Queries over the inbox: facets, audit and view filters, named sort orders, lean rows, cases. The inbox is made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import inbox as ib
from ..functions import payload as pl
from ..operators import search
from ..registry import ORACLE, QUERIES, query
from ..sources.tables import table
from .payloads import SOURCE_LIST


def _choice(modulus: int, values: list[str], otherwise: str = "NULL") -> str:
    return f"CASE event_id % {modulus} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + f" ELSE {otherwise} END"


def _field(name: str, modulus: int, values: list[str]) -> str:
    """A field of the JSON text, there for the first residues only."""
    return _choice(modulus, [f"',\"{name}\":{v}'" for v in values], "''")


# One text for both engines: every branch of the rules below has rows, missing and empty values included.
PLATFORM = _choice(9, ["'GitHub Official'", "'Hacker News'", "'YouTube (Chan)'", "'Hugging Face Models'", "'HF Space'", "'GeekNews'", "'Press (Reuters)'", "'Reddit r/LocalLLaMA'"])
TITLE = _choice(10, ["'Qwen 2.5 weights'", "'라마 모델 공개'", "'開源模型'", "'ひらがな demo'", "'vLLM agent framework'", "'Court verdict'", "'Central bank gold'", "'DeepSeek R1'", "'Whisper speech'"], "'Plain note'")
URL = "'https://' || " + _choice(6, ["'github.com/o/r'", "'news.ycombinator.com/item?id='", "'hada.io/t'", "'36kr.com/p'"], "'blog.example.com/p'") + " || CAST(event_id % 40 AS VARCHAR(20))"
PAYLOAD = "'{\"v\":1' || " + " || ".join([
    _field("facet_type", 7, ['"MODEL"', '"TOOL"', '"NEWS"']),
    _field("is_model", 11, ["true", "false"]),
    _field("is_cross_spiking", 9, ["true"]),
    _field("model_family", 12, ['""', '"standalone"', '"Qwen-2.5"', '"Audio / TTS"']),
    _field("task_modality", 5, ['"Text"', '"Audio"']),
    _field("artifact_type", 13, ['"SKILL_AGENT"', '"WEIGHTS"', '"agent-kit"']),
    _field("ai_enrichment", 8, ['{"type_classification":"NEWS","enriched_at":"2024-01-20T01:02:03","source_lang":"en"}', '{"type_classification":"TECH","source_lang":"ko"}', '{"enriched_at":"2024-01-19T00:00:00","source_lang":"fr"}', '{"enriched_at":"2024-01-18T20:00:00","programming_lang":"Rust"}']),
    _field("tier2_category", 14, ['"INFERENCE_SERVING"']),
    _field("metric_tracking", 4, ['{"delta":"12"}', '{"delta":"n/a"}', '{"delta":"150"}']),
    _field("spike_analysis", 5, ['{"score":"0.2"}', '{"score":""}', '{"score":"7"}']),
    _field("description", 4, ['"HN Score: 12 pts | Comments: 3 | A body"', '"Abstract: A body"', '"HN Score: 5 pts"']),
    _field("published_at", 6, ['"2024-01-12"', '"2023-12-31"', '"not a date"']),
    _field("hook", 3, ['"A hook"']),
    f"',\"sources\":' || {SOURCE_LIST}",
    "',\"cross_posts\":' || " + _choice(10, ["'[{\"platform\":\"Reddit\"}]'", "'[]'"], "'null'"),
]) + " || '}'"
CATEGORY = _choice(6, ["'FOUNDATION_MODELS'", "'AGENTS_DEVTOOLS'", "'INDUSTRY_TRENDS'", "'SOFTWARE_WEB'", "'OTHER'"])
COLUMNS = {
    "id": "event_id", "inbox_id": "'n' || CAST(event_id AS VARCHAR(20))", "user_id": "user_id", "source_platform": PLATFORM, "source_url": URL, "title": TITLE, "item_type": _choice(5, ["'NEWS'", "'TECH'", "'MODEL'"]), "category_primary": CATEGORY,
    "viral_score": "CAST(event_id % 500 AS DOUBLE)", "is_classified": "event_id % 3 = 0", "harvested_date": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END", "created_at": "ts", "updated_at": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY END",
    "live_spike_score": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 17 AS DOUBLE) END", "peak_spike_score": "CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 23 AS DOUBLE) END", "triage_status": _choice(10, ["'archived'", "NULL"], "'new'"), "payload": PAYLOAD,
}
INBOX = "inbox AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM events)"
RANKS = "ranks AS (SELECT id AS item_id, rank_position FROM (SELECT id, row_number() OVER (ORDER BY viral_score DESC, id) AS rank_position FROM inbox WHERE CAST(created_at AS DATE) = DATE '2024-01-15') WHERE rank_position <= 50)"


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in COLUMNS.items()])


def ranks(items: DataFrame) -> DataFrame:
    """The fifty items of most weight of one day, with their rank."""
    best = items.where(F.to_date("created_at") == F.lit("2024-01-15").cast("date")).orderBy(F.desc("viral_score"), "id").limit(50)
    return best.select(F.col("id").alias("item_id"), F.row_number().over(Window.orderBy(F.desc("viral_score"), "id")).alias("rank_position"))  # of fifty rows


P, PLAT, CAT = F.col, "source_platform", "category_primary"
JS = "json_extract_string(payload, '$.{}')".format
NO_FAMILY = f"coalesce({JS('model_family')}, '') IN ('', 'standalone')"


@query(f"""
WITH {INBOX} SELECT id,
  coalesce({JS('facet_type')} = 'MODEL' OR {JS('is_model')} = 'true' OR NOT {NO_FAMILY} OR source_platform ILIKE '%model%' OR source_platform ILIKE '%space%' OR category_primary ILIKE '%model%', false) AS model,
  coalesce({JS('facet_type')} = 'TOOL' OR source_platform ILIKE '%github%' OR {JS('artifact_type')} ILIKE '%agent%' OR {JS('artifact_type')} ILIKE '%skill%' OR category_primary ILIKE '%devtool%', false) AS tool,
  coalesce({JS('facet_type')} = 'NEWS' OR item_type = 'NEWS' OR {JS('ai_enrichment.type_classification')} = 'NEWS' OR (({JS('facet_type')} IS NULL OR {JS('facet_type')} != 'MODEL') AND {NO_FAMILY} AND source_platform NOT ILIKE '%github%' AND source_platform NOT ILIKE '%space%'), false) AS news
FROM inbox WHERE triage_status IS NULL OR triage_status != 'archived'
""")
def inbox_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facets every item that isn't archived belongs to."""
    facets = [ib.facet(n, P("payload"), P(PLAT), P(CAT), P("item_type")).alias(n.lower()) for n in ("MODEL", "TOOL", "NEWS")]
    return inbox(spark, sf_dir).where(search.not_archived(P("triage_status"))).select("id", *facets)


@query(f"""
WITH {INBOX} SELECT id, source_platform, (json_extract(payload, '$.ai_enrichment') IS NULL OR NOT is_classified OR {JS('ai_enrichment.enriched_at')} IS NULL) AS pending FROM inbox WHERE source_platform ILIKE '%hac_er%' OR source_platform ILIKE '%face%'
""")
def inbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of some sources that wait for enrichment or audit."""
    i = inbox(spark, sf_dir).where(ib.source_matches(P(PLAT), "hac_er") | ib.source_matches(P(PLAT), "face"))
    return i.select("id", PLAT, ib.pending(P("payload"), P("is_classified")).alias("pending"))


NUM = "try_cast(nullif(json_extract_string(payload, '$.{}'), '') AS DOUBLE)".format
LIVE = f"coalesce(live_spike_score, {NUM('spike_analysis.score')}, viral_score, 0)"
GROWTH = f"CASE WHEN regexp_full_match({JS('metric_tracking.delta')}, '[0-9]+') THEN CAST({JS('metric_tracking.delta')} AS DOUBLE) ELSE 0 END"
SORTS = {
    "created": ("true", "created_at DESC NULLS LAST, id DESC"),
    "pending": (f"(NOT is_classified OR {JS('ai_enrichment.enriched_at')} IS NULL)", "created_at DESC NULLS LAST, id DESC"),
    "viral-score-desc": ("true", f"{LIVE} DESC, coalesce(json_array_length(payload, '$.sources'), 0) DESC, created_at DESC, id DESC"),
    "growth-delta-desc": ("true", f"{GROWTH} DESC, created_at DESC, id DESC"),
    "date-source-desc": ("true", "harvested_date DESC NULLS LAST, created_at DESC, id DESC"),
    "date-source-asc": ("true", "harvested_date ASC NULLS LAST, created_at ASC, id ASC"),
    "id": ("true", "id DESC"),
    "date-audit-desc": ("is_classified", "updated_at DESC NULLS LAST, id DESC"),
    "date-audit-asc": ("is_classified", "updated_at ASC NULLS LAST, id ASC"),
    "updated": ("true", "updated_at DESC NULLS LAST, id DESC"),
}


def _sorted(mode: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = inbox(spark, sf_dir).where(search.not_archived(P("triage_status")))
        if mode == "pending":
            i = i.where(ib.pending(P("payload"), P("is_classified")))
        elif mode.startswith("date-audit"):
            i = i.where("is_classified")
        orders = ib.sort_orders(P("payload"))[mode]
        page = i.orderBy(*orders).limit(60)
        return page.withColumn("place", F.row_number().over(Window.orderBy(*orders)).cast("long")).select("place", "id")  # of sixty rows

    run.__doc__ = f"The first sixty items in the order {mode}."
    return run


for _mode, (_where, _order) in SORTS.items():
    _name = f"inbox_sort_{_mode.replace('-', '_')}"
    QUERIES[_name] = _sorted(_mode)
    ORACLE[_name] = f"WITH {INBOX} SELECT row_number() OVER (ORDER BY {_order}) AS place, id FROM inbox WHERE (triage_status IS NULL OR triage_status != 'archived') AND {_where} ORDER BY {_order} LIMIT 60"


@query(f"""
WITH {INBOX}, {RANKS} SELECT row_number() OVER (ORDER BY rank_position ASC NULLS LAST, coalesce(peak_spike_score, live_spike_score, 0) DESC, id DESC) AS place, id, CAST(rank_position AS INT) AS daily_rank
FROM inbox LEFT JOIN ranks ON item_id = id ORDER BY place LIMIT 80
""")
def inbox_sort_spike_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rank of one day's snapshot, looked up by a left join, then by peak score."""
    i = inbox(spark, sf_dir)
    ranked = i.join(ranks(i), F.col("id") == F.col("item_id"), "left")
    orders = ib.sort_orders(P("payload"), P("rank_position"))["spike-date"]
    page = ranked.orderBy(*orders).limit(80)
    return page.select(F.row_number().over(Window.orderBy(*orders)).cast("long").alias("place"), "id", F.col("rank_position").alias("daily_rank"))  # of eighty rows


#: What a list reads of a payload.
LEAN = ", ".join(f"{n} string" for n in ("title_ko", "hook", "hook_ko", "description", "tier1_category", "tier2_category", "facet_type", "is_model", "is_cross_spiking", "model_family", "artifact_type", "published_at", "canonical_story_key"))
LEAN += f", ai_enrichment struct<source_lang:string>, spike_analysis struct<score:string, peak_score:string>, sources {pl.SOURCES.simpleString()}"
COMM = "(" + " OR ".join(f"contains(x.p, '{w}') OR contains(x.u, '{w}')" for w in ib.COMMUNITY_WORDS) + ")"
LANG = f"""CASE WHEN upper({JS('ai_enrichment.source_lang')}) IN ('KO', 'EN', 'ZH', 'JA') THEN upper({JS('ai_enrichment.source_lang')})
  WHEN regexp_matches(title, '[가-힣]') OR regexp_matches(coalesce(source_platform, ''), 'daum|geeknews|hada\\.io|chosun|donga|yonhap|naver', 'i') OR regexp_matches(source_url, 'daum\\.net|hada\\.io|naver\\.com', 'i') THEN 'KO'
  WHEN regexp_matches(title, '[ぁ-ヿ]') THEN 'JA' WHEN regexp_matches(title, '[一-鿿]') OR regexp_matches(coalesce(source_platform, ''), 'weibo|zhihu|36kr|v2ex|oschina|infoq', 'i') OR regexp_matches(source_url, '\\.cn|36kr\\.com|v2ex\\.com', 'i') THEN 'ZH' ELSE 'EN' END"""


@query(f"""
WITH {INBOX}, {RANKS},
s AS (SELECT id, unnest(from_json(json_extract(payload, '$.sources'), '[{{"platform":"VARCHAR","url":"VARCHAR","created_at":"VARCHAR"}}]')) AS src FROM inbox),
x AS (SELECT id, lower(src.platform) AS p, lower(src.url) AS u FROM s UNION ALL SELECT id, lower(source_platform), lower(source_url) FROM inbox i WHERE source_platform IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = i.id AND s.src.url = i.source_url)),
c AS (SELECT id, count(*) AS n_all, count(DISTINCT (p, u)) AS n_keys, count(DISTINCT (p, u)) FILTER ({COMM}) AS community FROM x GROUP BY id),
t AS (SELECT id, min(try_cast(src.created_at AS TIMESTAMP)) AS seen FROM s GROUP BY id),
d AS (SELECT i.*, coalesce(c.community, 0) AS community_count, coalesce(c.n_keys, 0) - coalesce(c.community, 0) AS press_count, greatest(coalesce(c.n_keys, 0), coalesce(c.n_all, 0)) AS total_count, least(i.created_at, t.seen) AS harvest, try_cast({JS('published_at')} AS TIMESTAMP) AS pub, r.rank_position
      FROM inbox i LEFT JOIN c USING (id) LEFT JOIN t USING (id) LEFT JOIN ranks r ON r.item_id = i.id)
SELECT id, inbox_id, source_platform, source_url, CASE WHEN contains(source_url, 'news.ycombinator.com') THEN source_url END AS hn_url, title, title AS title_ko, coalesce({JS('hook')}, '') AS hook, coalesce({JS('hook')}, '') AS hook_ko,
  trim(regexp_replace(regexp_replace(coalesce({JS('description')}, ''), '^HN\\s*Score:\\s*\\d+\\s*pts\\s*(\\|\\s*Comments:\\s*\\d+\\s*)?(\\|\\s*)?', '', 'i'), '^Abstract:\\s*', '', 'i')) AS description,
  item_type, {LANG} AS source_lang, category_primary, coalesce(nullif({JS('tier1_category')}, ''), 'TECH_COMPUTING') AS tier1_category, coalesce(nullif({JS('tier2_category')}, ''), category_primary, 'INDUSTRY_TRENDS') AS tier2_category, coalesce(nullif({JS('facet_type')}, ''), 'NEWS') AS facet_type,
  coalesce({JS('is_model')} = 'true', {JS('facet_type')} = 'MODEL', false) AS is_model, coalesce({JS('model_family')}, '') AS model_family, coalesce({JS('artifact_type')}, '') AS artifact_type, CAST(total_count AS BIGINT) AS total_count, CAST(press_count AS BIGINT) AS press_count, CAST(community_count AS BIGINT) AS community_count,
  (rank_position IS NOT NULL OR coalesce({JS('is_cross_spiking')} = 'true', false) OR (press_count >= 1 AND community_count >= 1 AND total_count >= 2)) AS is_cross_spiking, coalesce(live_spike_score, {NUM('spike_analysis.score')}, 0) AS live_spike_score, coalesce(peak_spike_score, 0) AS peak_spike_score, CAST(rank_position AS INT) AS daily_spike_rank,
  viral_score, is_classified, harvested_date, CAST(greatest(harvest, pub) AS TIMESTAMP) AS earliest_harvested_at, coalesce(pub, created_at) AS published_at, created_at, updated_at, coalesce({JS('canonical_story_key')}, '') AS canonical_story_key
FROM d
""")
def inbox_lean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list shows of every item: fields with their fallbacks, counts over nested sources, the clamped earliest times."""
    i = inbox(spark, sf_dir)
    read = i.withColumn("j", F.from_json("payload", LEAN)).drop("payload")  # once a row; all below reads its fields
    ranked = read.join(ranks(i), F.col("id") == F.col("item_id"), "left")
    p = pl.Parsed(P("j"))
    text = lambda at, otherwise: F.coalesce(pl.path(p, at), otherwise if not isinstance(otherwise, str) else F.lit(otherwise))
    ranked = ranked.withColumn("s", ib.with_own_source(p, P(PLAT), P("source_url"))).withColumn("keys", F.array_distinct("s"))
    community = F.size(F.filter("keys", ib.is_community)).cast("long")
    seen = ib.earliest([P("created_at")], F.transform(F.coalesce(pl.sources(p), F.array().cast(pl.SOURCES)), lambda x: x["created_at"]))
    published = pl.get(p, "published_at").try_cast("timestamp_ntz")
    total, press = F.greatest(F.size("s"), F.size("keys")).cast("long"), F.size("keys").cast("long") - community
    flag = lambda at: pl.get(p, at) == "true"
    crossing = P("rank_position").isNotNull() | F.coalesce(flag("is_cross_spiking"), F.lit(False)) | ((press >= 1) & (community >= 1) & (total >= 2))
    return ranked.select(
        "id", "inbox_id", PLAT, "source_url", F.when(P("source_url").contains("news.ycombinator.com"), P("source_url")).alias("hn_url"), "title", text("title_ko", P("title")).alias("title_ko"), text("hook", "").alias("hook"), F.coalesce(pl.path(p, "hook_ko", "hook"), F.lit("")).alias("hook_ko"),
        ib.plain_description(pl.get(p, "description")).alias("description"), "item_type", ib.source_language(p, P("title"), P(PLAT), P("source_url")).alias("source_lang"), CAT, text("tier1_category", "TECH_COMPUTING").alias("tier1_category"), F.coalesce(pl.path(p, "tier2_category"), P(CAT), F.lit("INDUSTRY_TRENDS")).alias("tier2_category"), text("facet_type", "NEWS").alias("facet_type"),
        F.coalesce(flag("is_model"), pl.get(p, "facet_type") == "MODEL", F.lit(False)).alias("is_model"), text("model_family", "").alias("model_family"), text("artifact_type", "").alias("artifact_type"), total.alias("total_count"), press.alias("press_count"), community.alias("community_count"), crossing.alias("is_cross_spiking"),
        F.coalesce("live_spike_score", ib.number_of(p, "spike_analysis.score"), F.lit(0.0)).alias("live_spike_score"), F.coalesce("peak_spike_score", ib.number_of(p, "spike_analysis.peak_score"), F.lit(0.0)).alias("peak_spike_score"), F.col("rank_position").alias("daily_spike_rank"), "viral_score", "is_classified", "harvested_date",
        F.greatest(seen, published).alias("earliest_harvested_at"), F.coalesce(published, P("created_at")).alias("published_at"), "created_at", "updated_at", text("canonical_story_key", "").alias("canonical_story_key"),
    )


GITHUB = "contains(lower(coalesce(source_platform, '')), 'github')"
MODELISH = f"(coalesce({JS('is_model')} = 'true', false) OR coalesce({JS('facet_type')} = 'MODEL', false))"


@query(f"""
WITH {INBOX} SELECT id, coalesce({JS('is_cross_spiking')} = 'true', false) OR json_array_length(payload, '$.sources') > 1 AS spiking, {MODELISH} AS model,
  coalesce({JS('facet_type')} = 'TOOL', false) OR {GITHUB} OR contains(coalesce({JS('artifact_type')}, ''), 'agent') OR contains(coalesce({JS('artifact_type')}, ''), 'skill') OR contains(lower(coalesce(category_primary, '')), 'devtool') AS tool, NOT ({MODELISH} OR {GITHUB}) AS news,
  contains(lower(coalesce(source_platform, '')), 'reddit') OR coalesce(contains(lower({JS('cross_posts')}), 'reddit'), false) AS from_reddit,
  contains(lower(title), 'agent') OR contains(lower(coalesce({JS('hook')}, '')), 'agent') AS found
FROM inbox
""")
def news_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news list's own facets, source and search filters, for every item."""
    p = P("payload")
    facets = {n: ib.news_view(k, p, P(PLAT), P(CAT)) for n, k in (("spiking", "CROSS_SPIKE"), ("model", "MODEL"), ("tool", "TOOL"), ("news", "NEWS"))}
    found = search.matches_tokens("agent", [P("title"), F.get_json_object(p, "$.hook")])
    return inbox(spark, sf_dir).select("id", *[c.alias(n) for n, c in facets.items()], ib.any_source(p, P(PLAT), "Reddit").alias("from_reddit"), found.alias("found"))


@query(f"""
WITH {INBOX}, m AS (SELECT *, lower(coalesce({JS('model_family')}, '')) AS fam, lower(inbox_id || ' ' || title || ' ' || coalesce({JS('description')}, '') || ' ' || coalesce({JS('model_family')}, '') || ' ' || coalesce({JS('artifact_type')}, '')) AS txt FROM inbox)
SELECT id, contains(fam, 'standalone') OR fam = '' AS standalone, contains(fam, 'audio') OR contains(fam, 'speech') OR contains(fam, 'tts') OR contains(fam, 'whisper') AS audio, contains(fam, 'qwen') AND lower(coalesce({JS('task_modality')}, '')) = 'text' AS qwen_text,
  coalesce({JS('artifact_type')}, 'WEIGHTS') = 'WEIGHTS' AS weights, contains(txt, 'body qwen') OR (contains(txt, 'body') AND contains(txt, 'qwen')) AS found FROM m
""")
def models_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model list's filters, for every item."""
    p = P("payload")
    family, modality, artifact = (F.get_json_object(p, f"$.{k}") for k in ("model_family", "task_modality", "artifact_type"))
    text = F.concat_ws(" ", "inbox_id", "title", F.get_json_object(p, "$.description"), family, artifact)
    view = lambda **k: ib.model_view(family, modality, artifact, text, **k)
    return inbox(spark, sf_dir).select("id", view(wanted_family="Standalone").alias("standalone"), view(wanted_family="Audio / Speech").alias("audio"), view(wanted_family="Qwen", wanted_modality="TEXT").alias("qwen_text"), view(wanted_artifact="WEIGHTS").alias("weights"), view(search=" Body qwen ").alias("found"))


def _has(c: str, words: list[str]) -> str:
    return "(" + (" OR ".join(f"contains({c}, '{w}')" for w in words) or "false") + ")"


@query(f"""
WITH c AS (SELECT p_partkey AS id, lower(p_type) AS cat, lower(p_brand) AS clus, lower(p_name || ' ' || p_brand || ' ' || p_type) AS txt FROM (SELECT p_partkey, p_name, {"CASE p_partkey % 9 WHEN 0 THEN 'Design' WHEN 1 THEN 'Agent tools' WHEN 2 THEN 'Browser' WHEN 3 THEN 'OCR' WHEN 4 THEN 'Graphics' WHEN 5 THEN 'Rust' ELSE 'Misc' END"} AS p_type, {"CASE p_partkey % 8 WHEN 0 THEN 'media-kit' WHEN 1 THEN 'doc-set' WHEN 2 THEN '3d' WHEN 3 THEN 'three' ELSE 'none' END"} AS p_brand FROM part))
SELECT id, CAST({' + '.join(f"CASE WHEN {_has('cat', a)} OR {_has('clus', b)} OR {_has('txt', t)} THEN {1 << k} ELSE 0 END" for k, (a, b, t) in enumerate(ib.DOMAIN_WORDS.values()))} + CASE WHEN NOT ({_has('cat', ib.STANDARD_WORDS)} OR contains(txt, 'rust')) THEN 64 ELSE 0 END AS BIGINT) AS domains FROM c
""")
def portfolio_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the seven domains each case belongs to, as bits in their order, `other` last."""
    cases = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "CASE p_partkey % 9 WHEN 0 THEN 'Design' WHEN 1 THEN 'Agent tools' WHEN 2 THEN 'Browser' WHEN 3 THEN 'OCR' WHEN 4 THEN 'Graphics' WHEN 5 THEN 'Rust' ELSE 'Misc' END AS category", "CASE p_partkey % 8 WHEN 0 THEN 'media-kit' WHEN 1 THEN 'doc-set' WHEN 2 THEN '3d' WHEN 3 THEN 'three' ELSE 'none' END AS cluster")
    text = F.concat_ws(" ", "title", "cluster", "category")
    bits = [F.when(ib.portfolio_domain(d, P("category"), P("cluster"), text), 1 << k).otherwise(0) for k, d in enumerate([*ib.DOMAIN_WORDS, "other"])]
    return cases.select("id", sum(bits[1:], bits[0]).cast("long").alias("domains"))


@query(f"""
WITH {INBOX}, w AS (SELECT id, {LANG} AS lang, coalesce({JS('ai_enrichment.type_classification')}, 'TECH') AS kind, lower(coalesce({JS('ai_enrichment.programming_lang')}, 'General')) AS tech, is_classified AND {JS('ai_enrichment.enriched_at')} IS NOT NULL AS audited, contains(lower(title), 'model') OR contains(lower(coalesce({JS('description')}, '')), 'body') AS found FROM inbox)
SELECT id FROM w WHERE (lang = 'ZH' AND kind = 'TECH' AND contains(tech, 'rust') AND audited) OR (lang = 'EN' AND kind = 'NEWS' AND found AND audited)
""")
def inbox_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections of the inbox list: language, type, technique, search, and only audited items."""
    p = P("payload")
    lang, kind = ib.source_language(p, P("title"), P(PLAT), P("source_url")), F.coalesce(pl.path(p, "ai_enrichment.type_classification"), F.lit("TECH"))
    tech, audited = F.lower(F.coalesce(pl.path(p, "ai_enrichment.programming_lang"), F.lit("General"))), ~ib.pending(p, P("is_classified"))
    found = P("title").contains("model") | F.lower(F.concat_ws(" ", "title", F.get_json_object(p, "$.description"))).rlike("model|body")
    one, two = (lang == "ZH") & (kind == "TECH") & tech.contains("rust"), (lang == "EN") & (kind == "NEWS") & found
    return inbox(spark, sf_dir).where((one | two) & audited).select("id")


@query(f"""
WITH {INBOX} SELECT row_number() OVER (ORDER BY f DESC, id DESC) AS place, id, f AS freshest, m AS freshest_ms FROM (
  SELECT id, greatest(coalesce({JS('ai_enrichment.enriched_at')}, ''), coalesce({JS('published_at')}, ''), coalesce(CAST(harvested_date AS VARCHAR), '')) AS f,
    greatest(coalesce(epoch_ms(try_cast({JS('ai_enrichment.enriched_at')} AS TIMESTAMP)), 0), coalesce(epoch_ms(try_cast({JS('published_at')} AS TIMESTAMP)), 0), coalesce(epoch_ms(CAST(harvested_date AS TIMESTAMP)), 0)) AS m FROM inbox) ORDER BY f DESC, id DESC LIMIT 60
""")
def freshest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the freshest of several timestamps as text; and the same as parsed dates in milliseconds."""
    times = [F.get_json_object("payload", "$.ai_enrichment.enriched_at"), F.get_json_object("payload", "$.published_at"), P("harvested_date").cast("string")]
    i = inbox(spark, sf_dir).select("id", ib.freshest_text(*times).alias("freshest"), ib.freshest_millis(*times).alias("freshest_ms"))
    orders = [F.desc("freshest"), F.desc("id")]
    return i.orderBy(*orders).limit(60).withColumn("place", F.row_number().over(Window.orderBy(*orders)).cast("long"))  # of sixty rows


@query(f"""
WITH {INBOX}, s AS (SELECT id, source_platform, unnest(from_json(json_extract(payload, '$.sources'), '[{{"platform":"VARCHAR"}}]')).platform AS sp, generate_subscripts(from_json(json_extract(payload, '$.sources'), '[{{"platform":"VARCHAR"}}]'), 1) AS k FROM inbox),
n AS (SELECT id, coalesce(source_platform, 'Tech News') AS name, 0 AS k FROM inbox UNION ALL SELECT id, coalesce(sp, ''), k FROM s),
w AS (SELECT id, name, k, CASE WHEN name ILIKE '%github%' THEN 100 WHEN name ILIKE '%space%' THEN 96 WHEN name ILIKE '%hugging%' OR name ILIKE '%hf%' THEN 95 WHEN name ILIKE '%arxiv%' THEN 90 WHEN name ILIKE '%hacker news%' THEN 85 WHEN name ILIKE '%pytorch%' THEN 80 WHEN name ILIKE '%geeknews%' THEN 75 WHEN name ILIKE '%reddit%' THEN 60 ELSE 50 END AS weight FROM n),
b AS (SELECT id, arg_max(name, [weight, -k]) AS name, max(weight) AS weight FROM w GROUP BY id)
SELECT id, CAST(weight AS INT) AS weight, CASE WHEN name = 'YouTube (Chan)' THEN 'Chan' WHEN name = 'Press (Reuters)' THEN 'Reuters' WHEN name = 'Hacker News' THEN 'HN' WHEN name LIKE 'Reddit%' THEN 'Reddit' ELSE name END AS shown FROM b
""")
def shown_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform of most weight among an item's own and its sources, by its short name."""
    own = F.coalesce(P(PLAT), F.lit("Tech News"))
    nested = F.coalesce(F.transform(pl.sources(P("payload")), lambda s: ib.platform_weight(F.coalesce(s["platform"], F.lit("")))), F.array().cast("array<int>"))
    return inbox(spark, sf_dir).select("id", F.array_max(F.concat(F.array(ib.platform_weight(own)), nested)).alias("weight"), ib.primary_platform(P(PLAT), P("payload")).alias("shown"))


@query(f"""
WITH {INBOX} SELECT hour(t) // 6 AS slot, count(*) AS enriched, count(*) FILTER (WHERE CAST(t AS DATE) = DATE '2024-01-19') AS one_day FROM (SELECT try_cast(nullif({JS('ai_enrichment.enriched_at')}, '') AS TIMESTAMP) AS t FROM inbox) WHERE t IS NOT NULL GROUP BY 1
""")
def enriched_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichments by six-hour slot of the timestamp inside the JSON; what doesn't parse isn't counted."""
    t = inbox(spark, sf_dir).select(pl.path(P("payload"), "ai_enrichment.enriched_at").try_cast("timestamp_ntz").alias("t")).where("t is not null")
    return t.groupBy(F.floor(F.hour("t") / 6).alias("slot")).agg(F.count("*").alias("enriched"), F.count_if(F.to_date("t") == F.lit("2024-01-19").cast("date")).alias("one_day"))


@query(f"""
WITH {INBOX} SELECT id, CASE WHEN payload LIKE '%"is_model":true%' OR source_platform ILIKE '%model%' THEN 'MODEL' WHEN source_platform ILIKE '%github%' THEN 'TOOL' ELSE 'NEWS' END AS facet, live_spike_score IS NULL AND peak_spike_score IS NULL AS unscored FROM inbox WHERE payload LIKE '%"score":"7"%' OR category_primary IS NULL
""")
def json_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a piece of their JSON text or a missing category, with the facet that they are given."""
    p = P("payload")
    i = inbox(spark, sf_dir).where(p.contains('"score":"7"') | P(CAT).isNull())
    model = p.contains('"is_model":true') | F.coalesce(P(PLAT).ilike("%model%"), F.lit(False))
    return i.select("id", ib.facet_of(model, P(PLAT)).alias("facet"), (P("live_spike_score").isNull() & P("peak_spike_score").isNull()).alias("unscored"))


@query(f"""
WITH {INBOX}, q AS (SELECT *, CASE id % 4 WHEN 0 THEN 'QUEUED_FOR_INVESTIGATION' WHEN 1 THEN 'REQUESTED_ANALYSIS' WHEN 2 THEN 'PENDING_REVIEW' END AS status FROM inbox)
SELECT id, status AS was, CASE WHEN status = 'QUEUED_FOR_INVESTIGATION' THEN 'PENDING_REVIEW' ELSE 'QUEUED_FOR_INVESTIGATION' END AS status FROM q WHERE status IN ('QUEUED_FOR_INVESTIGATION', 'PENDING_REVIEW')
""")
def queue_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two queues change place; the others aren't touched."""
    status = F.when(P("id") % 4 == 0, "QUEUED_FOR_INVESTIGATION").when(P("id") % 4 == 1, "REQUESTED_ANALYSIS").when(P("id") % 4 == 2, "PENDING_REVIEW")
    q = inbox(spark, sf_dir).withColumn("was", status).where(F.col("was").isin("QUEUED_FOR_INVESTIGATION", "PENDING_REVIEW"))
    return q.select("id", "was", F.when(F.col("was") == "QUEUED_FOR_INVESTIGATION", "PENDING_REVIEW").otherwise("QUEUED_FOR_INVESTIGATION").alias("status"))


@query(f"""
WITH {INBOX}, {RANKS} SELECT id, CASE WHEN rank_position IS NOT NULL THEN 'DAILY_HOT' WHEN id % 6 = 0 THEN 'ARCHIVED_HOT' ELSE triage_status END AS status, CAST(rank_position AS INT) AS rank_position FROM inbox LEFT JOIN ranks ON item_id = id
""")
def hot_reflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yesterday's hot items are archived, today's get their flag and rank."""
    i = inbox(spark, sf_dir)
    was = F.when(P("id") % 6 == 0, "DAILY_HOT").otherwise(P("triage_status"))
    status = F.when(P("rank_position").isNotNull(), "DAILY_HOT").when(was == "DAILY_HOT", "ARCHIVED_HOT").otherwise(was)
    return i.join(ranks(i), F.col("id") == F.col("item_id"), "left").select("id", status.alias("status"), "rank_position")


@query(f"""
WITH {INBOX}, {RANKS} SELECT place, id, spiking FROM (SELECT row_number() OVER (ORDER BY rank_position IS NULL, created_at DESC, id DESC) AS place, id, rank_position IS NOT NULL AS spiking FROM inbox LEFT JOIN ranks ON item_id = id) WHERE place <= 4
""")
def home_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four items for the front page: spiking ones first, else the newest."""
    i = inbox(spark, sf_dir)
    orders = [F.desc("spiking"), F.desc("created_at"), F.desc("id")]
    top = i.join(ranks(i), F.col("id") == F.col("item_id"), "left").withColumn("spiking", P("rank_position").isNotNull()).orderBy(*orders).limit(4)
    return top.select(F.row_number().over(Window.orderBy(*orders)).cast("long").alias("place"), "id", "spiking")  # of four rows
