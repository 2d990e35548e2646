"""The rule tables over titles that reach every branch; the SQL evaluates the same fixed patterns with another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import categories as ct
from ..functions import classify, rules, scoring, text
from ..operators import similarity
from ..registry import ORACLE, query
from ..sources.tables import table

TITLES = [
    "Police shooting: suspect arrested", "대통령 소송 비용 판결", "Ancient recipe: Babylonian stew with beets", "NASA rocket reaches orbit", "Space launch with satellite payload", "Central bank gold reserve grows", "Gold bullion moves", "Qwen 2.5 GGUF weights", "KV cache quantization in vLLM",
    "Stable diffusion video model", "Speech AI demo", "Browser use agents framework", "RAG benchmark evaluation", "Linux security patch for zero-day", "Llama 3.1 instruct safetensors", "DeepSeek R1 release demo", "Show HN: A repo for crawling", "Why history repeats", "Plain note", "arXiv paper on quantum physics",
    "News: Houthis seize islands in the Red Sea", "Houthi control of island shipping", "Hacker News: Sam Altman on bad things and benefits", "GitHub: praxist SWE-agent harness", "Claude Code tips", "Gemini Argon is out", "제미나이 4 아르곤 공개", "GPT-6.1 Sol arrives", "GPT-6 Astra preview", "Claude Opus 5.5 launches",
    "Mac Studio with M5 Ultra", "DeepSeek V3.2 exp", "OpenAI dots agent", "Meta Muse personal agent", "F-Droid 2.0", "Copilot+ PC is dead", "Pi 1.0 durable", "Raspberry Pi 1.0", "Kolibri sovereign model", "Altman: accept some risks", "Grok 4.2 update", "GPT-4 news today",
    "Unsloth Dynamic GGUF of Qwen3.8 27B", "mlx build of gemma", "FP8 AWQ weights by mistralai", "uncensored qwen38-flash", "GLM 5.3 official base", "qwen2.5-coder 7b", "Wan 2.2 video gradio space", "FLUX.1 lora adapter", "Whisper tts kit", "Firecrawl sdk cli", "SGLang and TensorRT serving", "beats GPT-4o: 100x faster open source",
    "passive income with a tiktok bot", "open source under a business license", "Stock market fund revenue", "Court law trial", "Flock veteran traffic stop", "Anthropic supply chain", "OpenAI agent breached federal websites", "Google bots interact with agency portals", "Hugging Face space for Rust", "r/LocalLLaMA: Tesla and NVIDIA tools", "Beats GPT-4o: passive income, 100x faster",
]
PLATFORMS = ["Hacker News", "GitHub Official", "Hugging Face Models", "HF Spaces", "Reddit r/LocalLLaMA", "arXiv Papers", "Press (Reuters)", "Model Hub", "YouTube (Chan)"]


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _nth(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values)) + " END"


N = len(TITLES)
COLUMNS = {"id": "event_id", "title": _nth(f"event_id % {N}", TITLES), "other": _nth(f"CAST(floor(event_id / {N}) AS BIGINT) % {N}", TITLES), "platform": _nth(f"CAST(floor(event_id / 7) AS BIGINT) % {len(PLATFORMS)}", PLATFORMS), "ts": "ts", "value": "value"}
HEADLINES = "headlines AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM events), low AS (SELECT *, lower(title) AS t, lower(platform) AS p, regexp_replace(title, '[_/:]', ' ', 'g') AS plain FROM headlines)"


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles are joined from their list, so that rules read a column and not the expression that makes it."""
    listed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, TITLES))))
    numbered = lambda key, name: F.broadcast(listed.select(F.col("pos").cast("long").alias(key), F.col("col").alias(name)))  # noqa: E731  # as many rows as titles
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS id", f"event_id % {N} AS k", f"CAST(floor(event_id / {N}) AS BIGINT) % {N} AS o", f"{COLUMNS['platform']} AS platform", "ts", "value")
    return rows.join(numbered("k", "title"), "k").join(numbered("o", "other"), "o").select("id", "title", "other", "platform", "ts", "value")


# -- the same rules as SQL


def _case(found: list[tuple[str, str]], otherwise: str | None) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_quoted(v)}" for c, v in found) + (f" ELSE {_quoted(otherwise)}" if otherwise is not None else "") + " END"


def _match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted(pattern)})"


def _holds(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")"


def _enrich_sql() -> str:
    found = []
    for name, words, pairs in ct.ENRICH_WORDS:
        hit = [_match("t", ct.whole_words(words))] + [f"({_match('t', ct.whole_words(a))} AND {_match('t', ct.whole_words(b))})" for a, b in pairs]
        if name == "FOUNDATION_MODELS":
            hit += ["contains(p, 'models')", "contains(p, 'hub')"]
        found.append((" OR ".join(hit), name))
    return _case(found, "INDUSTRY_TRENDS")


WORKER_SQL = _case([*[(_match("t", p), n) for p, n in rules.CATEGORY_RULES], ("contains(p, 'models')", "FOUNDATION_MODELS")], "INDUSTRY_TRENDS")
BATCH_WORDS = [(n, w + ct.BATCH_MORE.get(n, [])) for n, w in ct.REPEAT_WORDS]
_words_sql = lambda table_: _case([(_holds("t", w), n) for n, w in table_], "INDUSTRY_TRENDS")


@query(f"WITH {HEADLINES} SELECT id, {_enrich_sql()} AS enrich, {WORKER_SQL} AS worker, {_words_sql(ct.BULK_WORDS)} AS bulk, {_words_sql(ct.REPEAT_WORDS)} AS repeat, {_words_sql(BATCH_WORDS)} AS batch FROM low")
def category_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary category of each title by the five rule sets; a title that comes again is judged once."""
    t, p = F.lower("title"), F.lower("platform")
    h = headlines(spark, sf_dir)
    judged = h.groupBy("title", "platform").agg(F.count("*")).select("title", "platform", ct.enrich_category(t, p, F.lit("TECH")).alias("enrich"), rules.category(t, p).alias("worker"), ct.words_category(t, ct.BULK_WORDS).alias("bulk"), ct.words_category(t, ct.REPEAT_WORDS).alias("repeat"), ct.words_category(t, ct.REPEAT_WORDS, ct.BATCH_MORE).alias("batch"))
    return h.select("id", "title", "platform").join(judged, ["title", "platform"]).drop("title", "platform")


@query(f"WITH low AS (SELECT doc_id AS id, lower(text) AS t, lower(source) AS p FROM documents) SELECT id AS doc_id, {_enrich_sql()} AS enrich, {WORKER_SQL} AS worker, {_words_sql(ct.BULK_WORDS)} AS bulk, {_words_sql(ct.REPEAT_WORDS)} AS repeat FROM low")
def document_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule sets of categories over the whole texts of all documents."""
    t, p = F.lower("text"), F.lower("source")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", ct.enrich_category(t, p, F.lit("TECH")).alias("enrich"), rules.category(t, p).alias("worker"), ct.words_category(t, ct.BULK_WORDS).alias("bulk"), ct.words_category(t, ct.REPEAT_WORDS).alias("repeat"))


@query(f"""
WITH low AS (SELECT page_id AS id, lower(html) AS t, lower(url) AS p FROM pages) SELECT id AS page_id, {_enrich_sql()} AS enrich, {WORKER_SQL} AS worker, {_words_sql(ct.REPEAT_WORDS)} AS repeat FROM low
""")
def page_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the markup of all pages."""
    t, p = F.lower("html"), F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", ct.enrich_category(t, p, F.lit("TECH")).alias("enrich"), rules.category(t, p).alias("worker"), ct.words_category(t, ct.REPEAT_WORDS).alias("repeat"))


@query(f"""
WITH {HEADLINES}, c AS (SELECT *, {WORKER_SQL} AS category FROM low)
SELECT category, {_case([(f"category = 'CIVIC_CRIME_INCIDENT' OR {_match('t', rules.LAW_WORDS)}", 'LAW_CRIME_JUSTICE'), *[(f"category = '{c}'", t) for c, t in rules.TIER_OF_CATEGORY.items()]], 'TECH_COMPUTING')} AS tier, count(*) AS n FROM c GROUP BY 1, 2
""")
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by primary category and domain."""
    t, p = F.lower("title"), F.lower("platform")
    c = headlines(spark, sf_dir).select(rules.category(t, p).alias("category"), t.alias("t"))
    return c.groupBy("category", rules.tier_one(F.col("t"), F.col("category")).alias("tier")).agg(F.count("*").alias("n"))


ARTIFACT_SQL = _case([("contains(p, 'spaces') OR regexp_matches(t, 'spaces|gradio')", "WEB_SERVICE"), ("regexp_matches(t, 'agent|harness|cli|sdk|framework|devtools') OR contains(p, 'github')", "SKILL_AGENT"), ("regexp_matches(t, 'lora|adapter|finetune|fine-tuning')", "FINETUNE"), ("regexp_matches(t, 'gguf|safetensors|fp8|weights') OR contains(p, 'models')", "WEIGHTS")], "ARTICLE")
BULK_TYPE_SQL = _case([(f"contains(p, 'model') OR contains(p, 'huggingface') OR {_holds('t', ['weights', 'checkpoint', 'gguf'])}", "MODEL"), (_holds("t", ["agent", "autonomous"]), "AGENT"), (_holds("p", ct.BULK_PRESS), "NEWS")], "TECH")


@query(f"""
WITH {HEADLINES}, c AS (SELECT *, {WORKER_SQL} AS category, {_words_sql(ct.REPEAT_WORDS)} AS repeat, {ARTIFACT_SQL} AS artifact, {BULK_TYPE_SQL} AS bulk_type FROM low)
SELECT id, artifact, bulk_type,
  {_case([("bulk_type = 'MODEL'", 'WEIGHTS'), ("contains(p, 'github') OR " + _holds('t', ['repo', 'github.com', 'repository']), 'CODE_REPO'), ("contains(p, 'arxiv') OR contains(t, 'paper')", 'PAPER')], 'ARTICLE')} AS bulk_artifact,
  {_case([("contains(p, 'spaces') OR " + _holds('t', ['space:', 'gradio']), 'WEB_SERVICE'), (_holds('t', ['agent', 'harness', 'cli', 'sdk', 'browser-use', 'framework']) + " OR contains(p, 'agent')", 'SKILL_AGENT'), (_holds('t', ['lora', 'adapter', 'finetune', 'fine-tuned', 'fine-tuning']), 'FINETUNE'), ("contains(p, 'models') OR contains(t, 'weights')", 'WEIGHTS')], 'ARTICLE')} AS enrich_artifact,
  {_case([(f"category = 'CIVIC_CRIME_INCIDENT' OR {_match('t', rules.LAW_WORDS)} OR {_match('t', rules.NEWS_WORDS)}", 'NEWS'), ("artifact = 'WEIGHTS' OR regexp_matches(t, 'gguf|lora|safetensors|checkpoint|weights|7b|14b|70b|32b') OR contains(p, 'models')", 'MODEL'), ("artifact = 'SKILL_AGENT' OR regexp_matches(t, 'agent|crawler|scraper|devtools|copilot')", 'AGENT')], 'TECH')} AS item_type,
  {_case([("repeat = 'AGENTS_DEVTOOLS' AND contains(t, 'agent')", 'AGENT'), ("repeat = 'AGENTS_DEVTOOLS'", 'TECH'), *[(f"repeat = '{c}'", k) for c, k in ct.REPEAT_TYPES.items()]], None)} AS words_type,
  {_case([(f"(platform IN ('Hacker News', 'Reddit r/LocalLLaMA') AND NOT {_match('title', ct.FORUM_RELEASE)}) OR {_match('title', ct.OPINION)}", 'NEWS')], 'TECH')} AS news,
  {_case([(f"contains(t, '{n}')", n.replace(' ', '')) for n in ct.KNOWN_ENTITIES], None)} AS entity
FROM c
""")
def type_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact and item types of each title by their variants, and the entity that it names."""
    t, p = F.lower("title"), F.lower("platform")
    c = headlines(spark, sf_dir).withColumns({"category": rules.category(t, p), "repeat": ct.words_category(t, ct.REPEAT_WORDS), "artifact": rules.artifact_type(t, p), "bulk_type": ct.bulk_item_type(t, p)})
    kind = rules.item_type(t, p, F.col("category"), rules.tier_one(t, F.col("category")), F.col("artifact"))
    return c.select("id", "artifact", "bulk_type", ct.bulk_artifact_type(t, p, F.col("bulk_type")).alias("bulk_artifact"), ct.enrich_artifact_type(t, p, F.lit("")).alias("enrich_artifact"), kind.alias("item_type"), ct.words_item_type(t, F.col("repeat")).alias("words_type"), ct.news_or_tech(F.col("title"), F.col("platform")).alias("news"), ct.known_entity(t).alias("entity"))


ROLE_HITS = [(_match("plain", p) + (" AND NOT regexp_matches(plain, '(?i)gguf|awq|mlx')" if role == rules.BASE_ROLE else ""), role, fmt) for p, role, fmt in rules.ROLE_RULES]
FOUND_CREATOR = f"lower(regexp_extract(plain, {_quoted(rules.CREATOR)}, 1))"


@query(f"""
WITH {HEADLINES} SELECT id, {_case([(_match('plain', p), n) for p, n in rules.FAMILY_RULES], rules.NO_FAMILY)} AS family, {_case([(c, r) for c, r, _ in ROLE_HITS], rules.STANDARD_ROLE)} AS role,
  {_case([(c, f) for c, _, f in ROLE_HITS] + [(f"contains(lower(plain), '{w}')", f) for w, f in rules.FORMAT_WORDS], rules.DEFAULT_FORMAT)} AS format,
  CASE WHEN {FOUND_CREATOR} = '' THEN 'Community' ELSE coalesce({_case([(f"{FOUND_CREATOR} = '{k}'", v) for k, v in rules.CREATORS.items()], None)}, upper(substr({FOUND_CREATOR}, 1, 1)) || substr({FOUND_CREATOR}, 2)) END AS creator
FROM low
""")
def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, role, format and creator of each title."""
    t = F.col("title")
    return headlines(spark, sf_dir).select("id", rules.model_family(t).alias("family"), rules.variant_role(t).alias("role"), rules.detected_format(t).alias("format"), rules.creator(t).alias("creator"))


CODE = f"regexp_extract(t, {_quoted(text.RELEASE)}, 3)"
DASHED = f"replace(regexp_extract(t, {_quoted(text.RELEASE)}, 2), '.', '-')"
FAMILY = f"regexp_extract(t, {_quoted(text.RELEASE)}, 1)"
RELEASE_SQL = "CASE " + " ".join("WHEN " + " AND ".join([_holds("t", g) for g in groups] + ([f"NOT {_holds('t', without)}"] if without else [])) + f" THEN {_quoted(key)}" for key, groups, without in text.RELEASES) + f""" WHEN {FAMILY} = '' THEN ''
  WHEN {CODE} != '' AND {CODE} NOT IN ({', '.join(map(_quoted, text.NOT_CODENAMES))}) THEN 'release:auto-' || {FAMILY} || '-' || {DASHED} || '-' || {CODE} WHEN contains({DASHED}, '-') THEN 'release:auto-' || {FAMILY} || '-' || {DASHED} ELSE '' END"""


@query(f"WITH {HEADLINES} SELECT id, {RELEASE_SQL} AS release_key FROM low")
def release_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The release of each title: one known by name, else what its version and code name say."""
    return headlines(spark, sf_dir).select("id", text.release_cluster_key(F.col("title")).alias("release_key"))


@query(f"""
WITH {HEADLINES}, k AS (SELECT id, platform, value, {RELEASE_SQL} AS rel FROM low),
g AS (SELECT rel, arg_max(id, [CAST(contains(platform, 'GitHub') OR contains(platform, 'Hacker') AS INT), CAST(floor(value) AS BIGINT), id]) AS hub_id FROM k WHERE rel != '' GROUP BY rel HAVING count(*) > 1 AND count(DISTINCT platform) > 1)
SELECT k.id, g.hub_id, k.id <> g.hub_id AS archived FROM k JOIN g ON k.rel = g.rel
""")
def release_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one release under their hub, the first by known platform, value and id; the others are archived."""
    from ..operators import stories

    keyed = headlines(spark, sf_dir).withColumn("rel", text.release_cluster_key(F.col("title"))).where("rel != ''")
    known = (F.col("platform").contains("GitHub") | F.col("platform").contains("Hacker")).cast("int")
    order = F.struct(known.alias("known"), F.floor("value").alias("value"), F.col("id"))
    return stories.release_clusters(keyed, "rel", order).select("id", "hub_id", "archived")


def _tokens_sql(column: str) -> str:
    t = f"lower({column})"
    for phrase, by in text.ENTITY_PHRASES.items():
        t = f"replace({t}, '{phrase}', ' {by} ')"
    meaning = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.ENTITY_WORDS.items()) + "}"
    words = f"list_transform(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: coalesce({meaning}[w], w))"
    return f"list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains([{', '.join(map(_quoted, sorted(set(text.ENTITY_STOP_WORDS))))}], w))))"


def _synonyms_sql(column: str) -> str:
    s = f"lower({column})"
    for pattern, by in text.SYNONYMS:
        s = f"regexp_replace({s}, {_quoted(pattern)}, '{by}', 'g')"
    return s


WITHOUT = f"regexp_replace(regexp_replace(title, {_quoted(text.PLATFORM_PREFIX)}, ''), {_quoted(text.SHOW_PREFIX)}, '')"


@query(f"""
WITH {HEADLINES} SELECT id, {WITHOUT} AS without_platform, {_synonyms_sql(WITHOUT)} AS normal, trim(regexp_replace(title, {_quoted(text.ENGLISH_PREFIX)}, '')) AS english, array_to_string({_tokens_sql('title')}, ' ') AS tokens, regexp_matches({RELEASE_SQL}, '[0-9]') OR (contains({RELEASE_SQL}, '-') AND len(list_intersect(string_split({RELEASE_SQL}, '-'), {text.MODEL_PARTS})) > 0) AS specific FROM low
""")
def title_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without their platform, with synonyms rewritten, in English, and as entity tokens."""
    t = F.col("title")
    return headlines(spark, sf_dir).select("id", text.without_platform(t).alias("without_platform"), text.with_synonyms(t).alias("normal"), text.english_title(F.lit(None).cast("string"), t).alias("english"), F.array_join(text.entity_tokens(t), " ").alias("tokens"), text.is_specific_entity(text.release_cluster_key(t)).alias("specific"))


ENTITY_LIST = "[" + ", ".join(map(_quoted, similarity.MAJOR_ENTITIES)) + "]"
ANCHOR_SQL = " OR ".join(f"(list_has_all(x, ['{a}', '{b}']) AND list_has_all(y, ['{a}', '{b}']))" for a, b in similarity.ANCHORS)
PAIRS = f"""{HEADLINES}, q AS (SELECT id, {_tokens_sql('title')} AS x, {_tokens_sql('other')} AS y, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 41) / 41.0 END AS sim, ts AS ta, ts + INTERVAL 1 HOUR * CAST(id % 400 AS INT) AS tb, id % 3 = 0 AS asset, 'https://a/' || CAST(id % 23 AS VARCHAR) AS ua, 'https://a/' || CAST(id % 29 AS VARCHAR) AS ub, CASE WHEN id % 4 = 0 THEN 'big-story-key-here' ELSE '' END AS ka, CASE WHEN id % 6 = 0 THEN 'big-story-key-there' ELSE '' END AS kb FROM headlines),
v AS (SELECT *, list_sort(list_intersect(x, {ENTITY_LIST})) AS ex, list_sort(list_intersect(y, {ENTITY_LIST})) AS ey, len(list_intersect(x, y)) AS common, least(len(x), len(y)) AS smaller FROM q),
w AS (SELECT *, len(ex) > 0 AND len(ey) > 0 AND ex <> ey AS veto FROM v),
g AS (SELECT *, NOT veto AND ({ANCHOR_SQL} OR (common >= 3 AND common >= 0.55 * smaller)) AS gate FROM w)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is a pair of titles with what is known of both; over enough rows every two titles meet."""
    i = F.col("id")
    link = lambda m: F.array(F.concat(F.lit("https://a/"), (i % m).cast("string")))
    key = lambda m, k: F.when(i % m == 0, k).otherwise("")
    return headlines(spark, sf_dir).select(
        "id", "title", "other", "platform", text.entity_tokens(F.col("title")).alias("x"), text.entity_tokens(F.col("other")).alias("y"), F.when(i % 5 != 0, (i % 41) / F.lit(41.0)).alias("sim"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ta"), (F.unix_seconds(F.col("ts").cast("timestamp")) + 3600 * (i % 400)).alias("tb"),
        (i % 3 == 0).alias("asset"), link(23).alias("ua"), link(29).alias("ub"), key(4, "big-story-key-here").alias("ka"), key(6, "big-story-key-there").alias("kb"),
    )


@query(f"""
WITH {PAIRS} SELECT id, veto, gate, CASE WHEN ua = ub THEN true WHEN NOT asset AND abs(epoch(tb) - epoch(ta)) > 168 * 3600 THEN false WHEN veto THEN false WHEN sim >= 0.88 THEN true WHEN sim < 0.74 THEN false WHEN sim IS NOT NULL THEN gate WHEN ka <> '' AND kb <> '' THEN true WHEN len(list_intersect(x, y)) >= 5 THEN true ELSE gate END AS duplicate FROM g
""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity veto, token gate and duplicate test of pairs of titles."""
    c = F.col
    made = similarity.duplicate_story(c("ua"), c("ub"), c("asset"), c("ta"), c("tb"), c("x"), c("y"), c("sim"), c("ka"), c("kb"), F.slice(F.array_intersect("x", "y"), 4, 100), F.slice(F.array_intersect("x", "y"), 4, 100))
    return _pairs(spark, sf_dir).select("id", similarity.entity_veto(c("x"), c("y")).alias("veto"), similarity.same_story(c("x"), c("y")).alias("gate"), made.alias("duplicate"))


def _versions_sql(column: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower({column}), {_quoted(text.VERSION)}), lambda v: regexp_replace(v, '^v+', '')))"


def _platform_sql(index: str) -> str:
    return _nth(f"CAST(floor({index} / 7) AS BIGINT) % {len(PLATFORMS)}", PLATFORMS)


def _normal_sql(title: str, platform: str) -> str:
    """Lower case without what names the platform, synonyms rewritten."""
    s = f"trim({title})"
    for name in (f"trim({platform})", f"trim(split_part({platform}, '(', 1))"):
        s = f"CASE WHEN starts_with(lower({s}), lower({name}) || ':') THEN trim(substr({s}, length({name}) + 2)) ELSE {s} END"
    return _synonyms_sql(f"regexp_replace(regexp_replace({s}, {_quoted(text.PLATFORM_PREFIX)}, ''), {_quoted(text.SHOW_PREFIX)}, '')")


def _spike_tokens_sql(normal: str, platform: str) -> str:
    own = f"string_split(regexp_replace(lower({platform}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_distinct(list_filter(string_split(regexp_replace({normal}, '[^a-z0-9.\\-+]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND NOT list_contains({text.SPIKE_STOP_WORDS}, w) AND NOT list_contains({own}, w)))"


def _any_sql(template: str) -> str:
    return "(" + " OR ".join(template.format(_quoted(e)) for e in similarity.SPIKE_ENTITIES) + ")"


OTHER_ID = f"CAST(floor(id / {N}) AS BIGINT) % {N}"


@query(f"""
WITH {HEADLINES}, l AS (SELECT *, {OTHER_ID} AS oid, {_platform_sql(OTHER_ID)} AS other_platform, {RELEASE_SQL} AS ra, {RELEASE_SQL.replace('(t,', '(lower(other),')} AS rb FROM low),
hubs AS (SELECT min(id) AS hub FROM l WHERE ra <> '' GROUP BY ra HAVING count(*) > 1),
n AS (SELECT *, {_normal_sql('title', 'platform')} AS na, {_normal_sql('other', 'other_platform')} AS nb, {_versions_sql('title')} AS va, {_versions_sql('other')} AS vb, CASE WHEN id % 5 = 0 THEN 0.0 ELSE (id % 41) / 41.0 END AS sim FROM l),
k AS (SELECT *, list_intersect({_spike_tokens_sql('na', 'platform')}, {_spike_tokens_sql('nb', 'other_platform')}) AS shared, lower(platform) = lower(other_platform) AS same, id IN (SELECT hub FROM hubs) OR oid IN (SELECT hub FROM hubs) AS locked FROM n),
c AS (SELECT *, len(shared) AS n_shared, len(list_filter(shared, lambda w: NOT list_contains({text.BROAD_ENTITIES}, w))) AS n_specific FROM k)
SELECT id, oid AS other_id, CAST(n_shared AS INT) AS n_shared, CAST(n_specific AS INT) AS n_specific, CASE WHEN sim < 0.78 THEN 'BELOW_THRESHOLD' WHEN ra <> '' AND rb <> '' AND ra <> rb THEN 'REJECTED_RELEASE_CONFLICT' WHEN locked AND n_specific < 2 THEN 'REJECTED_CANONICAL_HUB_LOCK' WHEN len(va) > 0 AND len(vb) > 0 AND len(list_intersect(va, vb)) = 0 THEN 'REJECTED_VERSION_CONFLICT' WHEN same AND contains(lower(platform), 'youtube') AND id <> oid THEN 'REJECTED_SAME_YOUTUBE_CHANNEL'
  WHEN {_any_sql('contains(na, {0})')} AND {_any_sql('contains(nb, {0})')} AND NOT {_any_sql('(contains(na, {0}) AND contains(nb, {0}))')} THEN 'REJECTED_ENTITY_VETO' WHEN same AND n_specific < 2 THEN 'REJECTED_SAME_PLATFORM_LOW_SPECIFIC_TOKENS' WHEN sim >= 0.88 AND n_shared >= 1 THEN 'VECTOR_HIGH' WHEN n_shared >= 2 AND n_specific >= 2 THEN 'TOKEN_OVERLAP' ELSE 'REJECTED_AMBIGUOUS_LOW_OVERLAP' END AS decision FROM c
""")
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade over pairs of items: releases, versions, entities, tokens, platforms and hubs are read from them.

    A hub is the first item of a release that several items are about.
    """
    c, oid = F.col, F.floor(F.col("id") / N) % N
    items = headlines(spark, sf_dir).select("id", "title", "platform", "other", oid.alias("other_id"), F.expr(_platform_sql(OTHER_ID)).alias("other_platform"))
    texts = items.select("title", "platform").union(items.select("other", "other_platform")).distinct()
    forms = texts.select("title", "platform", text.release_cluster_key(c("title")).alias("r"), text.spike_tokens(c("title"), c("platform")).alias("x"), text.with_synonyms(c("title"), c("platform")).alias("n"), text.versions(c("title")).alias("v"))  # once for each text
    one, two = forms.toDF("title", "platform", "ra", "xa", "na", "va"), forms.toDF("other", "other_platform", "rb", "xb", "nb", "vb")
    known = items.join(one, ["title", "platform"]).join(two, ["other", "other_platform"])
    hubs = known.where("ra != ''").groupBy("ra").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    for side, mark in (("id", "own_hub"), ("other_id", "other_hub")):
        known = known.join(hubs.select(F.col("hub").alias(side), F.lit(True).alias(mark)), side, "left")
    pairs = known.withColumn("shared", F.array_intersect("xa", "xb"))
    conflict, same = (c("ra") != "") & (c("rb") != "") & (c("ra") != c("rb")), F.lower("platform") == F.lower("other_platform")
    likeness = F.when(c("id") % 5 == 0, 0.0).otherwise((c("id") % 41) / F.lit(41.0))
    shared, specific, hub = F.size("shared"), F.size(text.specific_of(c("shared"))), F.coalesce("own_hub", "other_hub", F.lit(False))
    channel = same & F.lower("platform").contains("youtube") & (c("id") != c("other_id"))
    made = similarity.decision(likeness, shared, specific, same, conflict, (F.size("va") > 0) & (F.size("vb") > 0) & ~F.arrays_overlap("va", "vb"), similarity.no_common_entity(c("na"), c("nb")), hub, channel)
    return pairs.select("id", "other_id", shared.alias("n_shared"), specific.alias("n_specific"), made.alias("decision"))


@query(f"""
WITH {HEADLINES}, r AS (SELECT id, 15 + CASE WHEN regexp_matches(t, '\\b(beats o1|beats gpt-4o|crushes claude|100x faster|kills openai)\\b') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(t, '\\b(make \\$|passive income|shorts automation|tiktok bot)\\b') THEN 40 ELSE 0 END
  + CASE WHEN platform = 'GitHub Official' AND id % 5 = 0 AND length(title) < 30 THEN 25 ELSE 0 END + CASE WHEN regexp_matches(t, '\\b(open source|free for everyone)\\b') AND regexp_matches(t, '\\b(fair source|non-commercial|business license|\\$1m)\\b') THEN 20 ELSE 0 END AS risk FROM low)
SELECT id, CAST(least(100, risk) AS INT) AS risk, CASE WHEN risk >= 70 THEN 'HIGH' WHEN risk >= 40 THEN 'MODERATE' ELSE 'LOW' END AS level FROM r
""")
def hype_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each title by boasts, promised income, stars without description, and masked licences."""
    stars = F.when(F.col("id") % 5 == 0, 5000).otherwise(10)
    risk = scoring.hype_risk(F.lower("title"), F.col("platform"), stars, F.length("title"))
    return headlines(spark, sf_dir).select("id", risk.alias("risk"), classify.ladder(risk, [(70, "HIGH"), (40, "MODERATE")], "LOW").alias("level"))


HOOKS = ["A plain hook", "엔지니어가 이 글을 지금 당장 읽어야 하는 이유", "한국어 훅", "Compelling 1-line hook for engineers"]


@query(f"""
WITH {HEADLINES}, h AS (SELECT *, {_nth("id % 4", HOOKS)} AS hook, {_nth("id % 5", ["tier_1_ground_truth", "tier_2_verified_secondary", "tier_3_community_informational", "tier_4_unverified_noise"])} AS tier, {_nth("id % 3", ["開源模型", "no hanzi"])} AS zh FROM low),
w AS (SELECT *, CASE tier WHEN 'tier_1_ground_truth' THEN 1.0 WHEN 'tier_2_verified_secondary' THEN 0.8 WHEN 'tier_3_community_informational' THEN 0.5 WHEN 'tier_4_unverified_noise' THEN 0.1 END AS weight FROM h)
SELECT id, {_holds('hook', ct.ECHOED)} AS echoed, coalesce(regexp_matches(title, '[가-힣]') AND regexp_matches(hook, '[가-힣]') AND regexp_matches(zh, '[一-鿿]'), false) AS translated, CAST(weight AS DOUBLE) AS weight,
  CASE WHEN weight IS NULL THEN 'UNVERIFIABLE' WHEN id % 13 = 0 THEN 'CONFIRMED_FALSE' WHEN id % 17 = 0 THEN 'MISLEADING_GAMED' WHEN weight >= 0.85 THEN 'VERIFIED_TRUE' WHEN weight >= 0.7 THEN 'MOSTLY_TRUE' WHEN weight >= 0.5 THEN 'HALF_TRUE' ELSE 'UNVERIFIABLE' END AS verdict
FROM w
""")
def enrichment_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hook echoes its prompt, whether a translation is one, and the verdict that the evidence's weight gives."""

    def nth(column: Column, values: list[str]) -> Column:
        return classify.first_match([(column == k, v) for k, v in enumerate(values)], None)

    h = headlines(spark, sf_dir).withColumns({"hook": nth(F.col("id") % 4, HOOKS), "tier": nth(F.col("id") % 5, list(ct.TIER_WEIGHTS)), "zh": nth(F.col("id") % 3, ["開源模型", "no hanzi"])})
    weight, i = ct.credibility(F.col("tier")), F.col("id")
    verdict = ct.verdict_of(weight, F.col("tier") == "tier_1_ground_truth", i % 17 == 0, i % 13 == 0, weight.isNull())
    return h.select("id", ct.echoes_prompt([F.col("hook")]).alias("echoed"), ct.valid_translation(F.col("title"), F.col("hook"), F.col("zh")).alias("translated"), weight.alias("weight"), verdict.alias("verdict"))


@query(f"WITH h AS ({ORACLE['hype_risk_rules']}) SELECT level, count(*) AS n, round(avg(risk), 3) AS mean FROM h GROUP BY 1")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles are at each level of risk."""
    return hype_risk_rules(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 3).alias("mean"))
