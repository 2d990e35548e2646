"""Queries of the daily upkeep: harvested rows, enrichment records, traces, times, stocks and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, inbox as ib, payload as pl, rules, text, timeslot
from ..operators import ranking, search
from ..registry import query
from ..sources import feeds, harvest
from ..sources.tables import table
from .inbox import INBOX, JS, RANKS, inbox, ranks
from .payloads import ITEMS, items
from .rulebook import HEADLINES, _quoted, headlines
from .stories import KNN, neighbours
from .timeline import AS_OF, as_of

MODEL_ID = "CASE p_partkey % 8 WHEN 0 THEN 'unsloth/Qwen3-' || p_size || 'B-GGUF' WHEN 1 THEN 'org/whisper-tts-350M' WHEN 2 THEN 'org/flux.1-dev-lora' WHEN 3 THEN 'meta-llama/Llama-3.1-' || p_size || 'b' WHEN 4 THEN 'codestral-FP8' WHEN 5 THEN 'plain-model' WHEN 6 THEN '' ELSE NULL END"


@query(f"""
WITH m AS (SELECT p_partkey AS k, {MODEL_ID} AS id, p_size FROM part)
SELECT k, 'https://huggingface.co/' || id AS source_url, CASE WHEN contains(lower(id), 'qwen') THEN 'Qwen' WHEN contains(lower(id), 'wan') THEN 'Wan' WHEN contains(lower(id), 'flux') THEN 'FLUX' WHEN contains(lower(id), 'llama') THEN 'Llama' WHEN contains(lower(id), 'whisper') THEN 'Audio / Speech' WHEN contains(lower(id), 'codestral') THEN 'Mistral' ELSE 'Standalone' END AS family,
  CASE WHEN regexp_extract(id, '\\b(\\d+(?:\\.\\d+)?[BMb])\\b', 1) = '' THEN 'N/A' ELSE upper(regexp_extract(id, '\\b(\\d+(?:\\.\\d+)?[BMb])\\b', 1)) END AS size,
  CASE WHEN k % 3 = 0 THEN 'Safetensors' || CASE WHEN contains(lower(id), 'gguf') THEN ',GGUF' WHEN contains(lower(id), 'fp8') THEN ',FP8' WHEN contains(lower(id), 'lora') THEN ',LoRA' ELSE '' END WHEN contains(lower(id), 'gguf') THEN 'GGUF' WHEN contains(lower(id), 'fp8') THEN 'FP8' WHEN contains(lower(id), 'lora') THEN 'LoRA' ELSE 'Safetensors' END AS formats
FROM m WHERE id != ''
""")
def model_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of models read into family, size and formats."""
    raw = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", f"{MODEL_ID} AS id", "CASE WHEN p_partkey % 3 = 0 THEN array('safetensors', 'en') END AS tags").where("id != ''")
    i = F.col("id")
    return raw.select("k", F.concat(F.lit("https://huggingface.co/"), i).alias("source_url"), harvest.family(i).alias("family"), harvest.parameter_size(i).alias("size"), F.array_join(harvest.formats(i, F.col("tags")), ",").alias("formats"))


@query("""
WITH a AS (SELECT 0 AS list, 'o/' || s_nationkey || '-' || s_suppkey % 40 AS full_name, s_suppkey AS id, s_suppkey % 90 AS stars FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 1, 'o/' || s_nationkey || '-' || s_suppkey % 40, s_suppkey, 7 FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY list, lpad(CAST(id AS VARCHAR), 9, '0')) AS n FROM a)
SELECT 'GitHub: ' || full_name AS title, 'Stars: ' || stars || ', Forks: 0 | ' || CASE WHEN id % 4 = 0 THEN 'No description' ELSE 'about ' || id END AS description, '★ ' || stars || ' Stars' AS viral_metric FROM r WHERE n = 1
""")
def repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches one after the other, each repository once."""
    s = table(spark, sf_dir, "supplier")
    name, key = F.concat_ws("", F.lit("o/"), F.col("s_nationkey").cast("string"), F.lit("-"), (F.col("s_suppkey") % 40).cast("string")), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    about = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("about "), F.col("s_suppkey").cast("string")))
    columns = [name.alias("full_name"), key.alias("html_url"), about.alias("description"), F.lit(None).cast("long").alias("forks_count"), F.lit("2024-01-01").alias("created_at")]
    lists = [s.where("s_acctbal > 0").select(*columns, (F.col("s_suppkey") % 90).cast("long").alias("stargazers_count")), s.select(*columns, F.lit(7).cast("long").alias("stargazers_count"))]
    return harvest.repositories(lists).select("title", "description", "viral_metric")


@query(r"""
WITH e AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '<a href="' || url || '?out">x</a>' ELSE '' END || html AS html FROM pages)
SELECT page_id, coalesce(nullif(regexp_extract(html, 'href=[''"](https?://[^''"]+)[''"]', 1), ''), url) AS article_url, substring(trim(regexp_replace(html, '<[^>]+>', ' ', 'g')), 1, 200) AS description FROM e
""")
def feed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a feed: the article that they link to, and the start of their text."""
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<a href="'), "url", F.lit('?out">x</a>'))).otherwise("")
    e = table(spark, sf_dir, "pages").withColumn("html", F.concat(own, "html"))
    return e.select("page_id", harvest.external_link(F.col("html"), F.col("url")).alias("article_url"), harvest.abstract(F.col("html")).alias("description"))


@query(r"""
WITH d AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS title, trim(substr(text, length(string_split(text, chr(10))[1]) + 2), ' ' || chr(10)) AS body FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '(?s).*?[.!?\n]\s+|.+'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: length(x) > 15)[1] AS first FROM d)
SELECT doc_id, CASE WHEN regexp_matches(title || ' ' || body, '[가-힣]') THEN 'KO' ELSE 'EN' END AS source_lang, CASE WHEN length(coalesce(first, title)) > 160 THEN substr(coalesce(first, title), 1, 157) || '...' ELSE coalesce(first, title) END AS hook,
  array_to_string(regexp_extract_all(title, '[A-Za-z0-9_-]{3,}')[1:5], ',') AS keywords FROM s
""")
def heuristic_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules say of a document without a language model: language, first sentence as hook, words of the title."""
    head = F.substring_index("text", "\n", 1)
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.trim(head).alias("title"), F.regexp_replace(F.substr("text", F.length(head) + 2), r"^[ \n]+|[ \n]+$", "").alias("body"))
    return d.select("doc_id", F.when(F.concat_ws(" ", "title", "body").rlike("[가-힣]"), "KO").otherwise("EN").alias("source_lang"), text.first_sentence(F.col("body"), F.col("title")).alias("hook"), text.keywords(F.col("title")).alias("keywords"))


@query(f"""
WITH {INBOX} SELECT id, coalesce(nullif({JS('title_ko')}, ''), title) AS title_ko, upper(coalesce(CASE WHEN id % 5 = 0 THEN 'zh' END, nullif({JS('ai_enrichment.source_lang')}, ''), 'EN')) AS source_lang, coalesce(CASE WHEN id % 4 = 0 THEN 'new-story' END, 'kept-' || CAST(id % 3 AS VARCHAR)) AS story, coalesce({JS('facet_type')}, '') AS facet_kept, true AS scored FROM inbox
""")
def enrichment_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New enrichment fields written into the payload: what the answer lacks comes from the payload, other fields and types stay."""
    p, i = F.col("payload"), F.col("id")
    before = pl.with_fields(p, {"canonical_story_key": F.concat(F.lit("kept-"), (i % 3).cast("string"))})
    answer = {"source_lang": F.when(i % 5 == 0, "zh"), "canonical_story_key": F.when(i % 4 == 0, "new-story")}
    new = {"title_ko": F.coalesce(pl.path(p, "title_ko"), F.col("title")), "source_lang": F.upper(F.coalesce(answer["source_lang"], pl.path(p, "ai_enrichment.source_lang"), F.lit("EN"))), "canonical_story_key": F.coalesce(answer["canonical_story_key"], pl.path(F.col("before"), "canonical_story_key")), "scored": F.lit(True)}
    after = inbox(spark, sf_dir).withColumn("before", before).select("id", pl.with_fields(F.col("before"), new).alias("a"))
    return after.select("id", pl.path(F.col("a"), "title_ko").alias("title_ko"), pl.path(F.col("a"), "source_lang").alias("source_lang"), pl.path(F.col("a"), "canonical_story_key").alias("story"), F.coalesce(F.get_json_object("a", "$.facet_type"), F.lit("")).alias("facet_kept"), (F.get_json_object("a", "$.scored") == "true").alias("scored"))


@query(f"WITH {KNN} SELECT a_id, b_id, round(sim, 4) AS similarity, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS place FROM nn QUALIFY place <= 3")
def trace_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar peers that a trace keeps of each item."""
    top = ranking.top_k(neighbours(spark, sf_dir).drop("rank_position"), ["a_id"], [F.desc("similarity"), F.col("b_id")], 3, "place")
    return top.select("a_id", "b_id", F.round("similarity", 4).alias("similarity"), F.col("place").cast("long").alias("place"))


@query("""
WITH h AS (SELECT label, min(vec_id) AS hub FROM embeddings GROUP BY 1)
SELECT e.vec_id, h.hub, round(list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]), 4) AS similarity FROM embeddings e JOIN h USING (label) JOIN embeddings x ON x.vec_id = h.hub WHERE e.vec_id <> h.hub
""")
def cluster_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every member of a cluster with its hub: as many pairs as members."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    hubs = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("hub"))
    both = e.join(hubs, "label").where(F.col("vec_id") != F.col("hub.vec_id"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col("embedding"), F.col("hub.embedding")
    return both.select("vec_id", F.col("hub.vec_id").alias("hub"), F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 4).alias("similarity"))


@query("SELECT count(text) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, CAST(max(length(text)) AS INT) AS longest, round((1 - sum(length(text)) / greatest(1, sum(octet_length(encode(text))))) * 100, 1) AS saved FROM documents")
def vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much text there is, the longest, and what share of bytes isn't characters."""
    chars, size = F.sum(F.length("text")), F.sum(F.octet_length("text"))
    return table(spark, sf_dir, "documents").agg(F.count("text").alias("n"), F.coalesce(chars, F.lit(0)).alias("chars"), F.coalesce(size, F.lit(0)).alias("bytes"), F.max(F.length("text")).alias("longest"), F.round((1 - chars / F.greatest(F.lit(1), size)) * 100, 1).alias("saved"))


PRICES = {"llm": {"small": 0.002, "large": 0.02}, "tts": {"free": 0.0, "studio": 0.09}, "video": {"stock": 0.001, "generated": 0.05}}


@query("""
WITH c AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 0.002 WHEN 1 THEN 0.02 ELSE 0.005 END / 60.0 * d AS llm, CASE s_suppkey % 2 WHEN 0 THEN 0.0 ELSE 0.09 END / 60.0 * d AS tts, CASE s_suppkey % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 0.05 ELSE 0.0 END * d AS video FROM (SELECT s_suppkey, CAST(30 + s_suppkey % 60 AS DOUBLE) AS d FROM supplier))
SELECT k, round(llm + tts + video, 4) AS raw_unit_cost, round(llm + tts + video * 1.5, 4) AS effective_unit_cost, round((llm + tts + video * 1.5) * 30, 3) AS monthly_cost FROM c
""")
def unit_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a unit by its parts, what rejects add, and a month of thirty; parts that the price list lacks have defaults."""
    k = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(k.alias("k"), (30 + k % 60).cast("double").alias("seconds"), F.when(k % 3 == 0, "small").when(k % 3 == 1, "large").otherwise("unknown").alias("llm"), F.when(k % 2 == 0, "free").otherwise("studio").alias("tts"), F.when(k % 5 == 0, "stock").when(k % 5 == 1, "generated").otherwise("none").alias("video"))
    price = lambda part, default: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRICES[part].items() for x in kv]), F.col(part)), F.lit(default))
    llm, tts, video = price("llm", 0.005) / 60.0 * F.col("seconds"), price("tts", 0.0) / 60.0 * F.col("seconds"), price("video", 0.0) * F.col("seconds")
    effective = llm + tts + video * 1.5
    return made.select("k", F.round(llm + tts + video, 4).alias("raw_unit_cost"), F.round(effective, 4).alias("effective_unit_cost"), F.round(effective * 30, 3).alias("monthly_cost"))


@query("""
WITH w AS (SELECT CASE event_id % 3 WHEN 0 THEN 'Voyage-Embed' WHEN 1 THEN 'enricher' END AS worker, value FROM events)
SELECT CASE WHEN worker ILIKE '%voyage%' THEN 'embed' ELSE 'enrich' END AS side, count(*) AS n, round(sum(value), 2) AS total FROM w WHERE worker IS NOT NULL GROUP BY 1
""")
def worker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows by the kind of worker; rows without a name are on neither side."""
    worker = F.when(F.col("event_id") % 3 == 0, "Voyage-Embed").when(F.col("event_id") % 3 == 1, "enricher")
    w = table(spark, sf_dir, "events").select(worker.alias("worker"), "value").where("worker is not null")
    return w.groupBy(F.when(F.col("worker").ilike("%voyage%"), "embed").otherwise("enrich").alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


TIMES = "CASE event_id % 6 WHEN 0 THEN '2024-01-05T10:20:30Z' WHEN 1 THEN '2024-01-05T10:20:30+09:00' WHEN 2 THEN '2024-01-05T10:20:30' WHEN 3 THEN '2024-01-05' WHEN 4 THEN 'soon' END"


@query(f"""
WITH t AS (SELECT event_id, {TIMES} AS raw FROM events),
u AS (SELECT event_id, CASE WHEN raw LIKE '%T%Z' THEN CAST(replace(raw, 'Z', '') AS TIMESTAMP) WHEN raw LIKE '%T%+09:00' THEN CAST(replace(raw, '+09:00', '') AS TIMESTAMP) - INTERVAL 9 HOUR WHEN raw LIKE '____-__-__%' THEN CAST(raw AS TIMESTAMP) - INTERVAL 9 HOUR ELSE TIMESTAMP '{AS_OF}' END AS m FROM t)
SELECT event_id, strftime(m, '%Y-%m-%d %H:%M') AS utc, strftime(m + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_time, CAST(hour(m + INTERVAL 9 HOUR) // 6 + 1 AS INT) AS session FROM u
""")
def naive_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a zone are what they say, times and days without one are local; what doesn't parse is the reference time."""
    at = timeslot.zoned(F.expr(TIMES), as_of())
    t = table(spark, sf_dir, "events").select("event_id", at.alias("at"))
    return t.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("utc"), timeslot.local_text(F.col("at")).alias("local_time"), timeslot.session(F.col("at")).alias("session"))


@query(f"""
WITH {ITEMS}, s AS (SELECT id, unnest(from_json(json_extract(payload, '$.sources'), '[{{"url":"VARCHAR","created_at":"VARCHAR"}}]')) AS src FROM items),
u AS (SELECT id, count(*) AS n, count(DISTINCT regexp_replace(lower(trim(src.url)), '#.*$', '')) AS n_urls, max(try_cast(src.created_at AS TIMESTAMP)) AS latest FROM s GROUP BY id)
SELECT i.id, coalesce(n_urls, 0) AS n_urls, CASE WHEN coalesce(n, 0) > 1 AND latest > TIMESTAMP '2024-01-12' THEN strftime(latest, '%Y-%m-%d') WHEN coalesce(n, 0) <= 1 AND i.ts > TIMESTAMP '2024-01-20' THEN strftime(i.ts, '%Y-%m-%d') END AS updated FROM items i LEFT JOIN u USING (id)
""")
def update_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When an item was really updated: by its latest source if it has several, else by its own time; and how many URLs it has."""
    s = F.coalesce(pl.sources(F.col("payload")), F.array().cast(pl.SOURCES))
    latest = F.array_max(F.transform(s, lambda x: x["created_at"].try_cast("timestamp_ntz")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    after = lambda c, d: c > F.lit(d).cast("timestamp_ntz")
    mark = F.when((F.size(s) > 1) & after(latest, "2024-01-12"), day(latest)).when((F.size(s) <= 1) & after(F.col("ts"), "2024-01-20"), day(F.col("ts")))
    return items(spark, sf_dir).select("id", F.size(F.array_distinct(ib.distinct_urls(F.transform(s, lambda x: x["url"])))).cast("long").alias("n_urls"), mark.alias("updated"))


AXES = {
    "worker": "CASE WHEN regexp_matches(x, 'pytorchkr|pytorch\\.kr|discuss\\.pytorch\\.kr') THEN 'COMMUNITY' WHEN regexp_matches(x, 'github|hugging|hf |arxiv|code|paper|model|deepmind|openai|anthropic|claude\\.dev|research') THEN 'CODE' WHEN (regexp_matches(x, 'hacker news|ycombinator') AND NOT contains(x, 'the hacker news')) OR regexp_matches(x, 'reddit|geeknews|lobsters|hada\\.io|youtube|youtu\\.be|twitter|x\\.com|community|forum') THEN 'COMMUNITY' ELSE 'PRESS' END",
    "popover": "CASE WHEN contains(p, 'pytorch.kr') THEN 'COMMUNITY' WHEN regexp_matches(p, 'github|space|hugging|hf |arxiv|deepmind|openai|anthropic|research') OR regexp_matches(u, 'github\\.com|/spaces/|huggingface\\.co|arxiv\\.org|openai\\.com') THEN 'CODE' WHEN ((contains(p, 'hacker news') OR contains(u, 'ycombinator.com')) AND NOT contains(p, 'the hacker news')) OR regexp_matches(p, 'reddit|geeknews|youtube|twitter| x|lobsters|v2ex|community|forum') OR regexp_matches(u, 'reddit\\.com|hada\\.io|youtube\\.com|youtu\\.be|x\\.com|twitter\\.com') THEN 'COMMUNITY' ELSE 'PRESS' END",
}


@query(f"WITH {INBOX}, a AS (SELECT id, lower(coalesce(source_platform, '')) AS p, lower(source_url) AS u, lower(coalesce(source_platform, '') || ' ' || source_url) AS x FROM inbox) SELECT id, {AXES['worker']} AS worker, {AXES['popover']} AS popover FROM a")
def source_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of a source by the two rule sets that differ from source_array_metrics' one."""
    p, u = F.col("source_platform"), F.col("source_url")
    return inbox(spark, sf_dir).select("id", classify.source_axis_joined(p, u).alias("worker"), classify.source_axis_hosts(p, u).alias("popover"))


@query(f"""
WITH {INBOX}, {RANKS}, q AS (SELECT id, updated_at, id % 10 = 0 AS failed FROM inbox WHERE NOT is_classified), c AS (SELECT * FROM q ORDER BY updated_at NULLS FIRST, id LIMIT 40)
SELECT q.id, coalesce(c.id IS NOT NULL AND NOT q.failed, false) AS done, CASE WHEN c.id IS NOT NULL AND q.failed THEN TIMESTAMP '{AS_OF}' ELSE q.updated_at END AS updated_at FROM q LEFT JOIN c USING (id)
""")
def queue_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drain of a queue: the forty oldest are worked on; those that fail go to its back by their new time."""
    q = inbox(spark, sf_dir).where("not is_classified").select("id", "updated_at", (F.col("id") % 10 == 0).alias("failed"))
    claimed = q.orderBy(F.col("updated_at").asc_nulls_first(), "id").limit(40).select("id", F.lit(True).alias("claimed"))
    both = q.join(claimed, "id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return both.select("id", (F.col("claimed") & ~F.col("failed")).alias("done"), F.when(F.col("claimed") & F.col("failed"), as_of()).otherwise(F.col("updated_at")).alias("updated_at"))


@query(f"""
WITH {INBOX}, m AS (SELECT id, created_at, CASE WHEN id % 97 = 0 THEN 0 ELSE 1 END AS pool FROM inbox WHERE NOT is_classified), p AS (SELECT *, row_number() OVER (ORDER BY pool, created_at DESC, id) - 1 AS i FROM m)
SELECT id, pool = 0 AS from_manifest, i // 16 AS batch FROM p WHERE i < 120
""")
def manifest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of a run: what the manifest names first, filled up from the scan to 120, in batches of sixteen."""
    m = inbox(spark, sf_dir).where("not is_classified").select("id", "created_at", F.when(F.col("id") % 97 == 0, 0).otherwise(1).alias("pool"))
    orders = [F.col("pool"), F.desc("created_at"), F.col("id")]
    best = search.limited(m.orderBy(*orders), 120)
    i = F.row_number().over(Window.orderBy(*orders)) - 1  # of 120 rows
    return best.select("id", (F.col("pool") == 0).alias("from_manifest"), F.floor(i / 16).cast("long").alias("batch"))


@query(f"""
WITH {INBOX}, s AS (SELECT id, CASE WHEN source_platform LIKE '%Space%' THEN 50 WHEN source_platform LIKE '%Models%' THEN 40 WHEN source_platform LIKE '%GitHub%' THEN 30 ELSE 0 END + CAST(viral_score AS INT) AS quality, source_platform IN ('Hacker News', 'GeekNews') AS known, contains(lower(title), 'demo') AS demo, coalesce(json_array_length(payload, '$.sources'), 0) AS n FROM inbox)
SELECT row_number() OVER (ORDER BY quality DESC, n DESC, demo, known DESC, id DESC) AS place, id, CAST(quality AS INT) AS quality FROM s ORDER BY place LIMIT 50
""")
def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by platform weight and the first number of their metric, then by a hub's five keys."""
    p = F.coalesce("source_platform", F.lit(""))
    weight = classify.first_match([(p.contains("Space"), 50), (p.contains("Models"), 40), (p.contains("GitHub"), 30)], 0)
    metric = text.metric_number(F.concat(F.lit("★ "), F.col("viral_score").cast("int").cast("string"), F.lit(" stars")))
    s = inbox(spark, sf_dir).select("id", (weight + metric).cast("int").alias("quality"), p.isin("Hacker News", "GeekNews").alias("known"), F.lower("title").contains("demo").alias("demo"), pl.array_length(F.col("payload"), "sources").alias("n"))
    orders = [F.desc("quality"), F.desc("n"), F.col("demo"), F.desc("known"), F.desc("id")]
    return s.orderBy(*orders).limit(50).select(F.row_number().over(Window.orderBy(*orders)).cast("long").alias("place"), "id", "quality")  # of fifty rows


@query(f"""
WITH {INBOX}, {RANKS}, l AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'failure' WHEN id % 5 = 1 THEN 'cancelled' ELSE 'success' END AS conclusion, 60 + id % 400 AS seconds FROM inbox)
SELECT l.id, l.conclusion, CAST(l.seconds // 60 AS VARCHAR) || 'm ' || CAST(l.seconds % 60 AS VARCHAR) || 's' AS took, coalesce(CAST(r.rank_position AS INT), 0) AS collected, CAST(CASE WHEN l.conclusion = 'failure' THEN 1 ELSE 0 END AS INT) AS errors FROM l LEFT JOIN ranks r ON r.item_id = l.id
""")
def live_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live runs with what is stored of them; those that aren't stored yet have zeros."""
    i = inbox(spark, sf_dir)
    live = i.select("id", F.when(F.col("id") % 5 == 0, "failure").when(F.col("id") % 5 == 1, "cancelled").otherwise("success").alias("conclusion"), (60 + F.col("id") % 400).alias("seconds"))
    stored = ranks(i).select(F.col("item_id").alias("id"), F.col("rank_position").alias("stored"))
    took = F.concat(F.floor(F.col("seconds") / 60).cast("string"), F.lit("m "), (F.col("seconds") % 60).cast("string"), F.lit("s"))
    return live.join(stored, "id", "left").select("id", "conclusion", took.alias("took"), F.coalesce("stored", F.lit(0)).alias("collected"), F.when(F.col("conclusion") == "failure", 1).otherwise(0).alias("errors"))


@query("""
WITH t AS (SELECT vec_id, 'model:64:' || CAST(label AS VARCHAR) || ':' || CAST(vec_id % 90 AS VARCHAR) AS key FROM embeddings), c AS (SELECT key, min(vec_id) AS cached FROM t WHERE vec_id % 3 = 0 GROUP BY 1)
SELECT t.vec_id, t.key, c.cached, c.cached IS NULL AS missed FROM t LEFT JOIN c USING (key)
""")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors looked up by model, width and text; what the cache lacks is named."""
    key = F.concat_ws(":", F.lit("model"), F.size("embedding").cast("string"), F.col("label").cast("string"), (F.col("vec_id") % 90).cast("string"))
    t = table(spark, sf_dir, "embeddings").select("vec_id", key.alias("key"))
    cache = t.where("vec_id % 3 = 0").groupBy("key").agg(F.min("vec_id").alias("cached"))
    return t.join(cache, "key", "left").select("vec_id", "key", "cached", F.col("cached").isNull().alias("missed"))


@query(f"""
WITH {INBOX}, s AS (SELECT id, json_array_length(payload, '$.sources') AS n, coalesce({JS('is_cross_spiking')} = 'true', false) AS spiking, try_cast(nullif({JS('spike_analysis.score')}, '') AS DOUBLE) AS score, json_extract(payload, '$.spike_analysis') IS NULL AS unscored, * EXCLUDE (id) FROM inbox)
SELECT id, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND (spiking OR n > 1) AND (unscored OR coalesce(score, 0) >= 0.3) AS cross_spike, coalesce({JS('facet_type')} = 'MODEL', false) OR coalesce({JS('is_model')} = 'true', false) OR contains(lower(coalesce(source_platform, '')), 'model') AS model, coalesce({JS('facet_type')} = 'TOOL', false) OR contains(lower(coalesce(source_platform, '')), 'github') AS tool FROM s
""")
def snapshot_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facets as the stored snapshot has them when the database is away; these rules are narrower."""
    p, kind = F.col("payload"), F.get_json_object("payload", "$.facet_type")
    sure = lambda c: F.coalesce(c, F.lit(False))
    name = F.lower(F.coalesce("source_platform", F.lit("")))
    scored = F.get_json_object(p, "$.spike_analysis").isNull() | (F.coalesce(ib.number_of(p, "spike_analysis.score"), F.lit(0.0)) >= 0.3)
    spiking = sure(F.get_json_object(p, "$.is_cross_spiking") == "true") | (pl.array_length(p, "sources") > 1)
    recent = F.col("created_at") >= as_of() - F.expr("INTERVAL 7 DAYS")
    return inbox(spark, sf_dir).select("id", (recent & spiking & scored).alias("cross_spike"), (sure(kind == "MODEL") | sure(F.get_json_object(p, "$.is_model") == "true") | name.contains("model")).alias("model"), (sure(kind == "TOOL") | name.contains("github")).alias("tool"))


@query("""
WITH s AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, list_sort(list_distinct(list(CAST(turn AS VARCHAR)))) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, list_has_all(['assistant', 'system', 'user'], roles) AS known_only, roles = ['assistant', 'user'] AS two_sided, list_has_all(turns, ['0', '1']) AS opened FROM s
""")
def role_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subset and equality of small sets of values."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.collect_set(F.col("turn").cast("string")).alias("turns"))
    given = lambda *v: F.array(*map(F.lit, v))
    return s.select("conv_id", text.is_subset(F.col("roles"), given("assistant", "system", "user")).alias("known_only"), (text.is_subset(F.col("roles"), given("assistant", "user")) & text.is_subset(given("assistant", "user"), F.col("roles"))).alias("two_sided"), text.is_subset(given("0", "1"), F.col("turns")).alias("opened"))


#: Families that each session of a day looks for, by the session's first hour. Fixed values.
SESSIONS = {0: ["GitHub", "HackerNews", "HuggingFace"], 6: ["ArXiv", "GitHub", "HuggingFace"], 12: ["HuggingFace", "GitHub", "GeekNews"], 18: ["HackerNews", "GitHub", "TechMedia", "HuggingFace"]}


def session_candidates(items: DataFrame, today: str, current_hour: int) -> DataFrame:
    """item, family, weight, priorities: 1 in the session's hours of its day, 2 on that day, 3 today or yesterday, else 4. The day of a session to come is yesterday."""
    local, day = timeslot.shifted(F.col("created_at")), lambda n: F.date_sub(F.lit(today).cast("date"), n)

    def priority(hour: int):  # noqa: ANN202
        target = day(1 if hour > current_hour else 0)
        on_day, in_hours = F.to_date(local) == target, F.hour(local).between(hour, hour + 5)
        return F.when(on_day & in_hours, 1).when(on_day, 2).when(F.to_date(local).isin(day(0), day(1)), 3).otherwise(4)

    return items.select(F.col("id").alias("item"), classify.platform_family(F.col("source_platform")).alias("family"), F.col("viral_score").alias("weight"), F.array(*[priority(h) for h in SESSIONS]).alias("priorities"))


@query()
def session_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four picks for each of a day's four sessions: one of each family it looks for, then the best that are left, none twice."""
    from ..operators import clustering

    return clustering.session_picks(session_candidates(inbox(spark, sf_dir), "2024-01-20", 13), list(SESSIONS.values()))


@query("""
SELECT page_id, 'One ' || page_id AS title, replace(url, '&', '+') AS url, '2024-01-02' AS published, trim(substr(regexp_replace(html, '[^A-Za-z ]', '', 'g'), 1, 120)) AS body FROM pages WHERE page_id % 3 <> 2
""")
def feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds held as text, as an HTTP source gives them, read into entries: RSS, Atom, and what isn't XML."""
    body = F.substring(F.regexp_replace("html", "[^A-Za-z ]", ""), 1, 120)
    link, title = F.replace("url", F.lit("&"), F.lit("+")), F.concat(F.lit(" One "), F.col("page_id").cast("string"), F.lit(" "))
    rss = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>2024-01-02</pubDate><summary>x</summary><description>"), body, F.lit("</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), title, F.lit('</title><link href="'), link, F.lit('"/><updated>2024-01-02</updated><content>'), body, F.lit("</content></entry></feed>"))
    p = table(spark, sf_dir, "pages")
    kinds = [(0, rss, False), (1, atom, True), (2, F.lit("not xml at all"), False)]
    read = [feeds.entries_of(p.where(F.col("page_id") % 3 == k).select("page_id", x.alias("value")), "value", atom=is_atom) for k, x, is_atom in kinds]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(f"""
WITH {HEADLINES}, d AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE ts END AS published FROM low)
SELECT id, regexp_matches(title, {_quoted('(?i)' + rules.RELEVANT)}) OR regexp_matches(title, {_quoted(rules.RELEVANT_WORDS)}) AS relevant, published IS NULL OR published >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS recent,
  coalesce(id % 3 <> 0 AND (id % 5 = 0 OR id % 7 = 0 OR {' OR '.join(f"contains(platform, '{w}')" for w in rules.NEWS_SOURCES)}), false) AS news,
  id % 3 <> 0 AND (id % 5 = 1 OR id % 7 = 1 OR contains(platform, 'Models') OR contains(platform, 'Spaces') OR (contains(platform, 'Hugging') AND contains(platform, 'Hub')) OR id % 11 = 0 OR (id % 13 = 0 AND NOT contains(platform, 'GitHub'))) AS model
FROM d
""")
def harvest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and recency gates of a harvest, and whether an item is news or a model."""
    i, enriched = F.col("id"), F.col("id") % 3 != 0
    kind = F.when(i % 5 == 0, "NEWS").when(i % 5 == 1, "MODEL")
    category = F.when(i % 7 == 0, "NEWS").when(i % 7 == 1, "FOUNDATION_MODELS")
    source = F.array(F.when(i % 11 == 0, "HF Space"))
    family = F.when(i % 13 == 0, "Qwen").when(i % 13 == 1, "Standalone")
    p = F.col("platform")
    return headlines(spark, sf_dir).select("id", rules.relevant(F.col("title")).alias("relevant"), rules.recent_or_undated(F.when(i % 4 != 0, F.col("ts")), as_of()).alias("recent"), rules.is_news(enriched, kind, category, p).alias("news"), rules.is_model(enriched, kind, category, p, family, source).alias("model"))


@query(f"""
WITH {HEADLINES}, e AS (SELECT *, CASE id % 3 WHEN 0 THEN 'Key architectural updates and practitioner impact analysis published via X' WHEN 1 THEN ' a hook ' END AS hook FROM low)
SELECT id, title || CASE WHEN hook IS NOT NULL THEN ' | Hook: ' || trim(hook) ELSE '' END AS drained, title || CASE WHEN hook IS NOT NULL THEN ' | Hook: ' || trim(hook) ELSE '' END || ' | Summary: ' || other AS digest,
  trim(regexp_replace(title, {_quoted(text.PLATFORM_PREFIX)}, '')) || CASE WHEN id % 3 = 1 THEN ' | Hook: a hook' ELSE '' END || ' | Summary: ' || substr(other, 1, 300) AS worker FROM e
""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts that are embedded of an item."""
    t, o = F.col("title"), F.col("other")
    hook = F.when(F.col("id") % 3 == 0, "Key architectural updates and practitioner impact analysis published via X").when(F.col("id") % 3 == 1, " a hook ")
    return headlines(spark, sf_dir).select("id", text.embedding_text_plain(t, hook).alias("drained"), text.embedding_text_plain(t, hook, o).alias("digest"), text.embedding_text_guarded(t, hook, o).alias("worker"))


@query(f"""
WITH {INBOX} SELECT id FROM inbox WHERE (triage_status IS NULL OR triage_status != 'archived') AND (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY OR {JS('is_cross_spiking')} = 'true') ORDER BY id DESC LIMIT 700
""")
def windowed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last days, and spiking ones of any age; without a window all, without a limit all."""
    return search.limited(search.windowed(inbox(spark, sf_dir), as_of(), 3).orderBy(F.desc("id")), 700).select("id")


@query("""
WITH RECURSIVE s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS points FROM conversations GROUP BY 1),
l AS (SELECT 0 AS list, * FROM s WHERE points > 2 UNION ALL SELECT 1, * FROM s), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY list) = 1),
c AS (SELECT conv_id, turn, CASE WHEN turn > 1 THEN turn // 2 END AS parent, coalesce(text, '') AS body FROM conversations WHERE turn > 0),
r AS (SELECT conv_id, turn, body, lpad(CAST(turn AS VARCHAR), 20, '0') AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.conv_id, c.turn, c.body, r.path || '/' || lpad(CAST(c.turn AS VARCHAR), 20, '0') FROM r JOIN c ON c.conv_id = r.conv_id AND c.parent = r.turn),
t AS (SELECT conv_id, md5(string_agg(body, '|' ORDER BY path)) AS digest, count(*) AS n_comments FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY path) <= 100) GROUP BY 1)
SELECT f.conv_id, f.list, f.points, coalesce(t.n_comments, 0) AS n_comments, t.digest FROM f LEFT JOIN t USING (conv_id)
""")
def forum_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of two lists, the first wins, with up to a hundred comments in reading order as a digest."""
    from ..operators import trees

    c = table(spark, sf_dir, "conversations")
    s = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("points")).withColumn("key", F.col("conv_id").cast("string"))
    lists = [s.where("points > 2").withColumn("list", F.lit(0)), s.withColumn("list", F.lit(1))]
    stories = harvest.first_of_lists(lists, "key", "conv_id")
    comments = c.where("turn > 0").select("conv_id", F.col("turn").alias("id"), F.when(F.col("turn") > 1, F.floor(F.col("turn") / 2)).alias("parent_id"), F.coalesce("text", F.lit("")).alias("body"))
    read = trees.flattened(comments, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("said"))
    digest = F.md5(F.array_join(F.transform("said", lambda x: x["body"]), "|"))
    return stories.join(read, "conv_id", "left").select("conv_id", "list", "points", F.coalesce(F.size("said"), F.lit(0)).cast("long").alias("n_comments"), digest.alias("digest"))


@query(f"""
WITH {INBOX}, d AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'The New York Times' WHEN id % 11 = 1 THEN 'TechCrunch AI' WHEN id % 11 = 2 THEN 'Some Blog (Security)' WHEN id % 11 = 3 THEN '' WHEN id % 11 = 4 THEN '조코딩 채널' WHEN id % 11 = 5 THEN 'News (BBC)' ELSE source_platform END AS raw FROM inbox)
SELECT id, CASE WHEN coalesce(raw, '') = '' THEN 'News' WHEN raw = 'The New York Times' THEN 'NYT' WHEN raw = 'TechCrunch AI' THEN 'TechCrunch' WHEN raw = 'Some Blog (Security)' THEN 'Some Blog' WHEN contains(raw, '조코딩') THEN 'YouTube (조코딩)' WHEN raw = 'News (BBC)' THEN 'BBC' WHEN raw = 'Press (Reuters)' THEN 'Reuters' WHEN raw = 'YouTube (Chan)' THEN 'Chan' WHEN raw = 'Hacker News' THEN 'HN' WHEN raw LIKE 'Reddit%' THEN 'Reddit' ELSE raw END AS shown FROM d
""")
def platform_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of platforms as they are shown: out of brackets, without topics, short where a short name is known."""
    k = F.col("id") % 11
    raw = classify.first_match([(k == n, v) for n, v in enumerate(["The New York Times", "TechCrunch AI", "Some Blog (Security)", "", "조코딩 채널", "News (BBC)"])], None)
    named = F.when(k < 6, raw).otherwise(F.col("source_platform"))
    return inbox(spark, sf_dir).select("id", ib.platform_name(named).alias("shown"))
