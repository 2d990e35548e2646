"""Queries of merges, updates and rewrites, and of the smaller text forms, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, inbox as ib, payload as pl, rules, text, timeslot, url, vector
from ..operators import graph, merge, similarity, vector_index
from ..registry import ORACLE, QUERIES, query
from ..sources import feeds, sinks
from ..sources.tables import table
from ..sources.workspace import scratch
from ..streaming import slots
from .inbox import INBOX, JS, LANG, inbox
from .rulebook import HEADLINES, headlines
from .streams import drained, events as event_stream
from .timeline import AS_OF, as_of

TRACKS = "[" + ", ".join(f"'{t}'" for t in url.TRACKING) + "]"


@query(rf"""
WITH b AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS body, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({TRACKS}, lower(split_part(p, '=', 1))) AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')) AS kept, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
c AS (SELECT page_id, body || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || frag AS plain, body || CASE WHEN len(list_filter(kept, lambda p: NOT contains(lower(split_part(p, '=', 1)), 'page'))) > 0 THEN '?' || array_to_string(list_filter(kept, lambda p: NOT contains(lower(split_part(p, '=', 1)), 'page')), '&') ELSE '' END || frag AS stealth FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(lower(plain)), '^https?://', ''), '^www\.', ''), '/+$', '') AS bare FROM c)
SELECT page_id, bare, stealth, substr(sha256('press:' || CASE WHEN bare = '' THEN 'slug' ELSE bare END), 1, 16) AS hash FROM d
""")
def url_bare_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in lower case without scheme and tracking, without keys that hold a word, and the hash that names a page."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.bare(u).alias("bare"), url.without_tracking(u, "page").alias("stealth"), url.canonical_hash(F.lit("Press"), u, F.lit("slug")).alias("hash"))


def _entity_sql() -> str:
    everything = "lower(title || ' ' || link)"
    found = [f"nullif(regexp_replace(regexp_extract({everything}, 'github\\.com/([\\w\\.-]+/[\\w\\.-]+)', 1), '\\.git$', ''), '')"]
    for p in text.ENTITY_PATTERNS:
        key = f"trim(regexp_replace(regexp_extract({everything}, '{p}', 1), '[-_ ]+', '-', 'g'), '-')"
        found.append(f"CASE WHEN length({key}) >= 3 THEN {key} END")
    word = f"trim(lower(regexp_extract(regexp_replace(title, '{text.ENTITY_PREFIX}', ''), '[a-zA-Z0-9가-힣\\.-]{{3,}}')), '.-')"
    found.append(f"CASE WHEN length({word}) >= 3 AND NOT regexp_matches({word}, '^[0-9]+$') AND {word} NOT IN ('출시', '공개', '발표', '오픈소스', '모델') THEN {word} END")
    return "coalesce(" + ", ".join(found) + ", '')"


KEY_SQL = "array_to_string(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2)[1:4], '-')".format
SET_SQL = "list_distinct(list_filter(string_split(coalesce(nullif({}, ''), 'tech-trend'), '-'), lambda w: w <> ''))".format


@query(rf"""
WITH {HEADLINES}, h AS (SELECT *, CASE id % 4 WHEN 0 THEN 'https://github.com/Own/Repo.git' WHEN 1 THEN 'https://x.org/a' ELSE '' END AS link, {KEY_SQL('title')} AS ka, {KEY_SQL('other')} AS kb FROM headlines),
s AS (SELECT *, {SET_SQL('ka')} AS sa, {SET_SQL('kb')} AS sb FROM h)
SELECT id, {_entity_sql()} AS entity, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9.\-+]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for')))), ' ') AS specific_set,
  coalesce(nullif(ka, ''), 'tech-trend') = coalesce(nullif(kb, ''), 'tech-trend') OR (len(sa) >= 3 AND len(sb) >= 3 AND len(list_intersect(sa, sb)) >= 3 AND len(list_intersect(sa, sb)) >= 0.5 * least(len(sa), len(sb))) AS keys_alike,
  substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 20) AS canonical, CASE WHEN contains(lower(platform), 'github') THEN 'GitHub' WHEN contains(lower(platform), 'hugging') THEN 'HuggingFace' WHEN contains(lower(platform), 'arxiv') OR contains(lower(platform), 'paper') THEN 'ArXiv' WHEN contains(lower(platform), 'hacker') THEN 'HackerNews' WHEN contains(lower(platform), 'geek') THEN 'GeekNews' ELSE 'TechMedia' END AS family,
  title || CASE WHEN id % 3 = 0 THEN '' ELSE ' | Hook: a hook' END || CASE WHEN id % 5 = 0 THEN '' ELSE ' | Summary: ' || substr(other, 1, 300) END AS embedded, regexp_replace(regexp_replace(title, '\b(?i:model)\b', 'Modell', 'g'), '\b(?i:agent)\b', 'Agent*', 'g') AS translated
FROM s
""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity key, specific words, likeness of story keys, canonical key, family, embedded text and translation of titles."""
    t, i = F.col("title"), F.col("id")
    link = F.when(i % 4 == 0, "https://github.com/Own/Repo.git").when(i % 4 == 1, "https://x.org/a").otherwise("")
    return headlines(spark, sf_dir).select(
        "id", text.entity_key(t, link).alias("entity"), F.array_join(F.array_sort(text.specific_tokens(t, ["the", "and", "for"])), " ").alias("specific_set"), text.similar_story_keys(text.story_key(t), text.story_key(F.col("other"))).alias("keys_alike"), text.key_of(t, 20).alias("canonical"), classify.platform_family(F.col("platform")).alias("family"),
        text.embedding_text(t, F.when(i % 3 != 0, "a hook"), F.when(i % 5 != 0, F.col("other"))).alias("embedded"), text.translated(t, {"model": "Modell", "agent": "Agent*"}).alias("translated"),
    )


RAW_TIME = "CASE event_id % 5 WHEN 0 THEN 'Tue, 02 Jan 2024 03:04:05 +0900' WHEN 1 THEN '2024-01-02T03:04:05Z' WHEN 2 THEN '2 Feb 2024 10:00:00 +0000' WHEN 3 THEN 'junk' END"


@query(rf"""
WITH r AS (SELECT event_id, regexp_replace({RAW_TIME}, '^[A-Za-z]{{3,9}}, *', '') AS raw, CASE event_id % 3 WHEN 0 THEN '2026-01-31_case' WHEN 1 THEN 'x2025_02_30' ELSE 'none' END AS case_id FROM events)
SELECT event_id, CASE WHEN raw LIKE '%+0900' THEN '2024-01-01 18:04' WHEN raw LIKE '%Z' THEN '2024-01-02 03:04' WHEN raw LIKE '%+0000' THEN '2024-02-02 10:00' ELSE strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%d %H:%M') END AS parsed,
  try_cast(concat_ws('-', regexp_extract(case_id, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})', 1), regexp_extract(case_id, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})', 2), regexp_extract(case_id, '(\d{{4}})[-_](\d{{2}})[-_](\d{{2}})', 3)) AS DATE) AS case_date FROM r
""")
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of feeds in several formats, with a default, and dates inside ids."""
    i = F.col("event_id")
    case_id = F.when(i % 3 == 0, "2026-01-31_case").when(i % 3 == 1, "x2025_02_30").otherwise("none")
    parsed = timeslot.parsed(F.expr(RAW_TIME), timeslot.RFC_822, as_of().cast("timestamp"))
    utc = F.to_utc_timestamp(parsed, F.current_timezone())
    at = F.when(F.expr(RAW_TIME).isNull() | (F.expr(RAW_TIME) == "junk"), as_of()).otherwise(utc.cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("parsed"), timeslot.case_date(case_id).alias("case_date"))


@query("""
WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS first_id, max(o_totalprice) AS price, bool_or(o_orderstatus = 'F') AS done, min(o_orderdate) AS seen FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, min(o_orderkey) AS first_id, max(o_totalprice) AS price, bool_or(o_orderstatus = 'F') AS done, min(o_orderdate) AS seen FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.first_id, b.first_id) AS first_id, round(greatest(a.price, b.price), 2) AS price, coalesce(a.done, false) OR coalesce(b.done, false) AS done, coalesce(b.seen, a.seen) AS seen FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def full_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full outer merge by key: the old value, the greater, either flag, the new value."""

    def side(condition: str) -> DataFrame:
        o = table(spark, sf_dir, "orders").where(condition)
        return o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("first_id"), F.max("o_totalprice").alias("price"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"), F.min("o_orderdate").alias("seen"))

    out = merge.upsert(side("o_orderkey % 3 <> 0"), side("o_orderkey % 3 <> 1"), ["k"], {"first_id": "old", "price": "greatest", "done": "or", "seen": "new"})
    return out.withColumn("price", F.round("price", 2))


@query("""
SELECT k, md5(arg_max(text, [length(text), new])) AS body FROM (SELECT doc_id // 2 AS k, coalesce(text, '') AS text, doc_id % 2 AS new FROM documents) GROUP BY k
""")
def vault_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two texts with one key the longer stays, the new one at a tie; given as its digest."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 2).alias("new"))
    return merge.longest_wins(d.where("new = 0").drop("new"), d.where("new = 1").drop("new"), "k", "text").select("k", F.md5("text").alias("body"))


@query(f"""
WITH {INBOX}, v AS (SELECT id, CAST(id % 31 AS DOUBLE) AS score, CAST(1 + id % 40 AS INT) AS rank FROM inbox WHERE id % 3 = 0)
SELECT i.id, coalesce(greatest(i.peak_spike_score, v.score), i.peak_spike_score, v.score) AS peak, CASE WHEN v.id IS NULL THEN 20 ELSE least(20, v.rank) END AS best_rank, CASE WHEN v.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE i.updated_at END AS updated_at FROM inbox i LEFT JOIN v ON v.id = i.id
""")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of new scores written over a table: peaks only rise, ranks only improve, touched rows get the time of the update."""
    i = inbox(spark, sf_dir).select("id", "peak_spike_score", "updated_at", F.lit(20).alias("best_rank"))
    v = i.where("id % 3 = 0").select("id", (F.col("id") % 31).cast("double").alias("score"), (1 + F.col("id") % 40).cast("int").alias("rank"))
    both = i.join(v, "id", "left")
    return both.select("id", F.greatest("peak_spike_score", "score").alias("peak"), F.least("best_rank", "rank").alias("best_rank"), F.when(F.col("score").isNotNull(), as_of()).otherwise(F.col("updated_at")).alias("updated_at"))


KOREAN = "(regexp_matches(title, '[가-힣]') OR coalesce(source_platform ILIKE '%daum%' OR source_platform ILIKE '%geeknews%', false))"
HAN = "(regexp_matches(title, '[一-鿿]') AND NOT regexp_matches(title, '[가-힣]'))"
ENGLISH = "(NOT regexp_matches(title, '[가-힣一-鿿]') AND coalesce(source_platform NOT ILIKE '%geeknews%', false))"
AI = JS("ai_enrichment.source_lang")
HAS_AI = "json_extract(payload, '$.ai_enrichment') IS NOT NULL"


@query(f"""
WITH {INBOX} SELECT id, CASE WHEN {HAS_AI} AND {KOREAN} THEN 'KO' WHEN {HAS_AI} AND {HAN} THEN 'ZH' WHEN {HAS_AI} AND {ENGLISH} AND {AI} = 'ko' THEN 'EN' ELSE {AI} END AS enriched, CASE WHEN {KOREAN} AND id % 2 = 0 THEN 'KO' WHEN id % 2 = 0 AND {ENGLISH} THEN 'EN' WHEN id % 2 = 0 THEN 'KO' END AS top FROM inbox
""")
def language_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five repairs of source languages: Korean and Chinese by title and platform, Korean ones that are English after all."""
    p, t, plat = F.col("payload"), F.col("title"), F.col("source_platform")
    sure = lambda c: F.coalesce(c, F.lit(False))
    korean, han = t.rlike("[가-힣]") | sure(plat.ilike("%daum%") | plat.ilike("%geeknews%")), t.rlike("[一-鿿]") & ~t.rlike("[가-힣]")
    english = ~t.rlike("[가-힣一-鿿]") & sure(~plat.ilike("%daum%") & ~plat.ilike("%geeknews%") & ~plat.ilike("%hada.io%") & ~plat.ilike("%naver%"))
    i = inbox(spark, sf_dir).withColumn("payload", F.when(F.col("id") % 2 == 0, pl.with_fields(p, {"source_lang": F.lit("KO")})).otherwise(p))
    has, ai, top = F.get_json_object(p, "$.ai_enrichment").isNotNull(), F.get_json_object(p, "$.ai_enrichment.source_lang"), F.get_json_object(p, "$.source_lang")
    repaired = F.when(has & korean, "KO").when(has & han, "ZH").when(has & english & (ai == "ko"), "EN").otherwise(ai)
    return i.select("id", repaired.alias("enriched"), F.when(top.isNotNull() & korean, "KO").when((top == "KO") & english, "EN").otherwise(top).alias("top"))


AUDIT = f"coalesce(epoch_ms(try_cast({JS('ai_enrichment.enriched_at')} AS TIMESTAMP)), 0)"
SOURCE = f"greatest(coalesce(epoch_ms(try_cast({JS('published_at')} AS TIMESTAMP)), 0), coalesce(epoch_ms(created_at), 0))"
SCORE = f"coalesce(nullif(live_spike_score, 0), nullif(try_cast(nullif({JS('spike_analysis.score')}, '') AS DOUBLE), 0), viral_score, 0)"
COLLECTION = {
    "date-source-desc": "s DESC, inbox_id DESC", "date-source-asc": "s, inbox_id", "date-audit-desc": "a DESC, s DESC, inbox_id DESC", "date-audit-asc": "(a = 0), a, s, inbox_id", "title-asc": "title, inbox_id", "viral-desc": "v DESC, s DESC, inbox_id DESC", "viral-asc": "v, s, inbox_id",
}


def _collection(mode: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = F.col("payload")
        audit = ib.freshest_millis(F.get_json_object(p, "$.ai_enrichment.enriched_at"), F.lit(None).cast("string"))
        source = F.greatest(ib.freshest_millis(F.get_json_object(p, "$.published_at"), F.lit(None).cast("string")), F.coalesce(F.unix_millis(F.col("created_at").cast("timestamp")), F.lit(0)))
        score = F.coalesce(F.nullif("live_spike_score", F.lit(0.0)), F.nullif(ib.number_of(p, "spike_analysis.score"), F.lit(0.0)), "viral_score", F.lit(0.0))
        i = inbox(spark, sf_dir).select("inbox_id", "title", audit.alias("a"), source.alias("s"), score.alias("v"))
        orders = ib.collection_orders()[mode]
        return i.orderBy(*orders).limit(50).select(F.row_number().over(Window.orderBy(*orders)).cast("long").alias("place"), "inbox_id")  # of fifty rows

    run.__doc__ = f"The first fifty items of a shown collection in the order {mode}, ties by id."
    return run


for _mode, _order in COLLECTION.items():
    _name = f"collection_sort_{_mode.replace('-', '_')}"
    QUERIES[_name] = _collection(_mode)
    ORACLE[_name] = f"WITH {INBOX}, c AS (SELECT inbox_id, title, {AUDIT} AS a, {SOURCE} AS s, {SCORE} AS v FROM inbox) SELECT row_number() OVER (ORDER BY {_order}) AS place, inbox_id FROM c ORDER BY {_order} LIMIT 50"


@query(rf"""
WITH {HEADLINES}, e AS (SELECT id, ts, replace(replace(regexp_extract(t, '{rules.ENTITY_PATTERN}', 1), '_', '-'), ' ', '-') AS named, CASE id % 3 WHEN 0 THEN 'big-story-github-repo' WHEN 1 THEN 'other-story' ELSE 'abc' END AS k FROM low),
c AS (SELECT id, ts, CASE WHEN named <> '' THEN named WHEN length(k) > 5 AND length(regexp_replace(lower(k), '{rules.STORY_SUFFIX}', '')) >= 4 THEN regexp_replace(lower(k), '{rules.STORY_SUFFIX}', '') ELSE '' END AS entity FROM e)
SELECT entity, arg_max(id, [epoch_us(ts), -id]) AS hub, count(*) AS n FROM c WHERE entity <> '' GROUP BY 1
""")
def feed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's items under one entity; the newest comes first and stands for it."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "big-story-github-repo").when(i % 3 == 1, "other-story").otherwise("abc")
    c = headlines(spark, sf_dir).select("id", "ts", rules.story_entity(F.col("title"), key).alias("entity")).where("entity != ''")
    return c.groupBy("entity").agg(F.max_by("id", F.struct("ts", -i)).alias("hub"), F.count("*").alias("n"))


@query("""
WITH n AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0), l AS (SELECT DISTINCT 'n' || s_nationkey AS source, 'r' || s_suppkey AS target FROM supplier)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM l) AS links, (SELECT CAST(min(n_nationkey) AS BIGINT) FROM nation WHERE contains(lower(n_name), 'ation_1') OR contains('ation_1', lower(n_name))) AS cluster
""")
def graph_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and links added where they are missing; the first cluster that a keyword names."""
    nation = table(spark, sf_dir, "nation")
    node = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_nationkey")
    nodes = graph.add_missing(node.where("n_nationkey % 2 = 0").select("id"), node.where("n_nationkey % 3 = 0").select("id"), ["id"])
    all_links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("r"), "s_suppkey").alias("target"))
    links = graph.add_missing(all_links.limit(0), all_links, ["source", "target"])
    first = graph.first_matching(nation.select("n_nationkey", F.array("n_name").alias("names")), F.lit("ATION_1"), "names", "n_nationkey")
    return first.select(F.col("n_nationkey").cast("long").alias("cluster")).select(nodes.agg(F.count("*")).scalar().alias("nodes"), links.agg(F.count("*")).scalar().alias("links"), F.col("cluster"))


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) + CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 0 ELSE 0 END AS n, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-10') AS replaced FROM events GROUP BY CAST(ts AS DATE)")
def day_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of days written, one day written again over itself, and read back: other days aren't touched, none is doubled."""
    path = scratch(spark, "days")
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"), F.lit(0).alias("again"))
    sinks.overwrite_partitions(e, path, ["day"])
    sinks.overwrite_partitions(e.where("day = '2024-01-10'").withColumn("again", F.lit(1)), path, ["day"])
    back = spark.read.schema("event_id long, again int, day string").parquet(path)
    return back.groupBy("day").agg(F.count("*").alias("n"), F.sum("again").alias("replaced"))


@query("SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def vault_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended to a vault of compressed JSON lines in two runs, and read back."""
    path, c = scratch(spark, "vault"), table(spark, sf_dir, "conversations")
    for half in (0, 1):
        feeds.append_json_lines(c.where(F.col("conv_id") % 2 == half), path)
    back = feeds.json_lines(spark, path, "conv_id long, turn int, role string, text string")
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("s"))))
    return back.groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(said, lambda x: x["s"]), "|")).alias("digest"))


@query("""
WITH w AS (SELECT unnest(range(0, 4)) AS k), e AS (SELECT user_id, value, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start FROM events, w)
SELECT strftime(window_start, '%Y-%m-%d %H') AS window_start, user_id, count(*) AS n, round(max(value) - min(value), 3) AS delta FROM e GROUP BY ALL
""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-long windows that slide by six hours, over the stream."""
    out = drained(slots.sliding_counts(event_stream(spark, sf_dir), "60 days"), "stream_sliding", "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "user_id", "n", F.round("delta", 3).alias("delta"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event comes twice, without its repeats."""
    e = event_stream(spark, sf_dir)
    out = drained(slots.first_seen(e.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), ["event_id"], "60 days"), "stream_first_seen", "append")
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("""
WITH v AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'VERIFIED_TRUE' WHEN 1 THEN 'MOSTLY_TRUE (partly)' WHEN 2 THEN 'HALF_TRUE' WHEN 3 THEN 'CONFIRMED_FALSE' WHEN 4 THEN 'MISLEADING_GAMED' END AS verdict, c_acctbal AS score FROM customer)
SELECT count(*) AS n, count(*) FILTER (WHERE contains(verdict, 'TRUE')) AS holds, count(*) FILTER (WHERE contains(verdict, 'FALSE')) AS wrong, count(*) FILTER (WHERE verdict LIKE '%MISLEADING%' OR verdict LIKE '%HALF%') AS mixed, count(*) FILTER (WHERE verdict IS NULL) AS open, round(avg(score), 2) AS mean, round(100.0 * count(verdict) / count(*), 1) AS classified_pct FROM v
""")
def verdict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of verdicts by the words in them, and how many have one."""
    k = F.col("c_custkey") % 6
    verdict = classify.first_match([(k == n, v) for n, v in enumerate(["VERIFIED_TRUE", "MOSTLY_TRUE (partly)", "HALF_TRUE", "CONFIRMED_FALSE", "MISLEADING_GAMED"])], None)
    v = table(spark, sf_dir, "customer").select(verdict.alias("verdict"), "c_acctbal")
    w = F.col("verdict")
    return v.agg(F.count("*").alias("n"), F.count_if(w.contains("TRUE")).alias("holds"), F.count_if(w.contains("FALSE")).alias("wrong"), F.count_if(w.contains("MISLEADING") | w.contains("HALF")).alias("mixed"), F.count_if(w.isNull()).alias("open"), F.round(F.avg("c_acctbal"), 2).alias("mean"), F.round(100.0 * F.count("verdict") / F.count("*"), 1).alias("classified_pct"))


RECENT = f"v AS (SELECT *, TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * CAST(vec_id % 50 AS INT) AS seen, vec_id % 9 = 0 AS archived FROM embeddings)"


@query(f"""
WITH {RECENT}, nn AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND NOT b.archived AND b.seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY QUALIFY place <= 5)
SELECT a_id, b_id, round(sim, 4) AS similarity FROM nn WHERE 1 - sim <= 0.8
""")
def knn_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of those that aren't archived and not older than thirty days, then the threshold of distance."""
    e = table(spark, sf_dir, "embeddings")
    live = e.where((F.col("vec_id") % 9 != 0) & (as_of() - F.make_dt_interval((F.col("vec_id") % 50).cast("int")) >= as_of() - F.expr("INTERVAL 30 DAYS")))
    return similarity.knn(live, e.where("vec_id % 100 = 0"), 5).where("1 - similarity <= 0.8").select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))


def recent_days(df: DataFrame, days: int) -> DataFrame:
    """Vectors seen in the last `days` days."""
    return df.where(as_of() - F.make_dt_interval((F.col("vec_id") % 50).cast("int")) >= as_of() - F.expr(f"INTERVAL {days} DAYS"))


@query(f"""
WITH {RECENT}, nn AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM v a, v b WHERE a.seen >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND a.vec_id <> b.vec_id AND NOT b.archived AND b.seen >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY QUALIFY place <= 5)
SELECT a_id, b_id, round(sim, 4) AS similarity FROM nn WHERE 1 - sim <= 0.8
""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the last seven days against those of the last fourteen that aren't archived: exact, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    found = similarity.knn(recent_days(e.where("vec_id % 9 != 0"), 14), recent_days(e, 7), 5)
    return found.where("1 - similarity <= 0.8").select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))


def knn_batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch by the inverted-file index, with as many probes as find 95 % of the true neighbours of a few vectors."""
    e = table(spark, sf_dir, "embeddings")
    live = recent_days(e.where("vec_id % 9 != 0"), 14)
    index = vector_index.build(live)
    found = vector_index.search(index, recent_days(e, 7), 5, vector_index.probes_for(index, live, 5))
    return found.where("1 - similarity <= 0.8").select("a_id", "b_id", F.round("similarity", 4).alias("similarity"))


query()(knn_batch_index)


@query("""
WITH h AS (SELECT label, min(vec_id) AS hub FROM embeddings GROUP BY 1),
p AS (SELECT e.vec_id, h.hub, e.label, list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS sim, ['w' || e.vec_id % 3, 'v' || e.vec_id % 2, 'l'] AS a, ['w' || h.hub % 3, 'v' || h.hub % 2, 'l'] AS b FROM embeddings e JOIN h USING (label) JOIN embeddings x ON x.vec_id = h.hub WHERE e.vec_id <> h.hub),
q AS (SELECT *, len(list_intersect(a, b)) AS common FROM p)
SELECT vec_id, hub, CASE WHEN sim >= 0.3 THEN true WHEN sim < -0.1 THEN false ELSE common / (6 - common) >= 0.4 AND common >= 2 END AS joined FROM q
""")
def safe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a cluster join its hub if they are near, stay out if they are far, and else if their words agree."""
    words = lambda i: F.array(F.concat(F.lit("w"), (i % 3).cast("string")), F.concat(F.lit("v"), (i % 2).cast("string")), F.lit("l"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    hubs = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("hub"))
    both = e.join(hubs, "label").where(F.col("vec_id") != F.col("hub.vec_id"))
    a, b, sim = words(F.col("vec_id")), words(F.col("hub.vec_id")), vector.cosine(F.col("embedding"), F.col("hub.embedding"))
    agree = (text.jaccard(a, b) >= 0.4) & (F.size(F.array_intersect(a, b)) >= 2)
    return both.select("vec_id", F.col("hub.vec_id").alias("hub"), F.when(sim >= 0.3, True).when(sim < -0.1, False).otherwise(agree).alias("joined"))
