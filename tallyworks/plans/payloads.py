"""Queries over semi-structured items. Items are made of events: one text of SQL that both engines read builds the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions import rules, timeslot
from ..functions.classify import first_match, source_axis
from ..operators import ranking, stories
from ..registry import query
from ..sources.tables import table
from .timeline import AS_OF, as_of

PLATFORM = "CASE event_type WHEN 'click' THEN 'GitHub Official' WHEN 'view' THEN 'Hacker News' WHEN 'error' THEN 'YouTube (Chan)' WHEN 'signup' THEN 'Hugging Face Models' ELSE 'Press' END"
TITLE = "CASE event_id % 7 WHEN 0 THEN 'Qwen 2.5 GGUF weights' WHEN 1 THEN 'Court verdict on rocket video' WHEN 2 THEN 'vLLM agent framework' WHEN 3 THEN 'Llama 3.1 instruct' WHEN 4 THEN 'Central bank gold reserve' WHEN 5 THEN 'DeepSeek R1 release demo' ELSE 'Plain note' END"
URL = "'https://' || CASE event_id % 3 WHEN 0 THEN 'github.com/o/r' WHEN 1 THEN 'news.ycombinator.com/item?id=' ELSE 'blog.example.com/p' END || CAST(event_id % 40 AS VARCHAR(20))"
SOURCE_LIST = "CASE WHEN event_id % 4 = 0 THEN '[]' ELSE '[{\"platform\":\"Hacker News\",\"url\":\"https://news.ycombinator.com/item?id=' || CAST(user_id AS VARCHAR(20)) || '\",\"created_at\":\"2024-01-' || CAST(10 + event_id % 9 AS VARCHAR(20)) || '\"}' || CASE WHEN event_id % 4 > 1 THEN ',{\"platform\":\"YouTube (Chan)\",\"url\":\"https://youtu.be/' || CAST(user_id AS VARCHAR(20)) || '\",\"created_at\":\"2024-01-05\"}' ELSE '' END || ']' END"
PAYLOAD = f"'{{\"source_lang\":\"' || CASE event_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN '' ELSE 'en' END || '\",\"is_cross_spiking\":' || CASE WHEN event_id % 9 = 0 THEN 'true' ELSE 'false' END || ',\"score\":' || CAST(event_id % 10 AS VARCHAR(20)) || ',\"sources\":' || {SOURCE_LIST} || '}}'"
ITEMS = f"items AS (SELECT event_id AS id, user_id AS story, ts, value, {PLATFORM} AS platform, {TITLE} AS title, {URL} AS url, {PAYLOAD} AS payload FROM events)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS story", "ts", "value", f"{PLATFORM} AS platform", f"{TITLE} AS title", f"{URL} AS url", f"{PAYLOAD} AS payload")


@query(f"""WITH {ITEMS} SELECT upper(coalesce(nullif(json_extract_string(payload, '$.ai.source_lang'), ''), nullif(json_extract_string(payload, '$.source_lang'), ''), CASE WHEN platform ILIKE '%hacker%' THEN 'en' ELSE 'xx' END)) AS lang, count(*) AS n FROM items GROUP BY 1""")
def language_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("platform").ilike("%hacker%"), "en").otherwise("xx")
    return items(spark, sf_dir).groupBy(F.upper(F.coalesce(pl.path(F.col("payload"), "ai.source_lang", "source_lang"), rule)).alias("lang")).agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS} SELECT id, CAST(json_array_length(payload, '$.sources') AS BIGINT) AS n_sources FROM items WHERE (json_extract_string(payload, '$.is_cross_spiking') = 'true' OR json_array_length(payload, '$.sources') > 1) AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND (json_extract(payload, '$.score') IS NULL OR CAST(json_extract_string(payload, '$.score') AS DOUBLE) >= 3)""")
def cross_spike_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("payload")
    n = pl.array_length(p, "sources")
    crossing = (F.get_json_object(p, "$.is_cross_spiking") == "true") | (n > 1)
    score = F.get_json_object(p, "$.score").try_cast("double")
    return items(spark, sf_dir).where(crossing & (F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")) & (score.isNull() | (score >= 3))).select("id", n.cast("long").alias("n_sources"))


@query(f"""
WITH {ITEMS}, s AS (SELECT id, platform, url, unnest(from_json(json_extract(payload, '$.sources'), '[{{"platform":"VARCHAR","url":"VARCHAR","created_at":"VARCHAR"}}]')) AS src FROM items),
a AS (SELECT id, src.platform AS p, src.url AS u, src.created_at AS c FROM s WHERE NOT (platform = 'YouTube (Chan)' AND src.platform = s.platform AND src.url <> s.url) UNION ALL SELECT id, platform, url, strftime(ts, '%Y-%m-%d') FROM items WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = items.id AND src.url = items.url)),
x AS (SELECT id, p, c, CASE WHEN p ILIKE '%github%' OR p ILIKE '%hugging%' OR u ILIKE '%github.com%' OR p ILIKE '%model%' THEN 'CODE' WHEN p ILIKE '%hacker news%' OR p ILIKE '%youtube%' OR u ILIKE '%ycombinator.com%' OR u ILIKE '%youtu.be%' THEN 'COMMUNITY' ELSE 'PRESS' END AS axis FROM a)
SELECT id, count(*) AS n_sources, count(DISTINCT axis) AS n_axes, count(DISTINCT lower(p)) AS n_platforms, min(c) AS first_seen, max(c) AS last_seen, count(*) FILTER (WHERE axis = 'COMMUNITY') AS community FROM x GROUP BY id
""")
def source_array_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the nested sources, the item itself among them, by array functions: no explode, no shuffle."""
    s = pl.healed_sources(F.col("payload"), F.col("platform"), F.col("url"), F.col("title"), F.date_format("ts", "yyyy-MM-dd"))
    axes = F.transform("s", lambda x: source_axis(x["platform"], x["url"]))
    times = F.transform("s", lambda x: x["created_at"])
    distinct = lambda a: F.size(F.array_distinct(a)).cast("long")
    return items(spark, sf_dir).select("id", s.alias("s")).select("id", F.size("s").cast("long").alias("n_sources"), distinct(axes).alias("n_axes"), distinct(F.transform("s", lambda x: F.lower(x["platform"]))).alias("n_platforms"), F.array_min(times).alias("first_seen"), F.array_max(times).alias("last_seen"), F.size(F.filter(axes, lambda a: a == "COMMUNITY")).cast("long").alias("community"))


@query(f"""
WITH {ITEMS} SELECT id, CASE WHEN url LIKE '%ycombinator%' THEN 'EN' ELSE nullif(json_extract_string(payload, '$.source_lang'), '') END AS lang, CASE WHEN id % 2 = 0 THEN 'yes' END AS enriched, json_extract_string(payload, '$.score') AS score, false AS has_sources FROM items
""")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields set, merged and removed in the JSON text, then read back."""
    p = F.col("payload")
    lang = F.when(F.col("url").contains("ycombinator"), "EN").otherwise(F.get_json_object(p, "$.source_lang"))
    edited = pl.with_fields(pl.without_fields(p, ["sources"]), {"source_lang": lang, "enriched": F.when(F.col("id") % 2 == 0, "yes").otherwise("")})
    return items(spark, sf_dir).select("id", edited.alias("e")).select("id", pl.path(F.col("e"), "source_lang").alias("lang"), pl.path(F.col("e"), "enriched").alias("enriched"), F.get_json_object("e", "$.score").alias("score"), pl.has_key(F.col("e"), "sources").alias("has_sources"))


@query(r"""
SELECT page_id, starts_with(trim(url), 'http') AND regexp_replace(trim(url), '/+$', '') NOT IN ('https://news.ycombinator.com', 'https://github.com', 'https://huggingface.co') AND (NOT contains(url, 'github.com') OR regexp_matches(url, 'github\.com/[\w\.-]+/[\w\.-]+')) AS valid FROM pages
""")
def candidate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", rules.valid_candidate(F.col("url")).alias("valid"))


@query(f"""
WITH {ITEMS}, known AS (SELECT url, title, min(id) AS id FROM items WHERE id % 11 = 0 GROUP BY ALL), u AS (SELECT url, min(id) AS id FROM known GROUP BY 1), t AS (SELECT title, min(id) AS id FROM known GROUP BY 1)
SELECT count(*) AS n, count(u.id) AS by_url, count(coalesce(u.id, t.id)) AS found, CAST(sum(coalesce(u.id, t.id)) AS BIGINT) AS ids FROM items i LEFT JOIN u ON i.url = u.url LEFT JOIN t ON i.title = t.title WHERE i.id % 11 <> 0
""")
def lookup_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL first, then title."""
    i = items(spark, sf_dir)
    known = i.where("id % 11 = 0").select("url", "title", F.col("id").alias("known_id"))
    rest = i.where("id % 11 <> 0").select("id", "url", "title")
    by_url = known.groupBy("url").agg(F.min("known_id").alias("u"))
    out = stories.lookup_any(rest, known, ["url", "title"], "known_id").join(by_url, "url", "left")
    return out.agg(F.count("*").alias("n"), F.count("u").alias("by_url"), F.count("known_id").alias("found"), F.sum("known_id").alias("ids"))


@query(f"""
WITH {ITEMS}, c AS (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 26 HOUR AND value > 200) AS n FROM items)
SELECT id, platform FROM items, c WHERE (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 26 HOUR AND value > 200) OR (n < 15 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 26 HOUR)
""")
def fresh_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = F.col("ts") >= as_of() - F.expr("INTERVAL 26 HOURS")
    return stories.gated(items(spark, sf_dir), recent & (F.col("value") > 200), recent, 15).select("id", "platform")


@query("""
WITH m AS (SELECT user_id, date_trunc('month', ts - INTERVAL 15 DAY) AS m, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, strftime(max(m), '%Y-%m') AS month, arg_max(n, m) AS invocations, round(arg_max(n, m) * CAST(0.025 AS DOUBLE), 3) AS cpu_seconds FROM m GROUP BY 1
""")
def monthly_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that start again with each month: what the last month of each item counts."""
    m = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("month", F.col("ts") - F.expr("INTERVAL 15 DAYS")).alias("m")).agg(F.count("*").alias("n"))
    last = m.groupBy("user_id").agg(F.max("m").alias("m"), F.max_by("n", "m").alias("invocations"))
    return last.select("user_id", F.date_format("m", "yyyy-MM").alias("month"), "invocations", F.round(F.col("invocations") * 0.025, 3).alias("cpu_seconds"))


@query("""
WITH d AS (SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-31') AS today, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS yesterday FROM events GROUP BY 1)
SELECT event_type, today, yesterday, CASE WHEN today = 0 THEN yesterday ELSE today END AS shown, today = 0 AS is_baseline FROM d
""")
def yesterday_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    d = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(day == F.lit("2024-01-31").cast("date")).alias("today"), F.count_if(day == F.lit("2024-01-30").cast("date")).alias("yesterday"))
    return d.select("*", F.when(F.col("today") == 0, F.col("yesterday")).otherwise(F.col("today")).alias("shown"), (F.col("today") == 0).alias("is_baseline"))


@query("""
WITH l AS (SELECT ts + INTERVAL 9 HOUR AS t FROM events)
SELECT CASE WHEN hour(t) = 23 AND minute(t) >= 25 THEN '23:30' WHEN hour(t) < 6 THEN '00:17' WHEN hour(t) < 12 THEN '06:17' WHEN hour(t) < 18 THEN '12:17' ELSE '18:17' END AS run, count(*) AS n, count(*) FILTER (WHERE CAST(t AS DATE) = DATE '2024-01-15') AS one_day FROM l GROUP BY 1
""")
def run_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeslot.shifted(F.col("ts"))
    return table(spark, sf_dir, "events").groupBy(rules.run_slot(t, F.lit("")).alias("run")).agg(F.count("*").alias("n"), F.count_if(F.to_date(t) == F.lit("2024-01-15").cast("date")).alias("one_day"))


@query("""
WITH o AS (SELECT user_id, arg_min(value, [epoch_us(ts), event_id]) AS initial, arg_max(value, [epoch_us(ts), event_id]) AS latest FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1), n AS (SELECT user_id, arg_max(value, [epoch_us(ts), event_id]) AS live FROM events GROUP BY 1)
SELECT user_id, round(live - latest, 3) AS diff, round(live - initial, 3) AS delta, round((live - initial) / greatest(1.0, initial) * 100, 3) AS growth_pct, (live - initial) >= 50 OR (live - initial) / greatest(1.0, initial) * 100 >= 30 AS is_spiking FROM o JOIN n USING (user_id) WHERE live <> latest
""")
def live_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live values against what is stored: change since the latest and since the first."""
    e = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    old = e.where(F.col("ts") < F.lit("2024-01-29").cast("timestamp_ntz")).groupBy("user_id").agg(F.min_by("value", at).alias("initial"), F.max_by("value", at).alias("latest"))
    both = old.join(e.groupBy("user_id").agg(F.max_by("value", at).alias("live")), "user_id").where("live != latest")
    delta = F.col("live") - F.col("initial")
    growth = delta / F.greatest(F.lit(1.0), F.col("initial")) * 100
    return both.select("user_id", F.round(F.col("live") - F.col("latest"), 3).alias("diff"), F.round(delta, 3).alias("delta"), F.round(growth, 3).alias("growth_pct"), ((delta >= 50) | (growth >= 30)).alias("is_spiking"))


@query(f"""WITH {ITEMS} SELECT id, platform, title FROM items ORDER BY id DESC LIMIT 600""")
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", "platform", "title").orderBy(F.desc("id")).limit(600)


@query("""SELECT event_id, md5('2024-01-31' || CAST(event_id AS VARCHAR)) AS seed FROM events ORDER BY seed LIMIT 5""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle that a date seeds; the first five."""
    seed = F.md5(F.concat(F.lit("2024-01-31"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", seed.alias("seed")).orderBy("seed").limit(5)


@query(f"""
WITH {ITEMS} SELECT platform, count(*) AS items, round(avg(value), 3) AS latency, CASE WHEN count(*) FILTER (WHERE value > 200) * 10 > count(*) THEN 'SLOW' ELSE 'OK' END AS status FROM items WHERE (title ILIKE '%agent%' OR title ILIKE '%gguf%' OR title LIKE '%판결%') AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY 1
""")
def harvest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent items that pass the keyword gate, by source."""
    i = items(spark, sf_dir).where(F.col("title").rlike("(?i)agent|gguf|판결") & (F.col("ts") >= as_of() - F.expr("INTERVAL 14 DAYS")))
    slow = F.count_if(F.col("value") > 200) * 10 > F.count("*")
    return i.groupBy("platform").agg(F.count("*").alias("items"), F.round(F.avg("value"), 3).alias("latency"), first_match([(slow, "SLOW")], "OK").alias("status"))


@query(f"""
WITH {ITEMS}, r AS (SELECT id, story, row_number() OVER (PARTITION BY story ORDER BY id) AS pos FROM items), a AS (SELECT id + CASE WHEN id % 10 = 0 THEN 0 ELSE 1000000000 END AS rid, story, row_number() OVER (PARTITION BY story ORDER BY id) AS pos, value FROM items)
SELECT r.id, round(coalesce(x.value, y.value), 3) AS value, x.rid IS NOT NULL AS by_id FROM r LEFT JOIN a x ON r.id = x.rid LEFT JOIN a y ON r.story = y.story AND r.pos = y.pos
""")
def result_by_id_or_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers joined to requests by id, else by place within their batch."""
    i = items(spark, sf_dir).select("id", "story", "value")
    numbered = ranking.top_k(i, ["story"], [F.col("id")], 1 << 30, "pos")
    answers = numbered.select((F.col("id") + F.when(F.col("id") % 10 == 0, 0).otherwise(1_000_000_000)).alias("rid"), "story", "pos", "value")
    by_id = answers.select(F.col("rid").alias("id"), F.col("value").alias("v1"))
    by_place = answers.select("story", "pos", F.col("value").alias("v2"))
    out = numbered.select("id", "story", "pos").join(by_id, "id", "left").join(by_place, ["story", "pos"], "left")
    return out.select("id", F.round(F.coalesce("v1", "v2"), 3).alias("value"), F.col("v1").isNotNull().alias("by_id"))
