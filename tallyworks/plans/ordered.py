"""Queries that need more than one pass or a table of their own: folds, deep pages, postings, horizons, stored merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dictionary, folding, horizons, merge, postings, search
from ..registry import query
from ..sources import stored
from ..sources.tables import table
from ..sources.workspace import scratch, written
from . import streams
from .timeline import events

PLATFORMS = {"R": "GitHub Trending", "A": "Reddit r/parts"}


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS hub, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS place, CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN 'https://arxiv.org/abs/' || l_partkey ELSE 'https://x.org/' || l_partkey % 300 END AS url,
  CASE l_returnflag WHEN 'R' THEN 'GitHub Trending' WHEN 'A' THEN 'Reddit r/parts' ELSE 'Site ' || l_orderkey % 40 END AS platform FROM lineitem),
c AS (SELECT *, CASE WHEN contains(lower(platform), 'github') THEN 'github' WHEN contains(lower(platform), 'reddit') THEN 'reddit' WHEN contains(url, 'arxiv.org') THEN 'arxiv' ELSE lower(platform) END AS canonical,
  row_number() OVER (PARTITION BY hub ORDER BY place) AS i FROM l),
f AS (SELECT hub, i, place, [url] AS urls, [canonical] AS platforms, true AS kept FROM c WHERE i = 1
  UNION ALL SELECT c.hub, c.i, c.place, CASE WHEN c.url <> '' AND NOT list_contains(urls, c.url) AND NOT list_contains(platforms, c.canonical) THEN list_append(urls, c.url) ELSE urls END,
    CASE WHEN c.url <> '' AND NOT list_contains(urls, c.url) AND NOT list_contains(platforms, c.canonical) THEN list_append(platforms, c.canonical) ELSE platforms END,
    c.url <> '' AND NOT list_contains(urls, c.url) AND NOT list_contains(platforms, c.canonical) FROM f JOIN c ON c.hub = f.hub AND c.i = f.i + 1)
SELECT f.hub, f.place, c.url, c.platform FROM f JOIN c ON c.hub = f.hub AND c.i = f.i WHERE kept
""")
def source_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sources of their supplier's story, hundreds each: the first is the primary's, others stay if URL and platform are new."""
    k = F.col("l_partkey").cast("string")
    url = F.when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("https://arxiv.org/abs/"), k)).otherwise(F.concat(F.lit("https://x.org/"), (F.col("l_partkey") % 300).cast("string")))
    platform = F.coalesce(*[F.when(F.col("l_returnflag") == flag, name) for flag, name in PLATFORMS.items()], F.concat(F.lit("Site "), (F.col("l_orderkey") % 40).cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("hub"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("place"), url.alias("url"), platform.alias("platform")).distinct()
    first = rows.groupBy("hub").agg(F.min("place").alias("first"))
    sources = rows.join(first, "hub").select("hub", "place", "url", "platform", (F.col("place") == F.col("first")).alias("is_primary"))
    return folding.folded_sources(sources, "hub", "place").select("hub", "place", "url", "platform")


@query("""
WITH e AS (SELECT user_id, event_type, max(ts) AS seen, arg_max(value, [epoch_us(ts), event_id]) AS metric, max(CASE WHEN value > 100 THEN 'rich ' || event_type END) AS enrichment FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL),
a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.enrichment, b.enrichment) AS enrichment, round(CASE WHEN a.user_id IS NULL OR b.metric IS NOT NULL AND b.seen > a.seen THEN b.metric ELSE a.metric END, 3) AS metric FROM a FULL OUTER JOIN b ON a.user_id = b.user_id
""")
def local_remote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores of one item: what the local one lacks is filled, its metric is replaced where the remote row is newer."""
    kept = F.max(F.when(F.col("value") > 100, F.concat(F.lit("rich "), F.col("event_type")))).alias("enrichment")
    e = events(spark, sf_dir).where("event_type in ('click', 'purchase')")
    e = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"), F.max_by("value", F.struct("ts", "event_id")).alias("metric"), kept)
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "seen", "metric", "enrichment")
    out = merge.upsert(side("click"), side("purchase"), ["user_id"], {"enrichment": "old", "metric": "newer:seen"})
    return out.withColumn("metric", F.round("metric", 3))


@query("""
WITH t AS (SELECT count(*) AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice, 2) AS price, total, CAST(ceil(total / 10) AS BIGINT) AS total_pages, 50000 < total AS has_more
FROM lineitem, t ORDER BY l_returnflag DESC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10 OFFSET 49990
""")
def page_5000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 5,000 of all line items, by a key of few values, then one of many."""
    keys = [search.Key("l_returnflag", True), search.Key("l_extendedprice", True), search.Key("l_orderkey"), search.Key("l_linenumber")]
    found = search.deep_page(table(spark, sf_dir, "lineitem").select(*[k.column for k in keys]), keys, 10, 5000)
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("l_extendedprice", 2).alias("price"), "total", "total_pages", "has_more")


SEARCHES = ["onthe EA", "ouvipa", "worthless", "heit", "ñó", "the ndwhst", "x z", "queaux OU", "no such words at all", "e"]


@query(f"""
SELECT q AS query, doc_id FROM documents, (SELECT unnest({SEARCHES}) AS q) WHERE len(list_filter(string_split(lower(q), ' '), lambda t: NOT contains(lower(text), t))) = 0
""")
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several search texts over all documents by trigram postings: each word somewhere in the text, short words and hot ones too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return postings.search_all(postings.build(d, "doc_id", ["text"]), d, "doc_id", ["text"], SEARCHES)


HORIZONS_SQL = f"""
WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS pane, value FROM events)
SELECT DISTINCT user_id, pane, {", ".join(f"count(*) OVER w{h} AS n_{h}h, round(sum(value) OVER w{h}, 2) AS total_{h}h, round(max(value) OVER w{h} - min(value) OVER w{h}, 3) AS delta_{h}h" for h in horizons.HORIZON_HOURS)}
FROM e WINDOW {", ".join(f"w{h} AS (PARTITION BY user_id ORDER BY pane RANGE BETWEEN {h // 6 - 1} PRECEDING AND CURRENT ROW)" for h in horizons.HORIZON_HOURS)}
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 2 if c.startswith("total") else 3) for c in df.columns if c.startswith(("total", "delta"))})


@query(HORIZONS_SQL)
def horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven horizons of each user, from twelve hours to thirty days, in one pass over six-hour panes."""
    return _rounded(horizons.horizons(horizons.panes(events(spark, sf_dir), "user_id", "ts", "value"), "user_id"))


@query(HORIZONS_SQL)
def stream_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the stream: its state is the panes, the horizons are made of them when it has been drained."""
    streamed = horizons.panes(streams.events(spark, sf_dir).withWatermark("ts", "60 days"), "user_id", "ts", "value")
    return _rounded(horizons.horizons(streams.drained(streamed, "stream_panes", "complete"), "user_id"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status, o_orderkey % 5 = 0 AS rich, o_orderkey % 3 AS part FROM orders),
a AS (SELECT * FROM o WHERE part <> 2), b AS (SELECT k, price + 1 AS price, status, k % 10 = 0 AS rich, part FROM o WHERE part <> 0)
SELECT coalesce(a.k, b.k) AS k, round(CASE WHEN b.k IS NULL THEN a.price ELSE greatest(coalesce(a.price, b.price), b.price) END, 2) AS price,
  CASE WHEN a.rich OR b.rich THEN 'model ' || CASE WHEN b.rich THEN 'b' ELSE 'a' END END AS enrichment,
  CASE WHEN b.k IS NULL OR a.rich AND NOT b.rich THEN 'old ' || a.status ELSE 'new ' || b.status END AS title_ko,
  CASE WHEN b.k IS NULL THEN 1 ELSE 2 END AS version
FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a table, others merged into it twice, read back: enrichment inside the payload stays, the greater price counts."""

    def side(df: DataFrame, name: str, version: int, rich: F.Column) -> DataFrame:
        title, model = F.concat(F.lit(f"{name} "), "o_orderstatus"), F.concat(F.lit("model "), F.lit("a" if version == 1 else "b"))
        enrichment = F.when(rich, F.struct(model.alias("by")))
        body = F.to_json(F.struct(title.alias("title_ko"), F.lit(version).alias("version"), enrichment.alias("ai_enrichment")))
        return df.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + version - 1).alias("price"), body.alias("payload"))

    o, path, schema = table(spark, sf_dir, "orders"), scratch(spark, "stored"), "k long, price double, payload string"
    stored.create(side(o.where("o_orderkey % 3 <> 2"), "old", 1, F.col("o_orderkey") % 5 == 0), path, "k")
    new = side(o.where("o_orderkey % 3 <> 0"), "new", 2, F.col("o_orderkey") % 10 == 0)
    for _ in range(2):
        stored.merge_into(path, schema, new, "k", {"price": "greatest"}, "payload")
    at = lambda p: F.get_json_object("payload", f"$.{p}")
    return stored.read(spark, path, schema).select("k", F.round("price", 2).alias("price"), at("ai_enrichment.by").alias("enrichment"), at("title_ko").alias("title_ko"), at("version").cast("int").alias("version"))


WORDS_SQL = "w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[.,|]', ' ', 'g'), ' ')) AS word FROM benchmark) WHERE length(word) >= 5)"


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary as a table: the longer words of all benchmark items."""
    said = F.regexp_replace(F.lower("text"), "[.,|]", " ")
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split(said, " ")).alias("word")).where(F.length("word") >= 5).distinct()


@query(f"""
WITH {WORDS_SQL}, m AS (SELECT doc_id, word FROM documents JOIN w ON contains(lower(text), word)), s AS (SELECT doc_id, substr(word, 1, 2) AS entry, CAST(sum(length(word)) AS BIGINT) AS score FROM m GROUP BY ALL),
b AS (SELECT doc_id, entry, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, entry) = 1),
k AS (SELECT doc_id, count(*) AS n_words, string_agg(DISTINCT 'd' || length(word) % 5, ',' ORDER BY 'd' || length(word) % 5) AS domains FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(domains, 'general') AS domains, CASE WHEN score >= 20 THEN entry END AS entry, CASE WHEN score >= 20 THEN score END AS score FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN b ON b.doc_id = d.doc_id
""")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the dictionary: its words in each, their domains, and the entry that they weigh most for."""
    d, w = table(spark, sf_dir, "documents").select("doc_id", "text"), keyword_table(spark, sf_dir)
    found = written(dictionary.matches(d, w, "doc_id", "text"), "dictionary-matches")
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("d"), (F.length("word") % 5).cast("string")))), ",").alias("domains"))
    scored = found.groupBy("doc_id", F.substring("word", 1, 2).alias("entry")).agg(F.sum(F.length("word")).alias("score"))
    best = scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "entry")).alias("b")).where("b.less <= -20")
    out = d.select("doc_id").join(per, "doc_id", "left").join(best, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("domains", F.lit("general")).alias("domains"), F.col("b.entry").alias("entry"), (-F.col("b.less")).alias("score"))
