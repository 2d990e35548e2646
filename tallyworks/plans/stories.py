"""Queries over documents, pages and embeddings: URLs, titles, duplicates, neighbours, stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text, url
from ..operators import first_match, similarity, trees
from ..registry import query
from ..sources.tables import table

HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
PATH = r"regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '')"
PAIRS = r"list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '')"


@query(rf"""
WITH c AS (SELECT page_id, {HOST} AS host, {PATH} AS path, list_sort(list_filter({PAIRS}, lambda p: NOT (starts_with(lower(split_part(p, '=', 1)), 'utm_') OR starts_with(lower(split_part(p, '=', 1)), 'ref') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'source', 's')) AND contains(p, '=') AND split_part(p, '=', -1) <> '')) AS q FROM pages),
u AS (SELECT page_id, 'https://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c)
SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM u GROUP BY 1
""")
def url_canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by canonical URL; the first page of each."""
    return table(spark, sf_dir, "pages").groupBy(url.canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(r"""
SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '/+$', '')) AS fingerprint FROM pages
""")
def url_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.fingerprint(F.col("url")).alias("fingerprint"))


@query(rf"""
WITH k AS (SELECT page_id, url, list_filter({PAIRS}, lambda p: NOT (starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN ('ref', 'ref_src', 'ref_url', 'source', 'fbclid', 'gclid', 'msclkid', 'twclid', 'si', 'spm', 'igshid', 'yclid', 'mc_cid', 'mc_eid', 'aff', 'affiliate'))) AS q FROM pages)
SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) AS clean FROM k
""")
def url_without_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.without_tracking(F.col("url")).alias("clean"))


@query("""
SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS n_sources FROM documents GROUP BY text HAVING count(*) > 1
""")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, grouped by digest so that texts themselves aren't shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("n_sources")).where("n > 1")


TITLES = r"""
t AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[^a-zA-Z0-9가-힣\s]', ' ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> ''))) AS s FROM documents),
c AS (SELECT s, min(doc_id) AS id FROM t WHERE len(s) > 0 GROUP BY s)
"""


def first_line() -> Column:
    return F.split_part(F.col("text"), F.lit("\n"), F.lit(1))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.title_tokens(first_line()).alias("tokens"))


@query(f"""
WITH {TITLES}, e AS (SELECT id, len(s) AS n, unnest(s) AS w FROM c), j AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT a_id, b_id, round(k / (na + nb - k), 4) AS similarity FROM j WHERE k / (na + nb - k) >= 0.7
""")
def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different first lines, as token sets, with Jaccard similarity of 0.7 or more; one document stands for each set."""
    return similarity.jaccard_pairs(titles(spark, sf_dir), "doc_id", "tokens", 0.7).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {TITLES} SELECT t.doc_id, c.id AS class_id FROM t JOIN c ON t.s = c.s")
def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership for title_jaccard_pairs: which document stands for each token set."""
    t = titles(spark, sf_dir).select("doc_id", F.array_sort("tokens").alias("s")).where(F.size("s") > 0)
    return t.join(t.groupBy("s").agg(F.min("doc_id").alias("class_id")), "s").select("doc_id", "class_id")


KNN = """
nn AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY place <= 5)
"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, searched against all."""
    e = table(spark, sf_dir, "embeddings")
    return similarity.knn(e, e.where("vec_id % 100 = 0"), 5)


@query(f"WITH {KNN} SELECT a_id, b_id, round(sim, 4) AS similarity, place FROM nn WHERE sim >= 0.2")
def knn_top5_then_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest first, then the threshold: no sixth takes the place of one that fails."""
    return neighbours(spark, sf_dir).where("similarity >= 0.2").select("a_id", "b_id", F.round("similarity", 4).alias("similarity"), F.col("rank_position").cast("long").alias("place"))


@query(f"""
WITH {KNN}, p AS (SELECT nn.*, x.label AS la, y.label AS lb, a_id % 7 AS va, b_id % 7 AS vb FROM nn JOIN embeddings x ON x.vec_id = a_id JOIN embeddings y ON y.vec_id = b_id)
SELECT a_id, b_id, CASE WHEN sim < 0.22 THEN 'BELOW_THRESHOLD' WHEN va = 1 AND vb = 2 THEN 'REJECTED_VERSION_CONFLICT' WHEN la = lb AND abs(va - vb) < 2 THEN 'REJECTED_SAME_PLATFORM_LOW_SPECIFIC_TOKENS' WHEN sim >= 0.26 THEN 'VECTOR_HIGH' WHEN la <> lb THEN 'REJECTED_AMBIGUOUS_LOW_OVERLAP' ELSE 'TOKEN_OVERLAP' END AS decision FROM p
""")
def pair_decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    p = neighbours(spark, sf_dir)
    for side in ("a", "b"):
        p = p.join(e.select(F.col("vec_id").alias(f"{side}_id"), F.col("label").alias(f"l{side}"), (F.col("vec_id") % 7).alias(f"v{side}")), f"{side}_id")
    same, no = F.col("la") == F.col("lb"), F.lit(False)
    specific = F.when(same & (F.abs(F.col("va") - F.col("vb")) < 2), 1).when(~same, 1).otherwise(2)
    made = similarity.decision(F.col("similarity"), F.when(same, 2).otherwise(1), specific, same, no, (F.col("va") == 1) & (F.col("vb") == 2), no, no, no, 0.22, 0.26)
    return p.select("a_id", "b_id", made.alias("decision"))


@query(f"""
WITH RECURSIVE {KNN}, e AS (SELECT a_id AS u, b_id AS v FROM nn WHERE sim >= 0.2 UNION SELECT b_id, a_id FROM nn WHERE sim >= 0.2),
r(u, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u)
SELECT u AS node, min(root) AS root FROM r GROUP BY u
""")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs above the threshold merged; the smallest id of a component is its hub."""
    return similarity.components(neighbours(spark, sf_dir).where("similarity >= 0.2").select("a_id", "b_id"))


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'KO' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'JA' WHEN regexp_matches(text, '[一-鿿]') THEN 'ZH' ELSE 'EN' END AS script, lang <> 'en' AND regexp_matches(text, '[äöüßéèêñóí]') AS accented FROM documents
""")
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.language(F.col("text")).alias("script"), ((F.col("lang") != "en") & F.col("text").rlike("[äöüßéèêñóí]")).alias("accented"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<(br|/?p|/?div|/?li|/?h[1-6]|/?tr)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM b)
SELECT page_id, substring(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 180) AS snippet FROM c
""")
def html_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.snippet(F.col("html")).alias("snippet"))


DOMAINS = {"infra": ["thereon", "ation", "keit"], "media": ["tion", "mente"], "money": ["eaux", "ciónga"]}


@query("""
WITH k AS (SELECT * FROM (VALUES ('infra', 'thereon'), ('infra', 'ation'), ('infra', 'keit'), ('media', 'tion'), ('media', 'mente'), ('money', 'eaux'), ('money', 'ciónga')) v(domain, word)),
m AS (SELECT DISTINCT doc_id, domain FROM documents JOIN k ON contains(lower(text), word))
SELECT d.doc_id, coalesce(string_agg(domain, ',' ORDER BY domain), 'general') AS domains FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
""")
def persona_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains one of whose keywords a text holds. The keywords are configuration: one expression, no join."""
    low = F.lower("text")
    found = F.concat_ws(",", *[F.when(classify.any_of(low, words), F.lit(domain)) for domain, words in DOMAINS.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(found, F.lit("")), F.lit("general")).alias("domains"))


DOSSIERS = [("d1", "thereon", "eding"), ("d2", "eaux", "ment"), ("d3", "keit", "schen"), ("d4", "ción", "mente")]


@query("""
WITH d AS (SELECT * FROM (VALUES (1, 'd1', 'thereon', 'eding'), (2, 'd2', 'eaux', 'ment'), (3, 'd3', 'keit', 'schen'), (4, 'd4', 'ción', 'mente')) v(i, id, name, tag)),
s AS (SELECT doc_id, i, id, CASE WHEN contains(lower(text), name) THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), tag) THEN 2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS score FROM documents, d)
SELECT doc_id, id AS dossier, CAST(score AS BIGINT) AS score FROM s WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1
""")
def best_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted best match of each text, four points at least; of equal ones the first listed."""
    low = F.lower("text")

    def scored(i: int, name: str, word: str, tag: str) -> Column:
        points = F.when(low.contains(word), 5).otherwise(0) + F.when(low.contains(tag), 2).otherwise(0) + F.when(F.col("n_chars") > 2000, 1).otherwise(0)
        return F.struct(points.cast("long").alias("score"), F.lit(-i).alias("i"), F.lit(name).alias("dossier"))

    best = F.greatest(*[scored(i, *d) for i, d in enumerate(DOSSIERS)])
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).select("doc_id", "b.dossier", "b.score").where("score >= 4")


@query(r"""
SELECT doc_id, substring(regexp_replace(regexp_replace(lower(trim(string_split(text, chr(10))[1])), '[^a-z0-9_äöüßéèêàñóíáúç\s-]', '', 'g'), '[\s_-]+', '_', 'g'), 1, 45) AS slug,
  coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2)[1:4], '-'), ''), 'tech-trend') AS story_key FROM documents
""")
def slug_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = first_line()
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(head).alias("slug"), text.story_key(head).alias("story_key"))


@query("""
WITH k AS (SELECT doc_id, source, n_chars, coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2)[1:4], '-'), ''), 'tech-trend') AS story FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY story, source ORDER BY doc_id) AS r FROM k)
SELECT story, min(doc_id) AS hub, count(*) AS n, count(*) FILTER (WHERE r = 1) AS n_platforms, string_agg(CASE WHEN r = 1 THEN source END, ',' ORDER BY source) AS platforms, max(n_chars) AS longest FROM p GROUP BY story HAVING count(*) > 1
""")
def story_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one story under their hub, each platform once."""
    k = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", text.story_key(first_line()).alias("story"))
    platforms = F.array_sort(F.collect_set("source"))
    return k.groupBy("story").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n"), F.size(platforms).cast("long").alias("n_platforms"), F.array_join(platforms, ",").alias("platforms"), F.max("n_chars").alias("longest")).where("n > 1")


@query("""
WITH f AS (SELECT p_partkey, p_brand, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 0 ELSE 1 END, p_partkey) AS r FROM part)
SELECT p_partkey, p_brand, CASE WHEN r = 1 THEN 'promoted' ELSE 'archived' END AS status FROM f
""")
def family_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative of a family is promoted, the others archived. The representative is an aggregate, joined back."""
    p = table(spark, sf_dir, "part")
    order = F.struct(F.when(F.col("p_name").contains("ring") | F.col("p_name").contains("bolt"), 0).otherwise(1).alias("late"), "p_partkey")
    best = p.groupBy("p_brand").agg(F.min(order).alias("b")).select("p_brand", F.col("b.p_partkey").alias("best"))
    return p.join(best, "p_brand").select("p_partkey", "p_brand", F.when(F.col("p_partkey") == F.col("best"), "promoted").otherwise("archived").alias("status"))


@query("""
WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 3) AS mean, count(*) FILTER (WHERE turn = 0) AS openings FROM c GROUP BY role
""")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("n").alias("longest"), F.round(F.avg("n"), 3).alias("mean"), F.count_if(F.col("turn") == 0).alias("openings"))


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role FROM conversations),
r AS (SELECT conv_id, turn, role, 0 AS depth, lpad(CAST(turn AS VARCHAR), 20, '0') AS path FROM c WHERE parent IS NULL
  UNION ALL SELECT c.conv_id, c.turn, c.role, r.depth + 1, r.path || '/' || lpad(CAST(c.turn AS VARCHAR), 20, '0') FROM r JOIN c ON c.conv_id = r.conv_id AND c.parent = r.turn)
SELECT conv_id, turn, role, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS place FROM r QUALIFY place <= 100
""")
def thread_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees (turn n answers turn (n - 1) / 2), read depth first."""
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), parent.alias("parent_id"), "role")
    return trees.flattened(c, "conv_id").select("conv_id", F.col("id").alias("turn"), "role", F.col("depth").cast("long").alias("depth"), F.col("place").cast("long").alias("place"))


def greedy_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines chained by the gate of entity tokens (three in common, 0.55 of the smaller set, anchors, entity veto), whatever their first word."""
    t = table(spark, sf_dir, "documents").select("doc_id", text.entity_tokens(first_line()).alias("tokens"))
    return similarity.story_components(t.where(F.size("tokens") >= 3), 0.55)


query()(greedy_stories)


def story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items of a feed of ten an hour: titles are first lines, the URL follows from the second line."""
    second = F.split_part(F.col("text"), F.lit("\n"), F.lit(2))
    url = F.when(F.length(second) > 0, F.concat(F.lit("https://x.org/"), F.md5(second)))
    key = F.nullif(text.story_key(first_line()), F.lit("tech-trend"))
    ts = (1_700_000_000 + F.col("doc_id") * 360).cast("double")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ts.alias("ts"), F.array(url).alias("urls"), text.entity_tokens(first_line()).alias("tokens"), text.english_tokens(first_line()).alias("en"), F.when(F.length(key) > 3, key).alias("key"), text.entity_key(first_line(), url).alias("entity"))


def first_match_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document joins the first story that one of the tests accepts: URL, entity, story key, English title, gate; within 72 hours."""
    return first_match.first_match_clusters(story_items(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("hub").alias("cluster"))


query()(first_match_stories)
