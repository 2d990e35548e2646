"""Queries over the relational tables: facets, search, rollups, nested cases, quotas, graph measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, scoring, text
from ..operators import merge, ranking, search
from ..registry import query
from ..sources.tables import table

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ALIASES = {"AUTOS": ["AUTOMOBILE"], "HOMES": ["BUILDING", "FURNITURE", "HOUSEHOLD"]}


@query("""
WITH c AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'STANDARD') THEN p_type WHEN p_size > 40 THEN 'LARGE' WHEN p_size > 15 THEN 'MEDIUM' ELSE 'SMALL' END AS category FROM part),
d AS (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']) AS category)
SELECT d.category, count(c.category) AS n FROM d LEFT JOIN c ON d.category = c.category GROUP BY d.category
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every category of a fixed list, unknown ones put in a default, missing ones with zero."""
    size = F.when(F.col("p_size") > 40, "LARGE").when(F.col("p_size") > 15, "MEDIUM").otherwise("SMALL")
    counted = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD"), F.col("p_type")).otherwise(size).alias("category")).agg(F.count("*").alias("n"))
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return listed.join(F.broadcast(counted), "category", "left").fillna(0)  # six rows


@query("""
SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTOS' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'HOMES' ELSE 'TRENDS' END AS grp, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS n_positive, round(max(c_acctbal), 2) AS top FROM customer GROUP BY 1
""")
def category_alias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    grp = classify.first_match([(search.in_alias_group(seg, ALIASES, name, "TRENDS"), name) for name in ALIASES], "TRENDS")
    return table(spark, sf_dir, "customer").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("n_positive"), F.round(F.max("c_acctbal"), 2).alias("top"))


@query("""
SELECT o_orderpriority, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_true, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_half, greatest(0, count(*) - count(CASE WHEN o_orderstatus = 'F' THEN 1 END) - count(CASE WHEN o_orderstatus = 'O' THEN 1 END)) AS n_other, round(avg(o_totalprice), 2) AS mean_price, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100.0 / nullif(count(*), 0), 2) AS pct_true FROM orders GROUP BY 1
""")
def conditional_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, half = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    total = F.count("*")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(total.alias("total"), true.alias("n_true"), half.alias("n_half"), F.greatest(F.lit(0), total - true - half).alias("n_other"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_date"), F.round(true * 100.0 / F.nullif(total, F.lit(0)), 2).alias("pct_true"))


@query("SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, count(*) - CAST(sum(quality) AS BIGINT) AS bad, round(sum(quality) * 100.0 / count(*), 3) AS pct FROM labels")
def verdict_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.sum("quality")
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), good.alias("good"), F.sum("toxic").alias("toxic"), (F.count("*") - good).alias("bad"), F.round(good * 100.0 / F.count("*"), 3).alias("pct"))


@query("""
WITH m AS (SELECT * FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%') AND (lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%' OR lower(p_type) LIKE '%1%'))
SELECT p_partkey, p_name, count(*) OVER () AS total, CAST(ceil(count(*) OVER () / 15.0) AS BIGINT) AS total_pages, 30 < count(*) OVER () AS has_more FROM m ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 15
""")
def search_tokens_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens, each in some field; page two of fifteen with the total."""
    p = table(spark, sf_dir, "part")
    found = p.where(search.matches_tokens("RING 1", [F.col("p_name"), F.col("p_brand"), F.col("p_type")]))
    return search.page(found, [F.desc("p_retailprice"), F.col("p_partkey")], 15, 2).select("p_partkey", "p_name", "total", "total_pages", "has_more")


@query("""
SELECT c_custkey, c_name, n_name AS nation, round(c_acctbal, 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE (c_mktsegment IS NULL OR c_mktsegment <> 'MACHINERY') AND c_acctbal > 1000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_totalprice > 200000) ORDER BY balance DESC, c_custkey LIMIT 50
""")
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunction of facets, one of them membership in a subquery, then top k."""
    member = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 200000)).select(F.col("o_custkey").alias("c_custkey"))
    where = search.all_of([search.not_archived(F.when(F.col("c_mktsegment") == "MACHINERY", "archived").otherwise(F.col("c_mktsegment"))), F.col("c_acctbal") > 1000])
    found = table(spark, sf_dir, "customer").where(where).join(member, "c_custkey", "left_semi")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return found.join(nations, "c_nationkey").select("c_custkey", "c_name", "nation", F.round("c_acctbal", 2).alias("balance")).orderBy(F.desc("balance"), "c_custkey").limit(50)


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n_lines, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS claims, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus, coalesce(n_lines, 0) AS n_lines, coalesce(claims, '') AS claims, coalesce(amount, 0.0) AS amount FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children nested under their parent as an ordered array of structs, here given as text."""
    child = F.struct("l_linenumber", "l_returnflag", "l_extendedprice")
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(child)).alias("claims"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    shown = F.array_join(F.transform("claims", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(":"), c["l_returnflag"])), ",")
    return cases.join(nested, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(shown, F.lit("")).alias("claims"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL) GROUP BY 1")
def verified_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no match in the verified set."""
    verified = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(verified, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def blocked_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(blocked, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS runs, coalesce(sum(o_totalprice), 0) / 100000 AS minutes FROM orders GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, runs, round(minutes, 2) AS minutes, round(greatest(0, 2000 - minutes), 2) AS remaining, round(minutes / 2000 * 100, 2) AS burn_pct, CASE WHEN minutes / 2000 * 100 >= 75 THEN 'CRITICAL' WHEN minutes / 2000 * 100 >= 50 THEN 'WARNING' ELSE 'NORMAL' END AS alert FROM m
""")
def quota_burn_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("runs"), (F.coalesce(F.sum("o_totalprice"), F.lit(0.0)) / 100000).alias("minutes"))
    burn = F.col("minutes") / 2000 * 100
    return m.select(F.date_format("m", "yyyy-MM").alias("month"), "runs", F.round("minutes", 2).alias("minutes"), F.round(F.greatest(F.lit(0.0), 2000 - F.col("minutes")), 2).alias("remaining"), F.round(burn, 2).alias("burn_pct"), classify.ladder(burn, [(75, "CRITICAL"), (50, "WARNING")], "NORMAL").alias("alert"))


@query("""
SELECT l_partkey, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS mean_price, round(sum(l_discount) * 100.0 / nullif(sum(l_quantity), 0), 4) AS ratio FROM lineitem GROUP BY 1, 2 ORDER BY qty DESC, l_partkey, l_returnflag LIMIT 15
""")
def top_groups_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"), F.round(F.sum("l_discount") * 100.0 / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 4).alias("ratio"))
    return g.orderBy(F.desc("qty"), "l_partkey", "l_returnflag").limit(15)


@query("""
SELECT coalesce(p_brand, 'ALL') AS family, CASE WHEN p_brand IS NULL THEN 'ALL' ELSE coalesce(p_type, 'ALL') END AS role, count(*) AS n, round(max(p_retailprice), 2) AS top_price FROM part GROUP BY ROLLUP (p_brand, p_type)
""")
def family_role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.max("p_retailprice"), 2).alias("top_price"))
    return r.select(F.coalesce("p_brand", F.lit("ALL")).alias("family"), F.when(F.col("p_brand").isNull(), "ALL").otherwise(F.coalesce("p_type", F.lit("ALL"))).alias("role"), "n", "top_price")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT 's' || s AS node FROM e UNION ALL SELECT 'p' || p FROM e), n AS (SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part),
g AS (SELECT node, count(*) AS degree FROM d GROUP BY 1)
SELECT n.node, coalesce(degree, 1) AS degree, CAST(floor(13 + coalesce(degree, 1) * 3.2 + 20 * 0.22) AS BIGINT) AS size FROM n LEFT JOIN g ON n.node = g.node
""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree of every node from links, isolated nodes 1, and the size that a node is drawn at."""
    from ..operators.graph import degrees

    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    d = degrees(nodes, links)
    return d.select(F.col("id").alias("node"), "degree", F.floor(13 + F.col("degree") * 3.2 + 20 * 0.22).alias("size"))


@query("""
WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p FROM lineitem)
SELECT s AS node, 0 AS part, string_agg(p, ',' ORDER BY p) AS successors, '' AS predecessors, count(*) AS n FROM e GROUP BY s
UNION ALL SELECT p, 0, '', string_agg(s, ',' ORDER BY s), count(*) FROM e GROUP BY p
""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out lists of every node of the distinct links from suppliers to parts; a node of more than 100,000 links has several parts."""
    from ..operators.graph import neighbours

    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    n = (F.size("successors") + F.size("predecessors")).cast("long")
    return neighbours(links).select(F.col("id").alias("node"), "part", F.array_join("successors", ",").alias("successors"), F.array_join("predecessors", ",").alias("predecessors"), n.alias("n"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS points FROM conversations)
SELECT conv_id, turn, role, CAST(points AS BIGINT) AS points, row_number() OVER (PARTITION BY conv_id ORDER BY points DESC, turn) AS place FROM t QUALIFY place <= 3
""")
def top3_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("points"))
    return ranking.top_k(t, ["conv_id"], [F.desc("points"), F.col("turn")], 3, "place").withColumn("place", F.col("place").cast("long"))


@query("""
SELECT l_shipdate < TIMESTAMP '1996-01-01' AS early, l_returnflag AS workflow, count(*) AS runs, round(sum(l_quantity), 2) AS seconds, count(*) FILTER (WHERE l_linestatus = 'F') AS errors, round(avg(l_quantity), 3) AS mean, round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0 / count(*), 2) AS fail_pct FROM lineitem GROUP BY 1, 2
""")
def workflow_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("l_linestatus") == "F")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").groupBy(early.alias("early"), F.col("l_returnflag").alias("workflow")).agg(F.count("*").alias("runs"), F.round(F.sum("l_quantity"), 2).alias("seconds"), bad.alias("errors"), F.round(F.avg("l_quantity"), 3).alias("mean"), F.round(bad * 100.0 / F.count("*"), 2).alias("fail_pct"))


@query("""
WITH s AS (SELECT p_partkey, p_type, p_size, p_retailprice, CASE WHEN p_partkey % 4 = 0 THEN 'GitHub Official' WHEN p_partkey % 4 = 1 THEN 'Hacker News' WHEN p_partkey % 4 = 2 THEN 'Hugging Face' ELSE 'ArXiv' END AS platform FROM part),
n AS (SELECT *, greatest(5.0, least(100.0, floor(CASE WHEN platform LIKE 'GitHub%' THEN log10(p_size + 1.0) / log10(5000) * 100 WHEN platform = 'Hacker News' THEN log10(p_size + 1.0) / log10(800) * 100 WHEN platform = 'Hugging Face' THEN log10(p_size + 1.0) / log10(300) * 100 ELSE 55.0 END + 0.5))) AS norm FROM s)
SELECT p_partkey, platform, CAST(CASE WHEN p_partkey % 3 = 0 THEN floor(norm * 0.7 + 4 * 20 * 0.3 + 0.5) ELSE norm END AS BIGINT) AS score FROM n
""")
def standardized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    platform = F.when(m == 0, "GitHub Official").when(m == 1, "Hacker News").when(m == 2, "Hugging Face").otherwise("ArXiv")
    rating = F.when(F.col("p_partkey") % 3 == 0, 4.0)
    p = table(spark, sf_dir, "part").select("p_partkey", platform.alias("platform"), "p_size", rating.alias("rating"))
    return p.select("p_partkey", "platform", scoring.standardized(F.col("platform"), F.col("p_size"), F.col("rating")).alias("score"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN least(100, 15 + 25) ELSE 15 END AS risk, CASE WHEN p_size > 25 THEN 'MODERATE' ELSE 'LOW' END AS level FROM part
""")
def hype_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of candidates whose many stars stand against a short description."""
    p = table(spark, sf_dir, "part")
    risk = scoring.hype_risk(F.lower(F.col("p_name")), F.lit("GitHub Official"), F.when(F.col("p_size") > 25, 5000).otherwise(10), F.lit(20))
    return p.select("p_partkey", risk.alias("risk"), classify.ladder(risk, [(70, "HIGH"), (40, "MODERATE")], "LOW").alias("level"))


@query("""
WITH u AS (SELECT o_custkey AS k, 1 AS src, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders WHERE o_totalprice > 100000)
SELECT k, src, id FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, id) = 1
""")
def first_seen_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists concatenated in order of priority; of one key the first seen stays."""
    o = table(spark, sf_dir, "orders")
    lists = [o.where(c).select(F.col("o_custkey").alias("k"), F.lit(i).alias("src"), F.col("o_orderkey").alias("id")) for i, c in ((1, "o_orderstatus = 'F'"), (2, "o_totalprice > 100000"))]
    both = lists[0].unionByName(lists[1])
    return both.groupBy("k").agg(F.min(F.struct("src", "id")).alias("m")).select("k", "m.src", "m.id")


@query("SELECT o_orderkey % 8 AS shard, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def modulo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.pmod("o_orderkey", F.lit(8)).alias("shard")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))


@query("""
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)
SELECT i // 20 AS batch, count(*) AS n, min(o_orderkey) AS low, round(sum(o_totalprice) / 1e6 * 0.075 + count(*) * 0.3, 4) AS cost, round((sum(o_totalprice) / 1e6 * 0.075 + count(*) * 0.3) * 1380 * 0.5, 2) AS local_cost FROM o GROUP BY 1
""")
def work_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best two hundred in batches of twenty, with what each batch costs."""
    best = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    i = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1  # two hundred rows
    cost = F.sum("o_totalprice") / 1e6 * 0.075 + F.count("*") * 0.3
    return best.select("o_orderkey", "o_totalprice", F.floor(i / 20).cast("long").alias("batch")).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.round(cost, 4).alias("cost"), F.round(cost * 1380 * 0.5, 2).alias("local_cost"))


@query("""
SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY 1
""")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, sf_dir, "customer").join(r, F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy(F.col("r_name").alias("region")).agg(F.count_distinct("n_nationkey").alias("nations"), F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
WITH old AS (SELECT l_orderkey AS k, l_linenumber AS c FROM lineitem WHERE l_linenumber < 4 OR l_quantity <= 45), new AS (SELECT l_orderkey AS k, l_linenumber + 10 AS c FROM lineitem WHERE l_quantity > 45),
m AS (SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new)
SELECT count(*) AS n, count(DISTINCT k) AS cases, CAST(sum(c) AS BIGINT) AS numbers FROM m
""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of cases that come new are deleted and inserted again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    old = l.where("l_linenumber < 4 OR l_quantity <= 45").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"))
    new = l.where("l_quantity > 45").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") + 10).alias("c"))
    return merge.replaced(old, new, "k").agg(F.count("*").alias("n"), F.count_distinct("k").alias("cases"), F.sum("c").alias("numbers"))


@query("""
SELECT p_partkey, 'release:auto-gpt-' || CAST(p_size AS VARCHAR) || '-5' AS release_key, CAST(p_size * 1000 + 400 AS BIGINT) AS metric FROM part
""")
def release_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and metrics read back from texts made of the row."""
    p = table(spark, sf_dir, "part")
    title = F.concat(F.lit("GPT-"), F.col("p_size").cast("string"), F.lit(".5 released"))
    metric = F.concat(F.lit("★ "), F.col("p_size").cast("string"), F.lit(".4k stars"))
    return p.select("p_partkey", text.release_key(title).alias("release_key"), text.metric_number(metric).alias("metric"))
