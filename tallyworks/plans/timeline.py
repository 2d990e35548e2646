"""Queries over the event stream: slots, freshness, rankings, histories, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, timeslot
from ..functions.classify import ladder
from ..operators import merge, nearest, ranking
from ..registry import query
from ..sources.tables import table

#: Reference time of all queries; nothing reads a clock.
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def day_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("""
WITH s AS (SELECT CAST(floor(hour(ts + INTERVAL 9 HOUR) / 6) * 6 AS BIGINT) AS slot, event_type FROM events),
g AS (SELECT slot, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors FROM s GROUP BY slot),
d AS (SELECT unnest([0, 6, 12, 18]) AS slot),
z AS (SELECT CAST(d.slot AS BIGINT) AS slot, coalesce(total, 0) AS total, coalesce(clicks, 0) AS clicks, coalesce(purchases, 0) AS purchases, coalesce(errors, 0) AS errors FROM d LEFT JOIN g ON d.slot = g.slot)
SELECT *, greatest(0, total - clicks) AS backlog, slot = (SELECT slot FROM z ORDER BY total DESC, slot LIMIT 1) AS is_peak FROM z
""")
def slot_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour local slots with conditional counts; slots without events are there with zeros."""
    kinds = {"clicks": "click", "purchases": "purchase", "errors": "error"}
    counted = events(spark, sf_dir).groupBy(timeslot.slot(F.col("ts")).cast("long").alias("slot")).agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])
    slots = spark.range(0, 24, 6).withColumnRenamed("id", "slot")
    filled = slots.join(F.broadcast(counted), "slot", "left").fillna(0)  # four rows
    peak = filled.agg(F.max_by("slot", F.struct("total", -F.col("slot")))).scalar()
    return filled.select("slot", "total", *kinds, F.greatest(F.lit(0), F.col("total") - F.col("clicks")).alias("backlog"), (F.col("slot") == peak).alias("is_peak"))


@query("""
WITH s AS (SELECT *, CAST((ts + INTERVAL 9 HOUR) AS DATE) AS d, CAST(floor(hour(ts + INTERVAL 9 HOUR) / 6) * 6 AS BIGINT) AS slot FROM events)
SELECT strftime(d, '%Y-%m-%d') AS local_date, slot, event_id, event_type, user_id FROM s QUALIFY row_number() OVER (PARTITION BY d, slot ORDER BY ts DESC, event_id) = 1
""")
def latest_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"local_date": day_text(timeslot.local_date(F.col("ts"))), "slot": timeslot.slot(F.col("ts")).cast("long")})
    return ranking.first_of(e, ["local_date", "slot"], [F.desc("ts"), F.col("event_id")]).select("local_date", "slot", "event_id", "event_type", "user_id")


DAILY = """
daily AS (SELECT CAST(ts AS DATE) AS d, user_id, round(sum(value), 2) AS score, count(DISTINCT event_type) AS n_platforms, count(*) AS n_events FROM events GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, n_events DESC, user_id DESC) AS rank_position FROM daily)
"""


def ranked_days(spark: SparkSession, sf_dir: str, k: int = 30) -> DataFrame:
    daily = events(spark, sf_dir).groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.round(F.sum("value"), 2).alias("score"), F.count_distinct("event_type").alias("n_platforms"), F.count("*").alias("n_events"))
    return ranking.top_k(daily, ["d"], [F.desc("score"), F.desc("n_events"), F.desc("user_id")], k)


@query(f"WITH {DAILY} SELECT strftime(d, '%Y-%m-%d') AS ranking_date, user_id, score, n_platforms, n_events, rank_position FROM ranked WHERE rank_position <= 30")
def daily_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top thirty of every day, re-ranked within the date."""
    return ranked_days(spark, sf_dir).select(day_text(F.col("d")).alias("ranking_date"), "user_id", "score", "n_platforms", "n_events", F.col("rank_position").cast("long").alias("rank_position"))


@query(f"WITH {DAILY}, top AS (SELECT * FROM ranked WHERE rank_position <= 30) SELECT strftime(d, '%Y-%m-%d') AS ranking_date, count(*) AS n_items, max(score) AS top_score, arg_min(user_id, rank_position) AS top_user_id, arg_min(n_events, rank_position) AS top_n_events FROM top GROUP BY d")
def rank_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_calendar(ranked_days(spark, sf_dir), "d", "rank_position", ["user_id", "n_events"]).withColumn("ranking_date", day_text(F.col("d"))).drop("d")


@query(f"WITH {DAILY}, top AS (SELECT * FROM ranked WHERE rank_position <= 30) SELECT user_id, max(score) AS peak_score, strftime(min_by(d, [-score, epoch(d)]), '%Y-%m-%d') AS peak_date, CAST(min(rank_position) AS BIGINT) AS best_rank FROM top GROUP BY user_id")
def peak_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.peaks(ranked_days(spark, sf_dir), "user_id", "d", "score", "rank_position").select("user_id", "peak_score", day_text(F.col("peak_date")).alias("peak_date"), F.col("best_rank").cast("long").alias("best_rank"))


@query("""
WITH spine AS (SELECT TIMESTAMP '2024-01-30 14:59:59' - INTERVAL 1 DAY * n AS cut_at, n FROM range(7) t(n)),
counted AS (SELECT cut_at, n, user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types FROM spine JOIN events ON ts <= cut_at AND ts > cut_at - INTERVAL 3 DAY GROUP BY ALL)
SELECT strftime(cut_at, '%Y-%m-%d') AS ranking_date, user_id, n_events, n_types, row_number() OVER (PARTITION BY cut_at ORDER BY n_events DESC, n_types DESC, user_id) AS rank_position FROM counted
QUALIFY rank_position <= 30
""")
def backfill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings as they stood at 23:59:59 local time of seven past days. Each event is put on the days that it counts for."""
    cut = F.lit("2024-01-30 14:59:59").cast("timestamp_ntz")
    n = F.floor(F.timestamp_diff("SECOND", F.col("ts"), cut) / 86400)
    days = F.explode(F.filter(F.sequence(n, n - 2, F.lit(-1)), lambda d: d.between(0, 6)))
    live = events(spark, sf_dir).where((F.col("ts") <= cut) & (F.col("ts") > cut - F.expr("INTERVAL 9 DAYS"))).select("user_id", "event_type", days.alias("n"))
    counted = live.groupBy("n", "user_id").agg(F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types"))
    top = ranking.top_k(counted, ["n"], [F.desc("n_events"), F.desc("n_types"), F.col("user_id")], 30)
    return top.select(day_text(F.date_sub(F.lit("2024-01-30").cast("date"), F.col("n").cast("int"))).alias("ranking_date"), "user_id", "n_events", "n_types", F.col("rank_position").cast("long").alias("rank_position"))


HISTORY = """
WITH p AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS v FROM events),
w AS (SELECT *, first_value(v) OVER o AS f, lag(v) OVER o AS l, string_agg(CAST(v AS VARCHAR), ',') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS history FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events(spark, sf_dir).select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("v"))
    return ranking.tracked(p, "user_id", ["ts", "event_id"], "v")


@query(HISTORY + """, g AS (SELECT event_id, user_id, v, v - f AS delta, coalesce(v - l, 0) AS step, CASE WHEN f > 0 THEN (v - f) / greatest(f, 1) * 100.0 ELSE 0.0 END AS growth FROM w)
SELECT event_id, user_id, v, delta, step, round(growth, 3) AS growth_pct, delta >= 50 OR growth >= 30 AS is_spiking FROM g""")
def metric_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).select("event_id", "user_id", "v", "delta", "step", F.round("growth_pct", 3).alias("growth_pct"), "is_spiking")


@query(HISTORY + "SELECT event_id, user_id, history FROM w")
def history_last7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracked(spark, sf_dir).select("event_id", "user_id", "history")


@query(f"WITH {DAILY} SELECT user_id, string_agg(strftime(d, '%m-%d') || ':' || CAST(rank_position AS VARCHAR), ' ' ORDER BY d) AS trajectory, count(*) AS n_days FROM ranked WHERE rank_position <= 30 GROUP BY user_id")
def rank_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of an item by date, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("d", "rank_position")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.date_format(p["d"], "MM-dd"), F.lit(":"), p["rank_position"].cast("string"))), " ")
    return ranked_days(spark, sf_dir).groupBy("user_id").agg(text.alias("trajectory"), F.count("*").alias("n_days"))


@query(f"""
WITH recent AS (SELECT user_id, max(value) - min(value) AS spread, coalesce(sum(value), 0) AS total FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY user_id),
items AS (SELECT e.event_id, e.user_id % 200 AS story, e.event_type, e.user_id, coalesce(r.total, 0) AS gained FROM events e LEFT JOIN recent r ON e.user_id = r.user_id WHERE e.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR),
rolled AS (SELECT story, min(event_id) AS first_id, max(event_type) AS title, count(DISTINCT event_type) AS n_platforms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS platforms, round(sum(gained) * CASE WHEN count(DISTINCT event_type) > 1 THEN 1.5 ELSE 1.0 END, 2) AS heat FROM items GROUP BY story)
SELECT * FROM rolled ORDER BY heat DESC, story LIMIT 10
""")
def eod_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-day digest: day's gains joined to the items of two days, rolled up by story, ten best."""
    e = events(spark, sf_dir)
    gains = e.where(F.col("ts") >= as_of() - F.expr("INTERVAL 24 HOURS")).groupBy("user_id").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    items = e.where(F.col("ts") >= as_of() - F.expr("INTERVAL 48 HOURS")).join(gains, "user_id", "left").select("event_id", "event_type", (F.col("user_id") % 200).alias("story"), F.coalesce("total", F.lit(0.0)).alias("gained"))
    n = F.count_distinct("event_type")
    rolled = items.groupBy("story").agg(F.min("event_id").alias("first_id"), F.max("event_type").alias("title"), n.alias("n_platforms"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("platforms"), F.round(F.sum("gained") * F.when(n > 1, 1.5).otherwise(1.0), 2).alias("heat"))
    return rolled.orderBy(F.desc("heat"), "story").limit(10)


@query(f"SELECT event_type, count(*) AS kept, strftime(min(ts), '%Y-%m-%d') AS oldest FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY event_type")
def retention_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.retained(events(spark, sf_dir), "ts", as_of()).groupBy("event_type").agg(F.count("*").alias("kept"), day_text(F.min("ts")).alias("oldest"))


@query(f"""
WITH g AS (SELECT event_type, max(ts) AS last, count(*) AS n, floor(date_diff('microsecond', max(ts), TIMESTAMP '{AS_OF}') / 1e6) / 3600.0 AS hours FROM events GROUP BY event_type)
SELECT event_type, n, round(hours, 3) AS hours_old, CASE WHEN hours >= 24 THEN 'STALE' WHEN hours >= 8 THEN 'LATE' ELSE 'FRESH' END AS status FROM g
""")
def freshness_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("event_type").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    hours = timeslot.hours_apart(F.col("last"), as_of())
    return g.select("event_type", "n", F.round(hours, 3).alias("hours_old"), ladder(hours, [(24, "STALE"), (8, "LATE")], "FRESH").alias("status"))


@query("""
WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT event_id AS run_id, ts AS run_ts FROM events WHERE event_type = 'signup'),
j AS (SELECT a.event_id, run_id, abs(date_diff('microsecond', ts, run_ts)) / 1e6 AS gap_s FROM a JOIN b ON run_ts > ts - INTERVAL 300 SECOND AND run_ts < ts + INTERVAL 300 SECOND),
n AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap_s, run_id) = 1)
SELECT a.event_id, n.run_id, round(n.gap_s, 3) AS gap_s FROM a LEFT JOIN n ON a.event_id = n.event_id
""")
def nearest_run_within_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "ts")
    right = e.where("event_type = 'signup'").select(F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"))
    return nearest.nearest_within(left, right, "event_id", "ts", "run_id", "run_ts").select("event_id", "run_id", F.round("gap_s", 3).alias("gap_s"))


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE CASE WHEN regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0 END > 50 GROUP BY 1
""")
def json_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and group by a field of the JSON payload; what isn't a number counts as 0."""
    from ..operators.search import numeric_or_zero

    k = F.get_json_object("props", "$.k")
    return events(spark, sf_dir).where(numeric_or_zero(k) > 50).groupBy((k.try_cast("long") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN value > 100 THEN NULL ELSE round(value, 2) END AS v FROM events
ORDER BY v DESC NULLS FIRST, k ASC NULLS LAST, event_id DESC LIMIT 100
""")
def sort_nulls_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort with explicit places for nulls and a tie-break by id, then top k."""
    v = F.when(F.col("value") > 100, None).otherwise(F.round("value", 2))
    e = events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), v.alias("v"))
    return e.orderBy(F.desc_nulls_first("v"), F.asc_nulls_last("k"), F.desc("event_id")).limit(100)


@query(f"""
WITH s AS (SELECT user_id AS item, event_type AS platform, CASE WHEN event_type IN ('click', 'view') THEN 'PRESS' WHEN event_type = 'purchase' THEN 'CODE' ELSE 'COMMUNITY' END AS axis, ts, value FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY),
g AS (SELECT item, count(*) AS n, count(DISTINCT axis) AS axes, count(DISTINCT platform) AS platforms, greatest(floor(date_diff('microsecond', min(ts), TIMESTAMP '{AS_OF}') / 1e6), 1800) / 3600.0 AS hours, max(value) - min(value) AS delta, sum(value) AS viral FROM s GROUP BY item),
f AS (SELECT *, CASE WHEN axes >= 3 THEN 5.0 WHEN axes = 2 THEN 2.5 ELSE 1.0 END AS h, n / sqrt(greatest(1.0, hours)) * (1 + least(2.5, delta / 40.0)) AS v, log10(greatest(1.0, 10 + 0.5 * greatest(0, viral) + 0.5 * greatest(0, delta))) AS d FROM g)
SELECT item, n AS n_sources, axes AS n_axes, round(v, 4) AS velocity, round(d, 4) AS depth, round(h * v * d * 10, 3) AS raw, round(h * v * d * 10 * exp(-ln(2) / 36 * hours), 3) AS score3,
  round(h * v * d * 10 * exp(-ln(2) / 36 * hours), 1) >= 0.3 AND n >= 2 AND (platforms >= 2 OR axes >= 2) AS is_spiking FROM f
""")
def spike_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity, velocity and depth of each item's sources of a week, decayed by age."""
    axis = F.when(F.col("event_type").isin("click", "view"), "PRESS").when(F.col("event_type") == "purchase", "CODE").otherwise("COMMUNITY")
    recent = events(spark, sf_dir).where(F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS"))
    g = recent.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n_sources"), F.count_distinct(axis).alias("n_axes"), F.count_distinct("event_type").alias("n_platforms"), F.min("ts").alias("first"), (F.max("value") - F.min("value")).alias("delta"), F.sum("value").alias("viral"))
    g = g.withColumn("hours", scoring.age_hours(as_of(), F.col("first")))
    s = scoring.spike(F.col("n_sources"), F.col("n_axes"), F.col("n_platforms"), F.col("hours"), F.lit(0), F.col("viral"), F.col("delta"))
    return g.select("item", "n_sources", "n_axes", F.round(s["velocity"], 4).alias("velocity"), F.round(s["depth"], 4).alias("depth"), F.round(s["raw"], 3).alias("raw"), F.round(s["raw"] * scoring.decay(F.col("hours")), 3).alias("score3"), s["is_spiking"].alias("is_spiking"))


SPLIT = "WITH old AS (SELECT user_id, max(value) AS top, count(*) AS n, min(ts) AS seen, max(event_type) AS tier FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), new AS (SELECT user_id, max(value) AS top, count(*) AS n, min(ts) AS seen, max(event_type) AS tier FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    made = [events(spark, sf_dir).where(c).groupBy("user_id").agg(F.max("value").alias("top"), F.count("*").alias("n"), F.min("ts").alias("seen"), F.max("event_type").alias("tier")) for c in (F.col("ts") < cut, F.col("ts") >= cut)]
    return made[0], made[1]


@query(SPLIT + """
SELECT coalesce(old.user_id, new.user_id) AS user_id, greatest(old.top, new.top) AS top, greatest(old.n, new.n) AS n, strftime(coalesce(old.seen, new.seen), '%Y-%m-%d') AS seen, CASE WHEN old.user_id IS NULL OR new.top >= old.top THEN new.tier ELSE old.tier END AS tier FROM old FULL JOIN new ON old.user_id = new.user_id""")
def upsert_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking upsert: greatest metrics, first seen kept, tier of the higher score and of the new row at a tie."""
    old, new = halves(spark, sf_dir)
    out = merge.upsert_by_union(old, new, ["user_id"], greatest=["top", "n"], by_score=["tier"], score="top", first=["seen"])
    return out.withColumn("seen", day_text(F.col("seen")))


@query(SPLIT + " SELECT user_id, round(new.top, 3) AS top, new.n, new.tier FROM new LEFT JOIN old USING (user_id) WHERE old.user_id IS NULL OR abs(new.top - old.top) >= 0.1 OR new.tier <> old.tier")
def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows that a write would change."""
    old, new = halves(spark, sf_dir)
    return merge.changed(old, new, "user_id", {"top": 0.1}, ["tier"]).select("user_id", F.round("top", 3).alias("top"), "n", "tier")


@query(SPLIT + ", m AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)) SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_events, round(sum(top), 2) AS tops FROM m")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = halves(spark, sf_dir)
    return merge.insert_missing(old, new, "user_id").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_events"), F.round(F.sum("top"), 2).alias("tops"))


@query(f"""
WITH w AS (SELECT user_id, event_type, sum(value) AS v, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-30') AS old FROM events GROUP BY 1, 2),
g AS (SELECT user_id, max(v) AS v, count(*) AS n, min(old) AS old FROM w GROUP BY 1)
SELECT user_id, n AS n_platforms, CAST(old AS BIGINT) AS days_old, round(greatest(1.0, v) * CASE WHEN n > 1 THEN 1.5 * n ELSE 1.0 END * CASE old WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 WHEN 2 THEN 2.0 ELSE 0.01 END * CASE WHEN old BETWEEN 0 AND 2 AND v > 200 THEN 3.0 ELSE 1.0 END * CASE WHEN old BETWEEN 0 AND 2 AND v > 0 THEN 1 + least(2.0, v / 50.0) ELSE 1.0 END * CASE WHEN n = 5 THEN 1.2 ELSE 1.0 END, 2) AS weight FROM g
""")
def viral_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"), F.max("ts").alias("last"))
    g = w.groupBy("user_id").agg(F.max("v").alias("v"), F.count("*").alias("n_platforms"), F.date_diff(F.lit("2024-01-30").cast("date"), F.to_date(F.max("last"))).cast("long").alias("days_old"))
    return g.select("user_id", "n_platforms", "days_old", F.round(scoring.viral_weight(F.col("v"), F.col("n_platforms"), F.col("days_old"), F.col("v") > 200, F.col("v"), F.col("n_platforms") == 5), 2).alias("weight"))


@query("""
WITH k AS (SELECT user_id % 50 AS channel, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT channel, event_type, n, row_number() OVER (PARTITION BY channel ORDER BY n DESC, event_type) AS pick, CAST(sum(n) OVER (PARTITION BY channel) AS BIGINT) AS channel_total, rank() OVER (ORDER BY n DESC) AS overall FROM k
QUALIFY pick <= 2
""")
def axis_source_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two sources an axis by weight, with totals and an overall rank."""
    k = events(spark, sf_dir).groupBy((F.col("user_id") % 50).alias("channel"), "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("channel").orderBy(F.desc("n"), "event_type")
    # the overall rank counts greater values: a running sum over the few distinct values, not a window over all rows
    values = k.groupBy("n").agg(F.count("*").alias("m"))
    greater = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    above = values.select("n", (F.coalesce(F.sum("m").over(greater), F.lit(0)) + 1).alias("overall"))
    picked = k.withColumns({"pick": F.row_number().over(w).cast("long"), "channel_total": F.sum("n").over(Window.partitionBy("channel"))}).where("pick <= 2")
    return picked.join(above, "n").select("channel", "event_type", "n", "pick", "channel_total", "overall")
