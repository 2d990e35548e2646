"""Near neighbours and near duplicates of the reference domain: kNN by blocks, token blocking, pair decisions, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, similar_story_keys
from ..sources.workspace import ensure_checkpoint_dir, scratch, written
from .overlap import contained_pairs, jaccard_overlaps


#: A task holds about this many bytes of best rows before it passes them on.
HELD_BYTES = 64 << 20


def knn(df: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 20_000, buffer_rows: int = 65_536) -> DataFrame:
    """a_id, b_id, similarity: of each query the k nearest other vectors by cosine, ties by b_id. Exact.

    queries (a stated set) are written to the shared folder in blocks of about block_rows. df is read once: a task buffers
    buffer_rows of its rows, which meet one block after another, and keeps the k best of all its rows a query, so that it passes
    on k rows a query (more often only where those of all queries exceed HELD_BYTES). Zero and null vectors, and those of
    another width than the query, match nothing.
    """
    n_blocks, path = max(1, -(-queries.count() // block_rows)), scratch(df.sparkSession, "knn-queries")
    dealt = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
    dealt.repartition(n_blocks, "block").write.partitionBy("block").parquet(path)
    out = df.select("vec_id", "embedding").mapInPandas(_best(path, n_blocks, k, buffer_rows), "a_id long, b_id long, similarity double")
    best = Window.partitionBy("a_id").orderBy(F.desc("similarity"), "b_id")
    return out.withColumn("rank_position", F.row_number().over(best)).where(F.col("rank_position") <= k)


def best_of(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines (queries by k) of the k most similar rows of each query, itself left out, ties by id; no row: cosine -inf."""
    found, cosine = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
    for at in range(0, len(ids), 512):
        sim = q[at : at + 512] @ x.T
        sim[ids[at : at + 512, None] == own[None, :]] = -np.inf
        if sim.shape[1] > 4 * k:  # those that reach the k-th best, then in order
            rows, cols = np.nonzero(sim >= -np.partition(-sim, k - 1, 1)[:, k - 1, None])
        else:
            rows, cols = (v.ravel() for v in np.indices(sim.shape))
        order = np.lexsort((own[cols], -sim[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols, place = rows[place < k], cols[place < k], place[place < k]
        found[at + rows, place], cosine[at + rows, place] = own[cols], sim[rows, cols]
    return found, cosine


def _best(path: str, n_blocks: int, k: int, buffer_rows: int):  # noqa: ANN202
    def by_width(ids: np.ndarray, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and unit vectors of each width; null and zero vectors are left out."""
        widths = np.array([len(v) if v is not None else 0 for v in vectors])
        out = {}
        for width in np.unique(widths[widths > 0]).tolist():
            at = np.flatnonzero(widths == width)
            x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), width)
            norm = np.sqrt((x * x).sum(1))
            good = norm > 0
            out[width] = ids[at][good], x[good] / norm[good, None]
        return out

    def block(fs, at: str, number: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
        folder = f"{at}/block={number}"
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return {}
        read = pq.read_table(folder, filesystem=fs, partitioning=None)
        return by_width(read["vec_id"].to_numpy().astype(np.int64), read["embedding"].to_pylist())

    def merged(ids: np.ndarray, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        found, cosine = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
        order = np.lexsort((found, -cosine))[:, :k]
        return np.take_along_axis(found, order, 1), np.take_along_axis(cosine, order, 1)

    def run(frames):  # noqa: ANN001, ANN202
        fs, at = pafs.FileSystem.from_uri(path)
        cache: dict[int, dict] = {}
        best: dict[tuple[int, int], tuple] = {}

        def meet(buffer: list[pd.DataFrame]) -> None:
            rows = by_width(np.concatenate([b["vec_id"].to_numpy(np.int64) for b in buffer]), [v for b in buffer for v in b["embedding"]])
            for number in range(n_blocks):
                if number not in cache:
                    cache.clear()  # one block at a time
                    cache[number] = block(fs, at, number)
                for width, (ids, q) in cache[number].items():
                    if width in rows:
                        here = best_of(ids, q, *rows[width], k)
                        best[number, width] = (ids, *(merged(ids, best[number, width][1:], here) if (number, width) in best else here))

        def passed_on():  # noqa: ANN202
            for ids, found, cosine in best.values():
                keep = np.isfinite(cosine)
                yield pd.DataFrame({"a_id": np.repeat(ids, keep.sum(1)), "b_id": found[keep], "similarity": cosine[keep]})
            best.clear()

        buffer, n = [], 0
        for pdf in frames:
            for begin in range(0, len(pdf), buffer_rows):
                buffer.append(pdf.iloc[begin : begin + buffer_rows])
                n += len(buffer[-1])
                if n >= buffer_rows:
                    meet(buffer)
                    buffer, n = [], 0
                    if sum(x[1].nbytes * 2 for x in best.values()) > HELD_BYTES:
                        yield from passed_on()
        if buffer:
            meet(buffer)
        yield from passed_on()

    return run


def jaccard_pairs(df: DataFrame, id_col: str, tokens: str, threshold: float) -> DataFrame:
    """a_id < b_id and their Jaccard similarity, of rows whose token sets are that similar. Exact, by prefix filtering.

    Rows with equal sets are one class while pairs are sought; classes meet block by block (overlap.py), and only pairs that are
    that similar leave a task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("set")).where(F.size("set") > 0)
    found = jaccard_overlaps(rows.groupBy("set").agg(F.min("id").alias("id")), threshold)
    return found.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))


def decision(similarity: Column, shared: Column, specific: Column, same_platform: Column, release_conflict: Column, version_conflict: Column, entity_veto: Column, hub_locked: Column, same_channel: Column, low: float = 0.78, high: float = 0.88) -> Column:
    """The cascade of a candidate pair: the first rule that holds names it."""
    return (
        F.when(similarity < low, "BELOW_THRESHOLD")
        .when(release_conflict, "REJECTED_RELEASE_CONFLICT")
        .when(hub_locked & (specific < 2), "REJECTED_CANONICAL_HUB_LOCK")
        .when(version_conflict, "REJECTED_VERSION_CONFLICT")
        .when(same_channel, "REJECTED_SAME_YOUTUBE_CHANNEL")
        .when(entity_veto, "REJECTED_ENTITY_VETO")
        .when(same_platform & (specific < 2), "REJECTED_SAME_PLATFORM_LOW_SPECIFIC_TOKENS")
        .when((similarity >= high) & (shared >= 1), "VECTOR_HIGH")
        .when((shared >= 2) & (specific >= 2), "TOKEN_OVERLAP")
        .otherwise("REJECTED_AMBIGUOUS_LOW_OVERLAP")
    )


def components(edges: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """node, root: the smallest node that links reach, whatever their number. Each round a node takes the smallest label of its neighbours, and that
    label's own label (pointer jumping), so chains shorten geometrically; lineage is cut by checkpoint() each round."""
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    links = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).checkpoint()
    while True:
        near = links.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        jump = labels.select(F.col("u").alias("root"), F.col("root").alias("far"))
        then = labels.join(near, "u").join(jump, "root", "left").select("u", F.least("root", "m", F.coalesce("far", "root")).alias("then"), "root").checkpoint()
        moved = then.where("then < root").limit(1).count()
        labels = then.select("u", F.col("then").alias("root"))
        if not moved:
            return labels.select(F.col("u").alias("node"), "root")


# Entities of the veto by token sets, and pairs of words that name one story.
MAJOR_ENTITIES = ["openai", "google", "anthropic", "meta", "microsoft", "apple", "amazon", "deepseek", "qwen", "mistral", "nvidia", "tesla", "oracle", "discord", "x", "houthi", "flock"]
ANCHORS = [("houthi", "island"), ("houthi", "shipping"), ("houthi", "control"), ("flock", "veteran"), ("deepseek", "v3"), ("qwen", "2.5-coder"), ("chorleywood", "bread"), ("openai", "government"), ("openai", "federal"), ("openai", "medicare"), ("openai", "australian"), ("openai", "bot"), ("openai", "agent"), ("anthropic", "supply"), ("oracle", "force")]


def major_entities(tokens: Column) -> Column:
    return F.array_sort(F.array_intersect(tokens, F.array(*map(F.lit, MAJOR_ENTITIES))))


def entity_mask(tokens: Column) -> Column:
    """The major entities of a token set, a bit for each."""
    return sum((F.when(F.array_contains(tokens, e), 1 << i).otherwise(0) for i, e in enumerate(MAJOR_ENTITIES)), F.lit(0))


def entity_veto(a: Column, b: Column) -> Column:
    """Both token sets name major entities, but not the same ones."""
    x, y = major_entities(a), major_entities(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


# Entities of which two texts must share one, if both name some.
SPIKE_ENTITIES = ["openai", "google", "anthropic", "meta", "microsoft", "apple", "deepseek", "qwen", "houthi", "flock", "nvidia", "tesla"]


def no_common_entity(a: Column, b: Column) -> Column:
    """The veto of spikes: both normal texts hold a name, anywhere in them, and no name stands in both."""
    held = lambda t: [t.contains(e) for e in SPIKE_ENTITIES]
    some = lambda marks: reduce(lambda x, y: x | y, marks)
    return some(held(a)) & some(held(b)) & ~some([x & y for x, y in zip(held(a), held(b), strict=True)])


def anchors_of(tokens: Column) -> Column:
    """Numbers of the anchor pairs that the token set holds."""
    held = [F.when(F.array_contains(tokens, a) & F.array_contains(tokens, b), i) for i, (a, b) in enumerate(ANCHORS)]
    return F.array_compact(F.array(*held))


def same_story(a: Column, b: Column, threshold: float = 0.55, least: int = 3) -> Column:
    """The gate of token sets: no entity veto, and an anchor pair of both or `least` common tokens that are `threshold` of the smaller set."""
    common, smaller = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return ~entity_veto(a, b) & (F.arrays_overlap(anchors_of(a), anchors_of(b)) | ((common >= least) & (common / smaller >= threshold)))


def story_links(classes: DataFrame, threshold: float = 0.55, least: int = 3) -> DataFrame:
    """a_id, b_id: links that join classes (id, set; sets differ) wherever a chain of same_story pairs does. Exact.

    Classes meet block by block (overlap.py); of the pairs in two blocks only a forest leaves the task. Of the sets that hold an
    anchor, those of the same entities hang on their smallest id, and all on the smallest without entities, if there is one.
    """
    sized = classes.where(F.size("set") > 0)
    alike = contained_pairs(sized.select("id", "set", entity_mask(F.col("set")).alias("mask")), threshold, least, forest=True).select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))

    held = sized.select("id", major_entities(F.col("set")).alias("entities"), F.explode(anchors_of(F.col("set"))).alias("anchor"))
    same = held.groupBy("anchor", "entities").agg(F.min("id").alias("a_id"))
    free = same.where(F.size("entities") == 0).select("anchor", "a_id")
    anchored = [held.join(same, ["anchor", "entities"]), held.join(free, "anchor")]
    for part in anchored:
        alike = alike.unionByName(part.where("a_id != id").select("a_id", F.col("id").alias("b_id")))
    return alike


def key_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a_id, b_id: links among rows (id, set, keys) that share a value of some key, unless their entities veto it.

    Of one value those of the same entities hang on their smallest id, and all on the smallest without entities, if there is
    one: as many links as rows, however many share a value. Null and empty values link nothing.
    """
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("value")) for k in keys])).alias("key")
    held = rows.select("id", major_entities(F.col("set")).alias("entities"), named).where(F.coalesce("key.value", F.lit("")) != "")
    same = held.groupBy("key", "entities").agg(F.min("id").alias("a_id"))
    free = same.where(F.size("entities") == 0).select("key", "a_id")
    links = held.join(same, ["key", "entities"]).select("a_id", "id").unionByName(held.join(free, "key").select("a_id", "id"))
    return links.where("a_id != id").select("a_id", F.col("id").alias("b_id"))


def story_components(df: DataFrame, threshold: float = 0.55, least: int = 3, keys: list[str] = ()) -> DataFrame:
    """doc_id, cluster: rows (doc_id, tokens, keys) chained by same_story pairs or by equal keys (URL, entity, story key), under
    the smallest doc_id. No order, no blocks; doc_id is unique."""
    rows = written(df.select("doc_id", F.array_sort(F.array_distinct("tokens")).alias("set"), *keys), "story-rows")
    classes = written(rows.groupBy("set").agg(F.min("doc_id").alias("id")), "story-classes")
    links = story_links(classes, threshold, least)
    if keys:
        links = links.unionByName(key_links(rows.withColumnRenamed("doc_id", "id"), list(keys)))
        own = rows.join(classes, "set").where("doc_id != id").select(F.col("id").alias("a_id"), F.col("doc_id").alias("b_id"))
        links = links.unionByName(own)
    roots = components(written(links, "story-links")).withColumnRenamed("node", "doc_id")
    if keys:
        return rows.select("doc_id").join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("cluster"))
    labels = classes.join(roots.withColumnRenamed("doc_id", "id"), "id", "left").select("set", F.coalesce("root", "id").alias("cluster"))
    return rows.join(labels, "set").select("doc_id", "cluster")


def duplicate_story(urls_a: Column, urls_b: Column, asset: Column, ts_a: Column, ts_b: Column, tokens_a: Column, tokens_b: Column, similarity: Column, key_a: Column, key_b: Column, entities_a: Column, entities_b: Column) -> Column:
    """Whether two items tell one story: the first rule that holds decides. ts in seconds; asset: one of them is a model or tool, which has no window of 168 hours."""
    gate = F.coalesce(same_story(tokens_a, tokens_b), F.lit(False))
    return (
        F.when(F.arrays_overlap(F.array_compact(F.array_remove(urls_a, "")), F.array_compact(F.array_remove(urls_b, ""))), True)
        .when(~F.coalesce(asset, F.lit(False)) & (ts_a > 0) & (ts_b > 0) & (F.abs(ts_a - ts_b) > 168 * 3600), False)
        .when(entity_veto(tokens_a, tokens_b), False)
        .when(similarity >= 0.88, True)
        .when(similarity < 0.74, False)
        .when(similarity.isNotNull(), gate)
        .when((key_a != "") & (key_b != "") & similar_story_keys(key_a, key_b), True)
        .when(F.size(F.array_intersect(entities_a, entities_b)) >= 2, True)
        .otherwise(gate)
    )
