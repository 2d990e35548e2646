"""SimHash near-dedup: 64-bit fingerprints, covering LSH, links up to a radius, connected components.

Covering: every bit place gets a random code of radius + 1 bits; table v (v not 0) keeps the places whose code has an even
product with v masked out, so any two fingerprints that differ in at most `radius` places agree on the mask of some table.
A bucket of more than `block` fingerprints is dealt out again by a second, independent family of masks, in some table of
which any linked pair meets too. What is then still larger is compared in blocks, every pair of blocks a group of its own,
so nothing unbounded meets in a task and no link is lost. Of a group only a spanning forest is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, id_text, materialize, path_of, slices

SHINGLE, SEED, BITS = 3, 42, 64


def fingerprint(text: str) -> int:
    """Unsigned 64-bit fingerprint of word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = [b" ".join(w) for w in zip(*(words[k:] for k in range(SHINGLE)), strict=False)] if len(words) >= SHINGLE else [b" ".join(words)]
    n = len(grams)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    over = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        over += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 masks of kept places, as signed 64-bit integers."""
    codes = np.random.default_rng(seed).integers(0, 1 << (radius + 1), BITS)
    return [_signed(sum(1 << i for i, c in enumerate(codes) if (int(c) & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row; null text counts as empty: 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_signed(fingerprint(t or "")) for t in part.column(1).to_pylist()], pa.int64())], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a signed number it would count the absolute value


def _forest(fps: np.ndarray, side: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps (between the two sides, if given), by breadth-first search."""
    left = np.ones(len(fps), bool)
    out = []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[_distance(fps[rest], fps[at]) <= radius]
            if side is not None:
                near = near[side[near] != side[at]]
            left[near] = False
            out += [(int(fps[at]), int(fps[x])) for x in near]
            queue += near.tolist()
    return out


def links(fps: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints in column fp wherever a chain of pairs within `radius` does."""
    def tables(seed: int) -> Column:
        masked = [F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius, seed))]
        return F.explode(F.array(*masked)).alias("x")

    def counted(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.join(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), by)

    first = counted(fps.select("fp", tables(7)).select("x.t", "x.key", "fp"), ["t", "key"])
    small = first.where(F.col("n") <= block).select("t", "key", F.lit(-1).cast("byte").alias("t2"), F.lit(0).cast("long").alias("key2"), "fp", F.lit(1).alias("blocks"))
    large = first.where(F.col("n") > block).select("t", "key", "fp", tables(8)).select("t", "key", F.col("x.t").alias("t2"), F.col("x.key").alias("key2"), "fp")
    # how many blocks a bucket has, and to which pairs of blocks (p <= q) a fingerprint goes
    large = counted(large, ["t", "key", "t2", "key2"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n")
    member = small.unionByName(large).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    bucket = ["t", "key", "t2", "key2"]
    pairs = member.select(*bucket, "fp", "own", other.alias("other")).select(*bucket, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(8)], 1)
            held = now if held is None else np.concatenate([held, now])
            cuts = np.flatnonzero((held[1:, :6] != held[:-1, :6]).any(1)) + 1
            if len(cuts):
                yield _compare(held[: cuts[-1]], radius, schema)
                held = held[cuts[-1] :]
        if held is not None and len(held):
            yield _compare(held, radius, schema)

    dealt = pairs.repartition(*bucket, "p", "q").sortWithinPartitions(*bucket, "p", "q", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _compare(rows: np.ndarray, radius: int, schema: pa.Schema) -> pa.RecordBatch:
    """rows: t, key, t2, key2, p, q, own, fp, groups side by side."""
    starts = np.concatenate([[0], np.flatnonzero((rows[1:, :6] != rows[:-1, :6]).any(1)) + 1, [len(rows)]])
    size = np.diff(starts)
    low, high, side, fps = (rows[:, k].copy() for k in (4, 5, 6, 7))
    out: list[tuple[int, int]] = []
    two = starts[:-1][size == 2]
    two = two[_distance(fps[two], fps[two + 1]) <= radius]
    two = two[(low[two] == high[two]) | (side[two] != side[two + 1])]
    a, b = fps[two], fps[two + 1]
    for k in np.flatnonzero(size > 2):
        at, to = starts[k], starts[k + 1]
        out += _forest(fps[at:to], None if low[at] == high[at] else side[at:to], radius)
    more = np.array(out, np.int64).reshape(-1, 2)
    a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star contraction until a round changes nothing; each round's links are written to the shared folder. A star's centre is
    a minimum over partial aggregates, and joins with a hot centre are split by adaptive execution.
    """
    spark = edges.sparkSession

    def larger_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")

    now = materialize(larger_first(edges).distinct(), "links")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: what is larger than u hangs on u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u's smaller neighbours, and u itself, hang on the smallest of them
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = materialize(small, "links")
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path_of(now)) if path_of(now) else None
        now = then
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def near_duplicates(docs: DataFrame, radius: int = 3, block: int = 2048) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Texts of any length are read whole. Rows with one fingerprint are one node, whatever
    their number; rows without doc_id get component_id null unless their fingerprint has a doc_id elsewhere.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = links(nodes.select("fp"), radius, block)
    # name nodes by their smallest doc_id, so that the smallest node of a component is its id
    a = nodes.select(F.col("fp").alias("a"), F.col("least").alias("x"))
    b = nodes.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    named = found.distinct().join(a, "a").join(b, "b").where("x is not null and y is not null").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(named)
    labels = nodes.join(roots.withColumnRenamed("node", "least"), "least", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs, all columns, without those that link to an earlier one: of each component the smallest doc_id stays.

    Rows without doc_id stay; of rows that repeat a doc_id all stay if the id stays.
    """
    gone = near_duplicates(docs, radius).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
