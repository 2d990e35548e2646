"""Pairs of sets that share enough values, exactly, by blocks: nothing but what passes leaves a task.

Values are ranked by how rare they are; those of one set alone are left out, but counted. Sets in the order of size are written in
blocks to the shared folder, and a task holds two of them at a time. Of a pair with c values in common the k rarest of them
are among the n - c + k rarest of either set; pairs that share k there pass a bound from bit signatures, then all they share is counted.
Candidates grow as the square of the sets where words recur, but only as work of a bounded step, not as rows that are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import dropped, scratch, written

#: Values that candidates share in their prefixes, if they must share that many at all; bits of a signature; values that meet and
#: pairs of rows that are counted in a step; pairs that are looked at together.
ALIKE, BITS, MET, CELLS, TOGETHER = 3, 512, 1 << 20, 1 << 18, 1 << 16
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])


def contained_pairs(sets: DataFrame, share: float, least: int, block: int = 65_536, forest: bool = False) -> DataFrame:
    """a, b, shared, na, nb: pairs of sets of which `least` values or more, and `share` of the smaller one's, are in both.

    sets: id (long, unique), set (distinct values), and optionally mask: pairs of different masks, neither 0, are left out.
    forest: of all pairs in two blocks only as many as join the same sets.
    """
    return _pairs(sets, share, least, False, block, forest)


def jaccard_overlaps(sets: DataFrame, share: float, block: int = 65_536, forest: bool = False) -> DataFrame:
    """a, b, shared, na, nb: pairs of sets with a Jaccard similarity of `share` or more. sets, forest: as above."""
    return _pairs(sets, share, 1, True, block, forest)


def _pairs(sets: DataFrame, share: float, least: int, jaccard: bool, block: int, forest: bool) -> DataFrame:
    path, names = _blocks(sets, block)
    n_pairs = len(names) * (len(names) + 1) // 2
    return sets.sparkSession.range(0, n_pairs, 1, max(1, min(n_pairs, 4096))).mapInArrow(_meet(path, names, share, least, jaccard, forest), "a long, b long, shared long, na long, nb long")


def _blocks(sets: DataFrame, block: int) -> tuple[str, list[list[str]]]:
    """The folder of the written sets, and the files of each block, smaller sets first."""
    spark = sets.sparkSession
    mask = F.col("mask") if "mask" in sets.columns else F.lit(0)
    own = written(sets.where("id is not null").select(F.col("id").cast("long").alias("id"), "set", mask.cast("int").alias("mask")), "overlap-sets")
    held = own.select("id", F.size("set").alias("n"), "mask", F.explode("set").alias("value"))
    counts = held.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranks = written(counts.orderBy("df", "value").select("value", F.monotonically_increasing_id().alias("rank")), "overlap-ranks")
    ranked = written(held.join(ranks, "value").groupBy("id", "n", "mask").agg(F.array_sort(F.collect_list("rank")).alias("held")), "overlap-sets")
    for table in (own, ranks):
        dropped(table)
    n_sets, path = ranked.count(), scratch(spark, "overlap-blocks")
    n_blocks = max(1, -(-n_sets // block), min(20, n_sets // 1024))
    ranked.repartitionByRange(n_blocks, "n", "id").sortWithinPartitions("n", "id").write.parquet(path)
    dropped(ranked)
    files = sorted(spark.read.schema(ranked.schema).parquet(path).inputFiles())
    together = -(-len(files) // n_blocks) if files else 1
    return path, [[f.rsplit("/", 1)[1] for f in files[at : at + together]] for at in range(0, len(files), together)]


class Block:
    """Sets of one block: ids, sizes, masks, the ranks of their values row by row, signatures, and rows by rank."""

    def __init__(self, fs: pafs.FileSystem, folder: str, names: list[str]):
        read = pa.concat_tables([pq.read_table(f"{folder}/{name}", filesystem=fs, partitioning=None) for name in names]).combine_chunks()
        self.ids, self.n, self.mask = (read[c].to_numpy().astype(np.int64) for c in ("id", "n", "mask"))
        self.kept = np.array([len(x) for x in read["held"].to_pylist()], np.int64) if not len(read) else np.diff(read["held"].chunk(0).offsets.to_numpy()).astype(np.int64)
        self.ranks = read["held"].chunk(0).flatten().to_numpy() if len(read) else np.zeros(0, np.int64)
        self.start = np.cumsum(self.kept) - self.kept
        self.row = np.repeat(np.arange(len(self.ids)), self.kept)
        self.place = np.arange(len(self.ranks)) - self.start[self.row] + (self.n - self.kept)[self.row]  # among all values, rarest first
        bits = np.zeros((len(self.ids), BITS), bool)
        bits[self.row, (self.ranks * 0x9E3779B97F4A7C1 >> 20) % BITS] = True
        self.signature = np.packbits(bits, axis=1).view(np.uint64)

    def by_rank(self, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and rows, in the order of ranks, of each set's `longest` rarest values."""
        at = np.flatnonzero(self.place < longest[self.row])
        at = at[np.argsort(self.ranks[at], kind="stable")]
        return self.ranks[at], self.row[at]

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """The ranks that occur, and row and rank of every value as one number, in order."""
        own = np.unique(self.ranks)
        return own, self.row * max(1, len(own)) + np.searchsorted(own, self.ranks)


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... of each k, count[k] of them."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _candidates(x: Block, y: Block, rare: np.ndarray, least: np.ndarray, met: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y that share `least` or more of x's `rare` rarest values and of those of y that `met` holds, each pair once."""
    at = np.flatnonzero(x.place < rare[x.row])
    low, high = np.searchsorted(met[0], x.ranks[at], "left"), np.searchsorted(met[0], x.ranks[at], "right")
    some = high > low
    row, low, count = x.row[at][some], low[some], (high - low)[some]
    total, width = np.concatenate([[0], np.cumsum(count)]), len(y.ids)
    dense = 16 * total[-1] > len(x.ids) * width
    first = np.searchsorted(row, np.arange(len(x.ids) + 1))  # of each row of x
    begin = 0
    while begin < len(x.ids):
        to = begin + max(1, CELLS // width) if dense else int(np.searchsorted(total[first], total[first[begin]] + MET, "right")) - 1
        to = min(max(to, begin + 1), len(x.ids))
        a, b = first[begin], first[to]
        code = np.repeat(row[a:b] - begin, count[a:b]) * width + met[1][_ragged(low[a:b], count[a:b])]
        if dense:
            found = np.flatnonzero(np.bincount(code, minlength=(to - begin) * width).reshape(to - begin, width) >= least[begin:to, None])
        else:
            found, times = np.unique_counts(code)
            found = found[times >= least[found // width + begin]]
        yield found // width + begin, found % width
        begin = to


def _meet(path: str, names: list[list[str]], share: float, least: int, jaccard: bool, forest: bool):  # noqa: ANN202
    def needed(x: Block) -> np.ndarray:
        """What a set shares at least with any as large or larger."""
        return np.maximum(least, np.ceil(x.n * (2 * share / (1 + share) if jaccard else share) - 1e-9).astype(np.int64))

    def fits(x: Block, y: Block, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
        most = x.n[i] + y.n[j] - shared if jaccard else x.n[i]
        return (shared >= least) & (shared / np.maximum(most, 1) >= share)

    def shared_by(x: Block, i: np.ndarray, j: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for at in range(0, len(i), TOGETHER // 4):
            a, b = i[at : at + TOGETHER // 4], j[at : at + TOGETHER // 4]
            ranks, pair = x.ranks[_ragged(x.start[a], x.kept[a])], np.repeat(np.arange(len(a)), x.kept[a])
            local = np.minimum(np.searchsorted(own, ranks), len(own) - 1)
            there = own[local] == ranks
            code = b[pair[there]] * len(own) + local[there]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            out[at : at + TOGETHER // 4] = np.bincount(pair[there][codes[place] == code], minlength=len(a))
        return out

    def pairs_of(x: Block, y: Block, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        if not len(x.ranks) or not len(y.ranks) or jaccard and x.n[-1] < share * y.n[0] - 1e-9:
            return
        met = y.by_rank(y.n - np.ceil(share * y.n - 1e-9).astype(np.int64) + ALIKE if jaccard else y.n)
        alike = np.minimum(needed(x), ALIKE)
        own, codes = y.codes()
        label = np.arange(len(x.ids) if same else len(x.ids) + len(y.ids))
        aside = 0 if same else len(x.ids)
        for i, j in _candidates(x, y, x.n - needed(x) + alike, alike, met):
            for at in range(0, len(i), TOGETHER):
                a, b = i[at : at + TOGETHER], j[at : at + TOGETHER]
                if same:
                    a, b = a[a < b], b[a < b]  # rows are in the order of size and id
                if jaccard:
                    a, b = (v[x.n[a] >= share * y.n[b] - 1e-9] for v in (a, b))
                if forest:
                    apart = label[a] != label[aside + b]
                    a, b = a[apart], b[apart]
                veto = (x.mask[a] != 0) & (y.mask[b] != 0) & (x.mask[a] != y.mask[b])
                a, b = a[~veto], b[~veto]
                most = x.kept[a] - np.bitwise_count(x.signature[a] & ~y.signature[b]).sum(1, dtype=np.int64)
                able = fits(x, y, a, b, most)
                a, b = a[able], b[able]
                shared = shared_by(x, a, b, own, codes)
                able = fits(x, y, a, b, shared)
                a, b, shared = a[able], b[able], shared[able]
                if forest and len(a):
                    chosen = _joined(label, a, b + aside)
                    a, b, shared = a[chosen], b[chosen], shared[chosen]
                yield x.ids[a], y.ids[b], shared, x.n[a], y.n[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        first, second = np.triu_indices(len(names))
        held: tuple[int, Block] | None = None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = int(first[k]), int(second[k])
                if held is None or held[0] != i:
                    held = (i, Block(fs, folder, names[i]))
                x = held[1]
                for found in pairs_of(x, x if i == j else Block(fs, folder, names[j]), i == j):
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=PAIRS)

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The pairs that join two labels, in order; `label` is brought up to date."""
    up: dict[int, int] = {}
    chosen = []
    for k, (u, v) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        while u in up:
            u = up[u]
        while v in up:
            v = up[v]
        if u != v:
            up[max(u, v)] = min(u, v)
            chosen.append(k)
    if up:
        for low in sorted(up):  # smaller labels first, so that theirs are final
            up[low] = up.get(up[low], up[low])
        old = np.array(sorted(up))
        new = np.array([up[x] for x in old.tolist()])
        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
        label[:] = np.where(old[at] == label, new[at], label)
    return chosen
