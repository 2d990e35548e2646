"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Words are lower-cased and stripped of ASCII punctuation. An item of n words leaks where a stretch of a document is within
max_edits = floor((1 - similarity) * n) word edits of it.

Where windows lie: max_edits edits cut an item into max_edits + 1 stretches, so some run of ceil((n - max_edits) /
(max_edits + 1)) words survives. An item-sized window is laid at every place where a run of that many words (three at most)
is one of some item's runs, shifted back by the run's place in the item; this loses nothing within the bound, and leaves out
only windows that cannot hold a leak. Every window is then embedded by the CGK random walk, which turns edit into Hamming
distance, and looked up in LSH tables that sample places of the walks; whatever collides in a table is verified exactly.
How many walks there are follows from the target recall (`walks_for`).

The benchmark lies in the shared folder in blocks of bounded bytes. A task reads its documents once, in chunks, and each
chunk meets one block after another, so neither the driver nor a worker ever holds more than a few blocks.
"""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_text, new_path, slices

#: Documents whose windows are embedded together; blocks that a worker keeps indexed; texts that meet all blocks at a time.
SLICE, HELD, CHUNK_BYTES = 1024, 4, 32 << 20
#: Upper-case letters are lowered before; other ASCII marks part words. Fixed value.
_MARKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split()


def max_edits(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def run_length(n: int, similarity: float) -> int:
    k = max_edits(n, similarity)
    return min(3, max(1, -(-(n - k) // (k + 1))))


def infix_distance(item: list, text: list, bound: int) -> tuple[int, int] | None:
    """Least word edits between item and any stretch of text, and where the first such stretch ends; None over bound."""
    codes: dict = {}
    t = np.array([codes.setdefault(w, len(codes)) for w in text], np.int64)
    above = np.zeros(len(t) + 1, np.int64)
    steps = np.arange(len(t) + 1)
    for i, w in enumerate(item, 1):
        row = np.empty_like(above)
        row[0] = i
        row[1:] = np.minimum(above[1:] + 1, above[:-1] + (t != codes.get(w, -1)))
        above = np.minimum.accumulate(row - steps) + steps  # insertions run along the row
    end = int(np.argmin(above))
    return (int(above[end]), end) if above[end] <= bound else None


def _joined(starts: list[int], before: int, after: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in starts:
        if out and s - before <= out[-1][1]:
            out[-1][1] = s + after
        else:
            out.append([s - before, s + after])
    return [(a, b) for a, b in out]


def cgk(windows: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """CGK: each row of n word codes (then padding) to 3 n codes; what is past a row's end gives the padding code.

    Whether a walk goes one word further is a bit of the word's hash times the step's odd number.
    """
    m, width = windows.shape
    flat, base, place = windows.ravel(), np.arange(m) * width, np.zeros(m, np.int64)
    out = np.empty((3 * int(lengths.max(initial=0)), m), np.int32)
    for j in range(len(out)):
        out[j] = now = flat[base + place]
        place = np.minimum(place + (hashes[now] * odd[j] >> np.uint64(63)).astype(np.int64), lengths)
    return out.T


def odd_numbers(walk: int, steps: int) -> np.ndarray:
    return np.random.default_rng(11 + walk).integers(0, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def walks_for(recall: float, similarity: float, samples: int, tables: int) -> int:
    """How many walks find so large a share of copies at the very bound of allowed edits.

    Measured: copies of an item with max_edits random edits stand among other words; windows are laid at their surviving runs
    as on documents, and embedded by some walks. A table of `samples` places hits with the share of equal places to that
    power; a walk misses if no table hits in any window, and walks miss independently. The worst length counts.
    """
    rng, trial, pairs, worst = np.random.default_rng(5), 8, 150, 1
    for n in (10, 20, 40, 80, 160):
        q, rows, owner = run_length(n, similarity), [], []
        hashes = rng.integers(0, 1 << 64, 4 * n + 1, np.uint64)  # the last code is the padding
        for i in range(pairs):
            words = rng.permutation(4 * n).tolist()
            item, place = words[:n], list(range(n))  # which word of the item each word of the copy is, or -1
            for step in range(max_edits(n, similarity)):
                at, kind = int(rng.integers(len(place))), int(rng.integers(3))
                place[at : at + 1] = [[-1], [], [place[at], -1]][kind]
            text = words[n : 2 * n] + [item[k] if k >= 0 else words[2 * n + j % n] for j, k in enumerate(place)] + words[3 * n :]
            runs = [(p, k) for p, k in enumerate(place) if k >= 0 and place[p : p + q] == list(range(k, k + q)) and k + q <= n]
            rows.append(item)
            owner.append(i)
            for start in sorted({n + p - k for p, k in runs}):
                rows.append(text[start : start + n])
                owner.append(i)
        owner = np.array(owner)
        codes = np.array([[*r, 4 * n] for r in rows], np.int64)
        first = np.searchsorted(owner, owner)  # the row of the item itself
        missed = np.zeros(pairs)
        for walk in range(trial):
            out = cgk(codes, np.full(len(codes), n), hashes, odd_numbers(walk, 3 * n))
            alone = np.log1p(-np.minimum((out == out[first]).mean(1), 0.999) ** samples) * tables
            alone[first == np.arange(len(first))] = 0
            missed += np.exp(np.bincount(owner, alone, pairs)) / trial
        w = 1
        while (missed**w).mean() > 1 - recall:
            w += 1
        worst = max(worst, w)
    return worst


@dataclass
class Index:
    """The items of one block of the benchmark, their runs, and the LSH tables of their embeddings."""

    items: list[tuple[int, list[bytes]]]
    similarity: float
    walks: int
    samples: int
    tables: int
    codes: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for _, ws in self.items:
            for w in ws:
                self.codes.setdefault(w, len(self.codes))
        self.size = len(self.codes) + 1  # the last code: any word that no item has
        self.coded = [np.array([self.codes[w] for w in ws], np.int64) for _, ws in self.items]
        runs: dict[int, dict[int, set[tuple[int, int]]]] = {q: defaultdict(set) for q in (1, 2, 3)}
        for c in self.coded:
            q = run_length(len(c), self.similarity)
            for o in range(len(c) - q + 1):
                runs[q][self._number(c[o : o + q])].add((o, len(c)))
        self.runs = {q: r for q, r in runs.items() if r}
        self.keys = {q: np.array(sorted(r), np.int64) for q, r in self.runs.items()}
        rng = np.random.default_rng(11)
        longest = max((len(c) for c in self.coded), default=0)
        self.hashes_of = np.array([xxhash.xxh64_intdigest(w) for w in self.codes] + [xxhash.xxh64_intdigest(b" unknown"), xxhash.xxh64_intdigest(b" end")], np.uint64)
        self.steps = [odd_numbers(w, 3 * longest) for w in range(self.walks)]
        self.sampled = [{n: [rng.integers(0, 3 * n, self.samples) for _ in range(self.tables)] for n in sorted({len(c) for c in self.coded})} for _ in range(self.walks)]
        self.lookup: dict[tuple[int, int, int], dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.longest = longest
        for n, walk, table, rows, keys in self.hashes(*self._rows([(c, 0, len(c)) for c in self.coded])):
            for i, key in zip(rows.tolist(), keys, strict=True):
                self.lookup[n, walk, table][key].append(i)

    def _rows(self, cuts: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cuts (text, start, length) as padded rows, and their lengths."""
        out = np.full((len(cuts), self.longest + 1), self.size, np.int64)
        for row, (c, s, n) in zip(out, cuts, strict=True):
            piece = c[s : s + n]
            row[: len(piece)] = np.where(piece < 0, self.size - 1, piece)
        return out, np.array([n for _, _, n in cuts], np.int64)

    def _number(self, run: np.ndarray) -> int:
        out = 0
        for c in run:
            out = out * self.size + int(c)
        return out

    def hashes(self, windows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, list[bytes]]]:
        """(length, walk, table, rows, their keys). Rows have room for at least one padding code behind their words."""
        groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
        for walk in range(self.walks):
            out = cgk(windows, lengths, self.hashes_of, self.steps[walk])
            for n, rows in groups:
                for table, at in enumerate(self.sampled[walk][n]):
                    yield n, walk, table, rows, np.ascontiguousarray(out[np.ix_(rows, at)]).view(f"V{4 * self.samples}").ravel().tolist()

    def missing(self, i: int, c: np.ndarray) -> int:
        """How many words of item i the stretch c lacks: no fewer edits can make up for them."""
        have = np.bincount(c[c >= 0], minlength=self.size)
        return int(np.maximum(np.bincount(self.coded[i], minlength=self.size) - have, 0).sum())

    def starts(self, c: np.ndarray) -> dict[int, set[int]]:
        """Where windows lie in a text of word codes (-1: not in any item), by their number of words."""
        starts: dict[int, set[int]] = defaultdict(set)
        for q, keys in self.keys.items():
            if len(c) < q:
                continue
            parts = [c[k : len(c) - q + 1 + k] for k in range(q)]
            number = np.zeros(len(parts[0]), np.int64)
            good = np.ones(len(parts[0]), bool)
            for p in parts:
                number = number * self.size + p
                good &= p >= 0
            at = np.flatnonzero(good)
            if not len(at):
                continue
            at = at[keys[np.minimum(np.searchsorted(keys, number[at]), len(keys) - 1)] == number[at]]
            for p in at.tolist():
                for o, n in self.runs[q][int(number[p])]:
                    starts[n].add(min(max(p - o, 0), max(len(c) - n, 0)))
        return starts

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item, edits, words of the item, first word looked at, word where the best stretch ends)."""
        words = [words_of(t) for t in texts]
        coded = [np.fromiter(map(self.codes.get, ws, repeat(-1)), np.int64, len(ws)) for ws in words]
        windows = [(d, s, n) for d, c in enumerate(coded) for n, found in self.starts(c).items() for s in sorted(found)]
        near: set[tuple[int, int, int]] = set()
        for part in range(0, len(windows), 8192):
            chosen = windows[part : part + 8192]
            for n, walk, table, rows, keys in self.hashes(*self._rows([(coded[d], s, n) for d, s, n in chosen])):
                held = self.lookup[n, walk, table]
                near.update((chosen[r][0], i, chosen[r][1]) for r, key in zip(rows.tolist(), keys, strict=True) if key in held for i in held[key])
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        at: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, i, s in sorted(near):
            at[d, i].append(s)
        for (d, i), starts in at.items():
            item, c = self.items[i][1], coded[d]
            k = max_edits(len(item), self.similarity)
            for low, high in _joined(starts, k, len(item) + k):  # neighbourhoods that overlap are verified at once
                low = max(low, 0)
                if self.missing(i, c[low:high]) <= k and (got := infix_distance(item, words[d][low:high], k)) and (i not in best[d] or got[0] < best[d][i][0]):
                    best[d][i] = got[0], low, low + got[1]
        return [[(self.items[i][0], edits, len(self.items[i][1]), low, end) for i, (edits, low, end) in sorted(b.items())] for b in best]


@dataclass(frozen=True)
class Blocks:
    """The benchmark as written to the shared folder, and how its blocks are indexed."""

    path: str
    n: int
    similarity: float
    walks: int
    samples: int
    tables: int

    def read(self, block: int) -> Index:
        fs, at = pafs.FileSystem.from_uri(f"{self.path}/block={block}")
        items: list[tuple[int, str]] = []
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            found = pq.read_table(at, filesystem=fs, partitioning=None)
            items = sorted(zip(found["item_id"].to_pylist(), found["text"].to_pylist(), strict=True))
        return Index([(i, w) for i, t in items if (w := words_of(t))], self.similarity, self.walks, self.samples, self.tables)

    def index(self, block: int) -> Index:
        if (key := (self, block)) not in _indexes:
            _indexes[key] = self.read(block)
            while len(_indexes) > HELD:
                _indexes.popitem(last=False)
        _indexes.move_to_end(key)
        return _indexes[key]

    def leaks(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        for block in range(self.n):
            index = self.index(block)
            for at in range(0, len(texts), SLICE):
                for k, found in enumerate(index.leaks(texts[at : at + SLICE])):
                    out[at + k] += found
        return out

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices while all blocks stay indexed; else larger chunks, since each block is indexed anew for each."""
        if self.n <= HELD:
            yield from slices(batches, SLICE)
            return
        held, size = [], 0
        for part in slices(batches, SLICE):
            held.append(part)
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)


_indexes: OrderedDict[tuple[Blocks, int], Index] = OrderedDict()


def in_blocks(benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.995, samples: int = 5, tables: int = 12, max_bytes: int = 4 << 20) -> Blocks:
    """Write the distinct items to the shared folder, dealt out by a hash to blocks of about max_bytes of text."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    n, path = -(-(total or 0) // max_bytes), new_path(spark, "benchmark-blocks")
    if n:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
        dealt.repartition(n, "block").write.partitionBy("block").parquet(path)
    return Blocks(path, n, similarity, walks_for(recall, similarity, samples, tables), samples, tables)


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, edits, item_words, first_word, end_word.

    first_word is where the verified neighbourhood begins, end_word the word after the best stretch. Null and empty texts
    and items hold and match nothing; repeated rows, and rows without doc_id, are reported each; with an empty benchmark
    there are no rows. Texts of any length are read whole. Documents aren't shuffled: each is scanned where it is read, the
    corpus once whatever the benchmark's size. Options are those of in_blocks(), `recall` among them.
    """
    blocks = in_blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((d, *leak) for part in blocks.chunks(batches) for d, leaks in zip(part.column(0).to_pylist(), blocks.leaks([t or "" for t in part.column(1).to_pylist()]), strict=True) for leak in leaks), OUT)

    return id_text(docs).mapInArrow(run, "doc_id long, item_id long, edits long, item_words long, first_word long, end_word long")


def clean_only(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """docs, all columns, without those that hold a benchmark item. Rows are judged where they are read.

    Null and empty texts are clean; options and everything else as in find_leaks().
    """
    at, blocks = docs.columns.index("text"), in_blocks(benchmark, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.chunks(batches):
            yield part.filter(pa.array([not leaks for leaks in blocks.leaks([t or "" for t in part.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
