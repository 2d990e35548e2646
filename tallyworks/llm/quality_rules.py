"""Quality rules: exact document statistics, two fixed rules, and gradient-boosted trees over the statistics.

The trees are grown here on a bounded sample of labelled documents (`max_rows`), with monotonic constraints on chosen
statistics, and flattened into numpy node arrays; all documents are then scored level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

#: Characters that count as symbols; fixed value.
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, MARKS, BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the sign of the constraint: quality may not rise (-1) with these, 0 is free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": -1, "distinct_share": 0, "mark_share": 0, "words_a_line": 0, "pipe_share": -1, "shout_share": -1}
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that is found twice or more, its first occurrence included."""
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n or n <= window:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    m = n - window + 1
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if not all(np.array_equal(ids[a + k], ids[b + k]) for k in range(window)):  # hashes met by chance: name windows exactly
        names, step = ids, 1
        while step < window:
            left, right = names[:-step], names[step:]
            names = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
            step *= 2
        counts = np.bincount(names)
        at = np.flatnonzero(counts[names] > 1)
    else:
        at = np.union1d(a, b)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    chars, symbols, dup = len(text) - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines))
    repeat = repeated_words(words)
    per_char, per_word, per_line = 1 / max(chars, 1), 1 / max(n, 1), 1 / max(len(lines), 1)
    features = [np.log1p(n), chars * per_word, symbols * per_char, dup * per_line, repeat * per_word, without(UPPER) * per_char, without(DIGITS) * per_char, len(set(words)) * per_word, without(MARKS) * per_char, n * per_line, data.count(b"|") * per_word, data.count(b"!") * per_word]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """Fixed rules: too short, or too much of it repeats itself."""
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


@dataclass
class Trees:
    """All nodes of all trees side by side; a leaf's feature is -1 and it leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                node = np.where((f < 0) | (x[rows, f] <= self.threshold[node]), self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Boost logistic regression trees on quantile histograms. Children of a constrained split get bounds at its middle."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    cell = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    nodes: list[list] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        return -(g * v + 0.5 * (h + l2) * v * v)

    def build(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        value = leaf(g, h, low, high)
        nodes.append([-1, 0.0, at, at, value * rate])
        if level == depth or h < 2 * least:
            return at
        best = (1e-6, -1, 0, 0.0, 0.0)
        whole = gain(g, h, np.float64(value))
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(cell[rows, f], grad[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(cell[rows, f], hess[rows], len(e) + 1))[:-1]
            gr, hr = g - gl, h - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            better = gain(gl, hl, vl) + gain(gr, hr, vr) - whole
            better[(hl < least) | (hr < least) | (signs[f] * (vr - vl) < 0)] = -np.inf
            k = int(np.argmax(better))
            if better[k] > best[0]:
                best = (float(better[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return at
        to_left = cell[rows, f] <= k
        middle = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[signs[f]]
        nodes[at][0], nodes[at][1] = f, float(edges[f][k])
        nodes[at][2] = build(rows[to_left], level + 1, *bounds[0], grad, hess)
        nodes[at][3] = build(rows[~to_left], level + 1, *bounds[1], grad, hess)
        return at

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(build(everything, 0, -np.inf, np.inf, p - y, p * (1 - p)))
        node = np.full(len(y), roots[-1])
        table = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        for _ in range(depth):
            f = table[0][node]
            node = np.where((f < 0) | (x[everything, f] <= table[1][node]), table[2][node], table[3][node])
        margin += np.array([n[4] for n in nodes])[node]
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Trees(np.array(roots), *columns, depth=depth, start=start)


STATS = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("features", pa.list_(pa.float64()))])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and the list of FEATURES of every text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = [statistics(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*(e[0] for e in each), strict=True)), pa.array([e[1] for e in each], pa.list_(pa.float64()))], schema=STATS)

    return id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Trees | None:
    """Grow trees on at most `max_rows` labelled documents, chosen by a hash of doc_id. None without labels of both kinds."""
    picked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    picked = picked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = dict(map(tuple, picked.collect()))  # max_rows pairs at most
    if len(set(chosen.values())) < 2:
        return None
    bounded = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long"))
    found = document_statistics(docs.join(bounded, "doc_id", "left_semi")).select("doc_id", "features").groupBy("doc_id").agg(F.max("features").alias("features")).orderBy("doc_id").collect()
    y = np.array([chosen[r.doc_id] for r in found], float)
    if len(set(y)) < 2:
        return None
    return grow(np.array([r.features for r in found]), y, list(FEATURES.values()))


def _judge(trees: Trees | None, each: list[tuple[list[int], list[float]]], reject_below: float) -> tuple[list[bool], list[bool], np.ndarray]:
    score = trees.score(np.array([e[1] for e in each]).reshape(len(each), -1)) if trees and each else np.ones(len(each))
    failed = [base_failed(e[0][0], e[0][4]) for e in each]
    return failed, [not f and bool(s >= reject_below) for f, s in zip(failed, score, strict=True)], score


OUT = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def score_documents(docs: DataFrame, trees: Trees | None, reject_below: float = 0.5) -> DataFrame:
    """Counts and verdict of every row: doc_id, COUNTS, base_failed, kept, score.

    Null and empty texts have counts of 0 and fail; repeated rows are judged each; without trees all that pass the base
    rules are kept. Texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = [statistics(t or "") for t in part.column(1).to_pylist()]
            failed, kept, score = _judge(trees, each, reject_below)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*(e[0] for e in each), strict=True)), pa.array(failed), pa.array(kept), pa.array(score)], schema=OUT)

    return id_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, trees: Trees | None, reject_below: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score_documents() keeps. No shuffle: rows are judged where they are read."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = _judge(trees, [statistics(t or "") for t in part.column(at).to_pylist()], reject_below)[1]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
