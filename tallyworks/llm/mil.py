"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by hashed and statistical features and a learned layer; gated
attention (Ilse, Tomczak and Welling 2018) weighs the passages, and the weighted sum is scored. Weights are learned from
labels of documents only, on a bounded sample (`max_rows`); then all documents are scored, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

#: Words of a passage, and the folded byte-pair counts that it is described by besides its byte classes.
PASSAGE, PAIRS = 64, 64
#: Byte classes: lower case, upper case, digits, white space, sentence marks, shouting, symbols, pipes, other ASCII, continuation.
_CLASS = np.full(256, 8, np.int64)
for _bytes, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\n\x0b\x0c", 3), (b".,;:?", 4), (b"!", 5), (b"#*$%&<>", 6), (b"|", 7)):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _k
_CLASS[128:] = 9
CLASSES = 10
WIDTH = CLASSES * CLASSES + PAIRS + 4


def passages(data: bytes) -> list[bytes]:
    """Runs of PASSAGE words; a document without words has one empty passage."""
    words = data.split()
    return [b" ".join(words[k : k + PASSAGE]) for k in range(0, len(words), PASSAGE)] or [b""]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the text of each passage."""
    return encode_passages([passages(t.encode("utf-8", "surrogatepass")) for t in texts])


def encode_passages(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    parts, owner = [p for bag in bags for p in bag], [b for b, bag in enumerate(bags) for _ in bag]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.repeat(np.arange(len(parts)), lengths)
    # neighbours that lie in one passage
    pair = np.flatnonzero(inside[1:] == inside[:-1]) if len(raw) else np.zeros(0, np.int64)
    kinds = _CLASS[raw]
    n = len(parts)
    per = 1 / np.maximum(lengths - 1, 1)
    transitions = np.bincount(inside[pair] * CLASSES * CLASSES + kinds[pair] * CLASSES + kinds[pair + 1], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES) * per[:, None]
    folded = (raw[pair].astype(np.int64) * 31 + raw[pair + 1]) % PAIRS
    pairs = np.bincount(inside[pair] * PAIRS + folded, minlength=n * PAIRS).reshape(n, PAIRS) * per[:, None]
    words = [p.split() for p in parts]
    rest = np.array([[len(w) / PASSAGE, len(set(w)) / max(len(w), 1), len(p) / max(len(w), 1) / 10, float(not w)] for p, w in zip(parts, words, strict=True)]).reshape(n, 4)
    return np.concatenate([np.sqrt(transitions), np.sqrt(pairs), rest], 1).astype(np.float32), np.array(owner, np.int64)


@dataclass
class Model:
    """h = tanh(z W + b) for standardised features z; attention a = softmax(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(c . sum a h)."""

    mean: np.ndarray
    scale: np.ndarray
    w_in: np.ndarray
    b_in: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.w_in + self.b_in)
        t, g = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = np.exp(np.clip((t * g) @ self.w, -30, 30))
        a = e / np.bincount(owner, e, bags)[owner]
        bag = np.stack([np.bincount(owner, a * h[:, k], bags) for k in range(h.shape[1])], 1)
        p = 1 / (1 + np.exp(-np.clip(bag @ self.c + self.c0[0], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "p": p}


def gradients(m: Model, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the bags, by hand."""
    f = m.forward(x, owner, len(y))
    d_score = (f["p"] - y) / len(y)
    d_bag = d_score[:, None] * m.c
    # through the weighted sum: to h directly, and to the attention weights
    d_a = (d_bag[owner] * f["h"]).sum(1)
    d_e = f["a"] * (d_a - np.bincount(owner, f["a"] * d_a, len(y))[owner])
    d_tg = d_e[:, None] * m.w
    d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
    d_h = f["a"][:, None] * d_bag[owner] + d_t @ m.v.T + d_g @ m.u.T
    d_in = d_h * (1 - f["h"] ** 2)
    return {"w_in": f["z"].T @ d_in, "b_in": d_in.sum(0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_e, "c": f["bag"].T @ d_score, "c0": np.array([d_score.sum()])}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, l2: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss of the documents. Features stay single until their batch is used."""
    rng = np.random.default_rng(seed)
    m = Model(x.mean(0, np.float64), x.std(0, np.float64) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, gate**-0.5, gate), rng.normal(0, hidden**-0.5, hidden), np.array([np.log((y.mean() + 0.01) / (1.01 - y.mean()))]))
    names = ("w_in", "b_in", "v", "u", "w", "c", "c0")
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    starts = np.searchsorted(owner, np.arange(len(y) + 1))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in chosen])
            own = np.repeat(np.arange(len(chosen)), starts[chosen + 1] - starts[chosen])
            grads = gradients(m, x[rows], own, y[chosen])
            step += 1
            for k in names:
                value = getattr(m, k)
                g = grads[k] + l2 * value
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(m, k, value - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return Model(**{k: np.asarray(getattr(m, k), np.float64) for k in Model.__dataclass_fields__})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_passages: int = 200_000) -> Model | None:
    """Fit on at most `max_rows` labelled documents that are not held out, chosen by a hash of doc_id. None without both kinds.

    A document of the sample is learned from whole. The driver holds at most `max_passages` passages: a document that would
    exceed this is left out of the sample, in the order of the hash. Both bound the fit only: all documents are scored.
    """
    seen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out())
    picked = seen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = dict(map(tuple, picked.collect()))  # max_rows pairs at most
    if len(set(chosen.values())) < 2:
        return None
    bounded = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long"))
    texts = id_text(docs).join(bounded, "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bags = [passages(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
            bags = [b if len(b) <= max_passages else [] for b in bags]
            x, owner = encode_passages(bags)
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "x"])

    found = texts.mapInArrow(features, "doc_id long, x binary").groupBy("doc_id").agg(F.max("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id")
    bags, y, held = [], [], 0
    for r in found.toLocalIterator():
        n = len(r.x) // 4 // WIDTH
        if not n or held + n > max_passages:
            continue
        held += n
        bags.append(np.frombuffer(r.x, "<f4").reshape(-1, WIDTH))
        y.append(chosen[r.doc_id])
    if len(set(y)) < 2:
        return None
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array(y, float))


def held_out() -> F.Column:
    """Rows whose labels are never learned: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int32()), ("top_weight", pa.float64())])


def score_documents(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), n_passages, top_weight (largest attention).

    Only the text is an input of the score. Null and empty texts are one empty passage and get a score like any other;
    repeated rows are scored each; without a model every score is 0.5. A long text has more passages, none left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            x, owner = encode([t or "" for t in texts])
            f = model.forward(x, owner, len(texts)) if model else {"p": np.full(len(texts), 0.5), "a": 1 / np.bincount(owner)[owner]}
            top = np.zeros(len(texts))
            np.maximum.at(top, owner, f["a"])
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(f["p"]), pa.array((f["p"] >= threshold).astype(np.int32)), pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32)), pa.array(top)], schema=OUT)

    return id_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages int, top_weight double")
