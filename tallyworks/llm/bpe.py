"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash (hash, displace; as many slots as tokens) resolves pre-tokens that are in the vocabulary
as they stand. Tier two: the rest is merged lowest rank first, by a heap of candidate pairs over a doubly linked list of
parts that starts with the single bytes. Both give the ids of the public rank-file encoders.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import gathered, id_text, once, slices
from .pretoken import PieceMemo

_MASK = 0xFFFFFFFF


def load_ranks(data: bytes) -> list[bytes]:
    """Tokens by id, from a rank file (lines of base64 token and rank)."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in data.splitlines() if line)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of byte strings to their ids; unknown strings give -1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[(h >> 32) % self.buckets].append(i)
        displace = [0] * self.buckets
        slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free_from = 0
        for b in order:
            group = groups[b]
            if len(group) > 1:
                d = 1
                while True:
                    at = {self._slot(hashes[i], d) for i in group}
                    if len(at) == len(group) and all(slots[s] < 0 for s in at):
                        break
                    d += 1
                displace[b] = d
                for i in group:
                    slots[self._slot(hashes[i], d)] = i
            elif group:  # a lone key goes straight to a free slot, kept as a negative number
                while slots[free_from] >= 0:
                    free_from += 1
                slots[free_from] = group[0]
                displace[b] = -free_from - 1
        self.displace, self.slots, self.keys = displace, slots, keys

    def _slot(self, h: int, d: int) -> int:
        x = ((h & _MASK) ^ (d * 0x9E3779B1)) & _MASK
        x = ((x ^ (x >> 15)) * 0x85EBCA6B) & _MASK
        return (x ^ (x >> 13)) % self.n

    def get(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[(h >> 32) % self.buckets]
        token = self.slots[-d - 1 if d < 0 else self._slot(h, d)]
        return token if self.keys[token] == key else -1


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.whole = PerfectHash(tokens)
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.bits = max(16, len(tokens).bit_length())
        #: (left id << bits | right id) -> id of the two joined; the smaller the id, the earlier the merge. None is 0.
        self.pairs = {(left << self.bits) | right: i for i, t in enumerate(tokens) for k in range(1, len(t)) if (left := ids.get(t[:k])) is not None and (right := ids.get(t[k:])) is not None}
        #: The same for two bytes, 0 where they don't merge.
        self.byte_pairs = [self.pairs.get((self.byte_ids[a] << self.bits) | self.byte_ids[b], 0) for a in range(256) for b in range(256)]
        self._le = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.memo = PieceMemo(self.encode_match, pattern, limit=450_000)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token that isn't in the vocabulary.

        A heap entry is the rank of a merge, then the place of its left part; `now` holds the entry that is valid at each
        place, 0 if none. Both are kept in few bits, since small integers are quicker.
        """
        pairs, first, bits, n = self.pairs.get, self.byte_pairs, self.bits, len(data)
        shift = max(16, n.bit_length())
        mask = (1 << shift) - 1
        parts = list(map(self.byte_ids.__getitem__, data))
        if n < 2:
            return parts
        now, heap, left = [], [], data[0]
        for i, right in enumerate(data[1:]):
            entry = first[left << 8 | right]
            if entry:
                entry = entry << shift | i
                heap.append(entry)
            now.append(entry)
            left = right
        now.append(0)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if now[i] != entry:
                continue  # one side has been merged since
            j = after[i]
            parts[i] = rank = entry >> shift
            parts[j] = -1
            now[i] = now[j] = 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                joined = pairs(rank << bits | parts[k])
                if joined:
                    now[i] = entry = joined << shift | i
                    heappush(heap, entry)
            h = before[i]
            if h >= 0:
                joined = pairs(parts[h] << bits | rank)
                if joined:
                    now[h] = entry = joined << shift | h
                    heappush(heap, entry)
                else:
                    now[h] = 0
        return [p for p in parts if p >= 0]

    def encode_match(self, match: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        data = match.encode("utf-8", "surrogatepass")
        token = self.whole.get(data)
        return self._le[token] if token >= 0 else b"".join([self._le[i] for i in self.merge(data)])

    def encode(self, text: str) -> bytes:
        return self.memo.text(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
OUT_TEXT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode every text, then decode the ids.

    Returns doc_id, n_tokens and the ids (binary, little-endian 32-bit) with the decoded text, or with `digests` their SHA-256
    instead. One row for each input row, repeated rows included. Null text counts as empty: no ids. Texts of any length are
    whole: a pre-token of n bytes takes n log n steps. The vocabulary is read on the driver and broadcast (fixed size).
    """
    data = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    key = f"bpe-{ranks_path}-{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: Bpe = once(key, lambda: Bpe(load_ranks(data.value), pattern))

        def rows() -> Iterator[tuple]:
            for part in slices(batches):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = bpe.encode(text or "")
                    back = bpe.decode(ids)
                    if digests:
                        yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()
                    else:
                        yield doc_id, len(ids) // 4, ids, back.decode("utf-8", "replace")

        yield from gathered(rows(), OUT if digests else OUT_TEXT)

    kind = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return id_text(docs).mapInArrow(run, kind)
