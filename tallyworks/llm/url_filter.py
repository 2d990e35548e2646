"""URL filters by a bit-parallel wildcard automaton: every rule is a glob, all globs share one Shift-And state of many words.

A glob takes a start bit and one bit for each item (a literal, `?` or a class); `*` lets the bit before it stay. One step over a
code point c is D = (D << 1 & B[c]) | (D & STAY) over 64-bit words with the carry between them, for a whole block of URLs at
once (numpy: rows by words). What a code point does is the same for all that no rule names, so B has few rows.

Globs match the whole canonical URL: `.`, the host with A-Z in lower case, `#`, the path. Neither host nor path can hold `#`,
so `*.net#/*` is the host net and all that is below it, with any path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, slices


class Rule(NamedTuple):
    """verdict for a host with all its subdomains, where the path begins with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{escaped(self.host)}#{escaped(self.path)}*"


class Glob(NamedTuple):
    verdict: str
    pattern: str


#: The rules of hosts and paths.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: What else decides, first match first: hosts that name their trade, numeric hosts, and files that hold no text. Else allow.
GLOBS = (
    *(Glob("block", f"*{w}*#*") for w in ("spam-", "cheap-", "-pills", "casino", "adult-", "free-money", "torrent")),
    Glob("block", ".[0-9]*.[0-9]*.[0-9]*.[0-9]#*"),
    *(Glob("block", f"*#*.{ending}") for ending in ("jpg", "jpeg", "png", "gif", "webp", "css", "js", "zip", "gz", "exe", "mp3", "mp4")),
)
#: The state of a block of URLs takes at most about this many bytes.
BLOCK_BYTES = 1 << 20


def escaped(text: str) -> str:
    """A glob of exactly this text."""
    return "".join(f"[{c}]" if c in "*?[" else c for c in text)


def items(glob: str) -> tuple[list[tuple[bool, frozenset[str], tuple[tuple[str, str], ...]]], list[bool]]:
    """Items of a glob as (negated, characters, ranges), and for each place from the start whether a star stands there."""
    out, stay, at = [], [False], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            stay[-1], at = True, at + 1
            continue
        if c == "?":
            item, at = (True, frozenset(), ()), at + 1
        elif c == "[" and (end := glob.find("]", at + 2)) > 0:
            body, negated = glob[at + 1 : end], False
            if len(body) > 1 and body[0] in "!^":
                body, negated = body[1:], True
            ranges, single = [], set()
            while body:
                if len(body) > 2 and body[1] == "-":
                    ranges.append((body[0], body[2]))
                    body = body[3:]
                else:
                    single.add(body[0])
                    body = body[1:]
            item, at = (negated, frozenset(single), tuple(ranges)), end + 1
        else:
            item, at = (False, frozenset(c), ()), at + 1
        out.append(item)
        stay.append(False)
    return out, stay


class Automaton:
    """All globs at once. The masks take globs x length bits for each class of code points that the globs tell apart."""

    def __init__(self, globs: Sequence[str]):
        parsed = [items(g) for g in globs]
        # code points between two bounds are alike to every glob
        bounds = {0, 0x110000}
        for found, _ in parsed:
            for _, single, ranges in found:
                for low, high in [*((c, c) for c in single), *ranges]:
                    bounds |= {ord(low), ord(high) + 1}
        self.bounds = np.array(sorted(bounds), np.uint32)
        n_bits = sum(len(stay) for _, stay in parsed)
        self.words = max(1, -(-n_bits // 64))
        first = self.bounds[:-1]
        self.masks, self.stay, self.start = np.zeros((len(first), self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.accept, at = [], 0
        for found, stay in parsed:
            self._set(self.start, at)
            for k, (item, stays) in enumerate(zip([None, *found], stay, strict=True)):
                if stays:
                    self._set(self.stay, at + k)
                if item:
                    negated, single, ranges = item
                    hit = np.zeros(len(first), bool)
                    for low, high in [*((c, c) for c in single), *ranges]:
                        hit |= (first >= ord(low)) & (first <= ord(high))
                    self.masks[hit ^ negated, (at + k) >> 6] |= np.uint64(1 << ((at + k) & 63))
            at += len(stay)
            self.accept.append(at - 1)
        self.accept = np.array(self.accept, np.int64)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit >> 6] |= np.uint64(1 << (bit & 63))

    def block_rows(self) -> int:
        return max(1, BLOCK_BYTES // (8 * self.words))

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Rows by globs: whether the whole text matches."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), self.block_rows()):
            rows = order[at : at + self.block_rows()]
            out[rows] = self._block([texts[i] for i in rows])
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        """Of texts, the longest first: those that have ended keep their state. Code points are laid out a stretch at a time."""
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        lengths, stretch = np.array([len(t) for t in texts]), 256
        for began in range(0, int(lengths[0]), stretch):
            some = int((lengths > began).sum())
            codes = np.zeros((some, stretch), np.int32)
            for i in range(some):
                part = np.frombuffer(texts[i][began : began + stretch].encode("utf-32-le", "surrogatepass"), np.uint32)
                codes[i, : len(part)] = np.searchsorted(self.bounds, part, "right") - 1
            for k in range(min(stretch, int(lengths[0]) - began)):
                live = int((lengths[:some] > began + k).sum())
                d = state[:live]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.masks[codes[:live, k]]) | (d & self.stay)
        return state[:, self.accept >> 6] >> (self.accept & 63).astype(np.uint64) & np.uint64(1) > 0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no `://`."""
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, part, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, part, 2), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, glob of every row.

    The longest rule that fits decides (of equal length, the one listed first); else the first glob that matches, named in
    `glob`; else `default`. A null url, or one without `://`, has empty host and path and is judged as such; repeated rows are
    judged each; URLs are read whole, whatever their length. Only page_id and url are read; needs no shuffle. Rules and globs
    are fixed values of the job: their masks take about (rules x length) / 8 bytes for each class of code points.
    """
    rules = tuple(sorted(dict.fromkeys(rules), key=lambda r: -len(r.name)))
    patterns = [r.glob for r in rules] + [g.pattern for g in globs]
    names, verdicts = [r.name for r in rules], [*(r.verdict for r in rules), *(g.verdict for g in globs), default]
    kind = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("glob", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = once(f"globs-{patterns}", lambda: Automaton(patterns))
        for part in slices(batches, 4096):
            urls = [f".{h}#{p}" for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            hits = np.column_stack([automaton.matches(urls), np.ones(len(urls), bool)])
            first = hits.argmax(1).tolist()
            rule = [names[k] if k < len(names) else None for k in first]
            glob = [patterns[k] if len(names) <= k < len(patterns) else None for k in first]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array([verdicts[k] for k in first], pa.string()), pa.array(glob, pa.string())], schema=kind)

    host, path = host_path(F.col("url").cast("string"))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return read.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, glob string")


def _sql() -> str:
    """The same verdicts by string functions: rules by the ends and beginnings of hosts and paths, globs as expressions."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    fits = lambda r: f"ends_with('.' || host, {quote('.' + r.host)}) AND starts_with(path, {quote(r.path)})"
    regex = lambda g: "(?s)" + "".join("." if c == "?" else ".*" if c == "*" else c if c in "[]-" or c.isalnum() else f"[{c}]" for c in g)
    when = lambda pairs: " ".join(f"WHEN {a} THEN {quote(b)}" for a, b in pairs)
    hit = lambda g: f"regexp_full_match('.' || host || '#' || path, {quote(regex(g.pattern))})"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     k AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {when((fits(r), r.name) for r in ordered)} END AS rule,
       CASE {when((fits(r), r.verdict) for r in ordered)} {when((hit(g), g.verdict) for g in GLOBS)} ELSE 'allow' END AS verdict,
       CASE WHEN {" OR ".join(f"({fits(r)})" for r in ordered)} THEN NULL {when((hit(g), g.pattern) for g in GLOBS)} END AS glob
FROM k
"""


SQL = _sql()
