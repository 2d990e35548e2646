"""Secret scans: keyword automaton, anchored expressions only at its hits, checksums of tokens that carry one.

An Aho-Corasick automaton over the lower-cased text finds keywords in one pass; at each hit one anchored expression is
matched. Hex runs have no keyword; a run of the character class is its own prefilter. Kinds that carry a checksum are kept
only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gathered, id_text, once, slices

# Keywords by kind, and what must follow at a hit.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORDS = ("akia",)
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_WORDS = ("npm_",)
XPRV_WORDS = ("xprv",)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: Kinds in the order that breaks ties of start; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
LEAST = {"assign": 12, "access": 18}
_ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

Span = tuple[int, int, int]


def crc_base62_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    value, digits = zlib.crc32(match[1].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits == match[2]


def base58_holds(match: re.Match) -> bool:
    """The last four bytes are the double SHA-256 of the others."""
    value = 0
    for c in match[0]:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in ((0, ASSIGN_WORDS), (1, ACCESS_WORDS), (3, GITHUB_WORDS), (4, NPM_WORDS), (5, XPRV_WORDS)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find_secrets(text: str, keywords: ahocorasick.Automaton) -> list[Span]:
    """(start, kind number, end) in code points, in order. Within a kind spans are leftmost and don't overlap."""
    low = text.lower()
    if len(low) != len(text):  # a letter that becomes two when lower-cased would shift what follows
        low = text.translate(_ASCII_LOWER)
    spans: list[Span] = []
    past = [0] * len(KINDS)
    for last, (kind, n) in keywords.iter(low):
        at = last - n + 1
        if at < past[kind]:
            continue
        match = (ASSIGN, ACCESS, None, GITHUB, NPM, XPRV)[kind].match(text, at)
        if not match:
            continue
        past[kind] = match.end()  # what fails below still takes up its place
        if kind == 0:
            good = len(match[2]) >= LEAST["assign"]
        elif kind == 1:
            good = len(match[0]) >= LEAST["access"]
        else:
            good = base58_holds(match) if kind == 5 else crc_base62_holds(match)
        if good:
            spans.append((at, kind, match.end()))
    spans.extend((m.start(), 2, m.end()) for m in HEX.finditer(text))
    spans.sort()
    return spans


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span, or union of spans that overlap, replaced by `mark`."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have none (the digest is that of the empty string). Repeated rows are scanned each. Texts of any
    length are read whole, in time proportional to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = once("secret-keywords", automaton)

        def rows() -> Iterator[tuple]:
            for part in slices(batches):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    spans = find_secrets(text or "", keywords)
                    base = [s for s in spans if s[1] < 3]
                    n = [sum(s[1] == k for s in base) for k in range(3)]
                    yield doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

        yield from gathered(rows(), OUT)

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns, with secrets in `text` replaced; `n_chars`, where there is one, follows. Null texts stay null."""
    at, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = once("secret-keywords", automaton)
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            after = [t if not t or not (s := find_secrets(t, keywords)) else redact(t, s) for t in texts]
            columns = list(part.columns)
            columns[at] = pa.array(after, part.schema.field(at).type)
            if length >= 0:
                changed = [n if new is old else len(new) for n, new, old in zip(columns[length].to_pylist(), after, texts, strict=True)]
                columns[length] = pa.array(changed, part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
