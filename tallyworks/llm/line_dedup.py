"""Substring dedup by paragraph hashing: normalised units, digests grouped globally, the earliest occurrence kept.

A paragraph is reflowed (line breaks count as blanks, so that wrapping doesn't matter) and cut at its sentence marks; every
piece of `min_words` words or more is a unit, in scripts without spaces one of `min_letters` letters of them; 1 takes every
piece. Shorter ones recur by chance or as boilerplate and stay. A digest is counted
with partial aggregates, so a unit that a third of all documents hold is one row for each task before the shuffle; the join
back to occurrences is split where it is skewed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import gathered, materialize, slices, text_key

#: Least words of a unit, about an ordinary sentence; and letters, in scripts that don't part words (Thai to Lao, Burmese, Khmer, kana, Han).
MIN_WORDS, MIN_LETTERS = 15, 24
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
_UNSPACED = re.compile(f"[{UNSPACED}]")
_BLANKS = r" \t\n\x0b\x0c\r"
_BLANK = re.compile(rf"[{_BLANKS}]+")
#: A unit ends with a sentence mark before white space, a full-width mark, or a blank line; the white space belongs to it.
_END = re.compile(rf"[.!?][{_BLANKS}]+|[。！？][{_BLANKS}]*|\n[ \t\x0b\x0c\r]*\n[{_BLANKS}]*")
UNITS = pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())])


def normalise(unit: str) -> str:
    """Lower case, ASCII white space run together, none at the ends."""
    return _BLANK.sub(" ", unit).strip(" ").lower()


def units_of(text: str, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS) -> Iterator[tuple[str, int, int, int]]:
    """(normal form, start, stop, words) in code points; white space up to the next unit is part of it."""
    at = 0
    for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if stop > at:
            plain = normalise(text[at:stop])
            words = plain.count(" ") + 1
            if plain and (words >= min_words or len(plain) >= min_letters and len(_UNSPACED.findall(plain)) >= min_letters):
                yield plain, at, stop, words
        at = stop


def units(docs: DataFrame, min_words: int, min_letters: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in slices(batches):
                for d, t, key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for plain, start, stop, words in units_of(t, min_words, min_letters):
                        yield hashlib.md5(plain.encode("utf-8", "surrogatepass")).hexdigest(), d, key, start, stop, words

        yield from gathered(rows(), UNITS)

    text = F.col("text").cast("string")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("row_key")).where("doc_id is not null and text is not null")
    return held.mapInArrow(run, "digest string, doc_id long, row_key long, start long, stop long, words long")


def _repeats(docs: DataFrame, min_words: int, min_letters: int) -> DataFrame:
    found = materialize(units(docs, min_words, min_letters), "units")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "row_key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = F.struct("doc_id", "row_key", "start") != F.col("first")
    return found.join(materialize(first, "kept-units"), "digest").where(later).dropDuplicates(["doc_id", "row_key", "start"])


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """What goes: doc_id, start, stop (code points of the original text, end exclusive), words, kept_doc_id, kept_start.

    One row for each unit of which an equal one stands earlier by (doc_id, MD5 of the text, start). Null and empty texts and
    rows without doc_id have no units. Rows with one doc_id and one text are one text and are reported once; different texts
    with one doc_id are judged each. Texts of any length are read whole; an empty table gives no rows.
    """
    return _repeats(docs, min_words, min_letters).select("doc_id", "start", "stop", "words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, gone: pd.Series) -> pd.Series:
    def one(t: str | None, spans: list | None) -> str | None:
        if t is None or spans is None:
            return None
        out, at = [], 0
        for a, b in sorted((s["start"], s["stop"]) for s in spans):
            out.append(t[at:a])
            at = b
        return "".join([*out, t[at:]])

    return pd.Series([one(t, s) for t, s in zip(text, gone, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """docs, all columns, with the units of repeated_units() cut out of `text`. Other rows and columns stay as they are.

    The spans of a text are as many as its own repeated units. Joined by doc_id and text, so that what repeats in one text
    isn't cut out of another with the same doc_id.
    """
    return cut_out(docs, _repeats(docs, min_words, min_letters))


def cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans (doc_id, row_key, start, stop) of their texts, of which no two overlap."""
    gone = spans.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    row = F.struct(*docs.columns).alias("row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("row_key"))
    joined = own.join(gone, ["doc_id", "row_key"], "left").select("row", "gone")
    some = F.col("gone").isNotNull()  # only these texts go to Python
    text = F.when(some, _cut(F.when(some, F.col("row.text").cast("string")), "gone")).otherwise(F.col("row.text"))
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


#: The same rows in DuckDB SQL.
SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, text, substr(md5(text), 1, 15) AS row_key FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pieces AS (
  SELECT doc_id, row_key, regexp_extract_all(text, '(?s).*?(?:[.!?][ \t\n\x0b\x0c\r]+|[。！？][ \t\n\x0b\x0c\r]*|\n[ \t\x0b\x0c\r]*\n[ \t\n\x0b\x0c\r]*)|.+') AS parts
  FROM texts),
placed AS (SELECT doc_id, row_key, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM pieces),
spans AS (
  SELECT doc_id, row_key, lower(trim(regexp_replace(part, '[ \t\n\x0b\x0c\r]+', ' ', 'g'), ' ')) AS plain, length(part) AS n,
         coalesce(sum(length(part)) OVER (PARTITION BY doc_id, row_key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed),
units AS (
  SELECT doc_id, row_key, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, md5(plain) AS digest, CAST(length(plain) - length(replace(plain, ' ', '')) + 1 AS BIGINT) AS words,
         length(regexp_replace(plain, '[^\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}]', '', 'g')) AS letters
  FROM spans),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM units WHERE words >= 15 OR letters >= 24
  WINDOW w AS (PARTITION BY digest ORDER BY doc_id, row_key, start))
SELECT doc_id, start, stop, words, kept_doc_id, kept_start FROM ranked WHERE place > 1
"""
