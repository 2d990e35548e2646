"""Repeated passages: runs of `words` words or more that stand earlier in the corpus, wherever sentences and lines end.

Every window of `words` words has a minimizer, the smallest hash of its grams of half that length. Equal windows have equal
minimizers, so only windows whose minimizer stands in two places can repeat: a first pass writes the minimizers (about one for
thirteen words), a second the digests of such windows, which are grouped globally with partial aggregates. Nothing is sampled:
a window that repeats is found whatever the hashes are, and one that doesn't is told apart by 128 bits of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_key
from .line_dedup import UNSPACED, cut_out

#: Words of a window, the shortest passage that counts.
WORDS = 50
_BLANKS = r" \t\n\x0b\x0c\r"
_LETTER = re.compile(f"[{UNSPACED}]")
#: A word is a letter of a script without spaces, or a run of anything else without ASCII white space.
_WORD = re.compile(f"[{UNSPACED}]|[^{UNSPACED}{_BLANKS}]+")
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased."""
    return _LETTER.sub(r" \g<0> ", text).encode("utf-8", "surrogatepass").lower().split()


def minimizers(words: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `size` words the place of its smallest gram (leftmost of equal ones), and that gram's hash."""
    n, gram = len(words), (size + 1) // 2
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (_ODD, _BACK))
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up[:-1], dtype=np.uint64)]
    grams = (sums[gram:] - sums[:-gram]) * back[: n - gram + 1]  # of the words alone, not of their place
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(_ODD)
    grams ^= grams >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(1) + np.arange(n - size + 1)
    return at, grams[at].view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("row_key")).where("doc_id is not null and text is not null")


def _grams(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, row_key, gram: the minimizers of every text, one row for each place."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for text in part.column(1).to_pylist():
                at, grams = minimizers(words_of(text), size)
                found.append(grams[np.r_[True, at[1:] != at[:-1]]] if len(at) else grams)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], schema=schema)

    return texts.mapInArrow(run, "doc_id long, row_key long, grams array<long>").select("doc_id", "row_key", F.explode("grams").alias("gram"))


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """high, low (digest of the words), doc_id, row_key, at (first word), start, stop of the windows whose minimizer is in `hot`."""
    names = ("high", "low", "doc_id", "row_key", "at", "start", "stop")

    def windows(doc_id: int, text: str, key: int, hot: list[int]) -> pa.RecordBatch | None:
        words = words_of(text)
        at = np.flatnonzero(np.isin(minimizers(words, size)[1], np.array(hot, np.int64)))
        if not len(at):
            return None
        plain, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        opens, closes = np.r_[0, ends[:-1]][at].tolist(), (ends[at + size - 1] - 1).tolist()
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(plain[a:b]) for a, b in zip(opens, closes, strict=True)]), np.int64).reshape(-1, 2)
        spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64)
        columns = (digests[:, 0], digests[:, 1], np.full(len(at), doc_id), np.full(len(at), key), at, spans[at, 0], spans[at + size - 1, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (made := windows(*row)) is not None:
                    yield from slices([made], 100_000)

    return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _passages(docs: DataFrame, size: int) -> DataFrame:
    texts = _texts(docs)
    grams = materialize(_grams(texts, size), "passage-grams")
    again = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    hot = grams.join(materialize(again, "repeated-grams"), "gram").groupBy("doc_id", "row_key").agg(F.collect_set("gram").alias("hot"))
    windows = materialize(_windows(texts.join(hot, ["doc_id", "row_key"]).select("doc_id", "text", "row_key", "hot"), size), "passage-windows")
    first = windows.groupBy("high", "low").agg(F.min(F.struct("doc_id", "row_key", "at", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("high", "low", "first")
    later = F.struct("doc_id", "row_key", "at", "start") != F.col("first")
    found = windows.join(materialize(first, "first-windows"), ["high", "low"]).where(later).select("doc_id", "row_key", "at", "start", "stop", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    along = Window.partitionBy("doc_id", "row_key").orderBy("at")
    runs = found.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(along) > size, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.min(F.struct("at", "kept_doc_id", "kept_start"))  # that of the first window
    ends = F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("at") - F.min("at") + size).alias("words"), kept.alias("kept")
    return runs.groupBy("doc_id", "row_key", "run").agg(*ends).select("doc_id", "row_key", "start", "stop", "words", "kept.kept_doc_id", "kept.kept_start")


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """What goes: doc_id, start, stop (code points of the original text, end exclusive), words, kept_doc_id, kept_start.

    A window of `words` words repeats if an equal one stands earlier by (doc_id, MD5 of the text, place). One row for each
    longest run of words that repeating windows cover, overlapping or side by side; kept_* is where the first of them stands
    first. Words are compared with A-Z lower-cased, whatever white space is between them; each letter of a script without
    spaces is a word. Every word of a run stands once more earlier, and at last in a place that is no part of any run. Null
    and empty texts and rows without doc_id have none; rows with one doc_id and one text are one text.
    """
    return _passages(docs, words).drop("row_key")


def without_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs, all columns, with the runs of repeated_passages() cut out of `text`."""
    return cut_out(docs, _passages(docs, words))


#: The same rows in DuckDB SQL.
SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, text, substr(md5(text), 1, 15) AS row_key FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
pieces AS (SELECT doc_id, row_key, regexp_extract_all(text, '[<U>][<B>]*|[^<U><B>]+[<B>]*|[<B>]+') AS parts FROM texts),
placed AS (SELECT doc_id, row_key, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM pieces),
spans AS (
  SELECT doc_id, row_key, k, regexp_replace(part, '[<B>]+$', '') AS word,
         coalesce(sum(length(part)) OVER (PARTITION BY doc_id, row_key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM placed),
words AS (
  SELECT doc_id, row_key, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, CAST(start AS BIGINT) AS start, CAST(start + length(word) AS BIGINT) AS stop,
         row_number() OVER (PARTITION BY doc_id, row_key ORDER BY k) AS pos
  FROM spans WHERE word <> ''),
lists AS (SELECT doc_id, row_key, list(word ORDER BY pos) AS words, list(start ORDER BY pos) AS starts, list(stop ORDER BY pos) AS stops FROM words GROUP BY ALL HAVING count(*) >= 50),
places AS (SELECT *, unnest(range(1, CAST(len(words) AS BIGINT) - 48)) AS pos FROM lists),
windows AS (SELECT doc_id, row_key, pos, starts[pos] AS start, stops[pos + 49] AS stop, md5(array_to_string(words[pos:pos + 49], ' ')) AS digest FROM places),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM windows
  WINDOW w AS (PARTITION BY digest ORDER BY doc_id, row_key, pos)),
later AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, row_key ORDER BY pos) > 50, true) AS fresh FROM ranked WHERE place > 1),
runs AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, row_key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM later)
SELECT doc_id, min(start) AS start, max(stop) AS stop, max(pos) - min(pos) + 50 AS words, min_by(kept_doc_id, pos) AS kept_doc_id, min_by(kept_start, pos) AS kept_start
FROM runs GROUP BY doc_id, row_key, run
""".replace("<U>", r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}").replace("<B>", r" \t\n\x0b\x0c\r")
