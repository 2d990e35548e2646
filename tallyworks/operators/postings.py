"""Substring search by postings: which rows hold which runs of one, two or three characters.

The index is written in segments, one for each task, without a shuffle: rows (gram, ids), sorted by gram, so that a search
reads the row groups of its own grams. Lists are intersected, the shortest ones of each search word; what is left is verified
by the text itself, so results are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import scratch
from .search import matches_tokens

#: Characters of a block of rows whose lists are built together, and how many of its rarest grams a word is looked up by.
BLOCK_CHARS, RAREST = 4 << 20, 3
#: Up to so many candidates are named in the filter of the scan that verifies them; more are joined.
NAMED = 1000


def grams(text: str) -> np.ndarray:
    """The distinct runs of one to three characters as numbers of 63 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return np.unique(np.concatenate([c, c[:-1] | c[1:] << 21, c[:-2] | c[1:-1] << 21 | c[2:] << 42]))


def needed(word: str) -> list[int]:
    """The grams that a text with this word has, as far as they say something: the word itself if it is short, else its runs of three."""
    n = min(3, len(word))
    codes = [ord(x) + 1 for x in word]
    return sorted({sum(code << 21 * k for k, code in enumerate(codes[i : i + n])) for i in range(len(word) - n + 1)})


def build(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """gram, ids: postings of the fields' text in lower case, written to the shared folder. Null fields hold nothing."""
    text = F.lower(F.concat_ws("\n", *[F.col(f).cast("string") for f in fields]))  # a search word holds no line break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            gram = np.concatenate([g for _, g in found])
            ids = np.repeat(np.array([i for i, _ in found], np.int64), [len(g) for _, g in found])
            order = np.argsort(gram, kind="stable")
            gram, ids = gram[order], ids[order]
            starts = np.flatnonzero(np.diff(gram, prepend=gram[:1] - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), pa.array(ids))
            return pa.RecordBatch.from_arrays([pa.array(gram[starts]), lists], names=["gram", "ids"])

        for batch in batches:
            for row_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t and row_id is not None:
                    found.append((row_id, grams(t)))
                    size += len(t)
                    if size >= BLOCK_CHARS:
                        yield block()
                        found, size = [], 0
        if found:
            yield block()

    path = scratch(df.sparkSession, "postings")
    rows = df.select(F.col(id_col).cast("long"), text.alias("t")).mapInArrow(run, "gram long, ids array<long>")
    rows.sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).parquet(path)
    return df.sparkSession.read.schema("gram long, ids array<long>").parquet(path)


def candidates(index: DataFrame, text: str, rarest: int = RAREST) -> DataFrame | None:
    """id: rows that hold the rarest grams of every word; None where the text has no word."""
    words = [needed(w) for w in dict.fromkeys(text.lower().split())]
    if not words:
        return None
    every = sorted({g for w in words for g in w})
    held = index.where(F.col("gram").isin(every)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()  # a row for each gram of the text
    n = {r.gram: r.n for r in held}
    chosen = sorted({g for w in words for g in sorted(w, key=lambda g: n.get(g, 0))[:rarest]})
    number = F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << i)) for i, g in enumerate(chosen[:62])])
    lists = index.where(F.col("gram").isin(chosen[:62])).select(F.explode("ids").alias("id"), number.cast("long").alias("bit"))
    return lists.groupBy("id").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == (1 << len(chosen[:62])) - 1).select("id")


def search(index: DataFrame, df: DataFrame, id_col: str, fields: list[str], text: str) -> DataFrame:
    """Rows of df every word of the text stands in, in some field, whatever its case: search.matches_tokens() without a scan of all texts.

    An empty text finds all rows with an id.
    """
    found = candidates(index, text)
    if found is None:
        return df.where(F.col(id_col).isNotNull())
    few = [r.id for r in found.limit(NAMED + 1).collect()]
    some = df.where(F.col(id_col).isin(few)) if len(few) <= NAMED else df.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
    return some.where(matches_tokens(text, [F.col(f) for f in fields]))


def search_all(index: DataFrame, df: DataFrame, id_col: str, fields: list[str], texts: list[str]) -> DataFrame:
    """query, id of several search texts."""
    found = [search(index, df, id_col, fields, t).select(F.lit(t).alias("query"), F.col(id_col)) for t in texts]
    return reduce(DataFrame.unionByName, found)
