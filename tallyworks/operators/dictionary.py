"""Texts against a dictionary that is a table: one automaton of all its words, made in each worker from the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import scratch

#: Words of one automaton; larger dictionaries are matched block by block, one automaton at a time in a worker.
BLOCK_WORDS = 100_000
_held: dict[str, tuple] = {}


def _automaton(path: str, block: int) -> ahocorasick.Automaton | None:
    """Of one block of words, each with its number; the last one that a worker used is kept."""
    key = f"{path}/block={block}"
    if key not in _held:
        _held.clear()
        fs, at = pafs.FileSystem.from_uri(key)
        made = ahocorasick.Automaton()
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            read = pq.read_table(at, filesystem=fs, partitioning=None)
            for word, number in zip(read["word"].to_pylist(), read["number"].to_pylist(), strict=True):
                made.add_word(word, number)
        if len(made):
            made.make_automaton()
        _held[key] = (made if len(made) else None,)
    return _held[key][0]


def matches(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, word, n: how often (overlaps included) each word of `words` (column word) stands in a text, both in lower case.

    The words are numbered and written to the shared folder, never to the driver; texts are read once and whole. Null and
    empty words match nothing, null texts hold nothing; a text without words has no rows, repeated rows are counted each.
    """
    spark = texts.sparkSession
    known = words.select(F.lower(F.col("word").cast("string")).alias("word")).where("word != ''").distinct()
    blocks = max(1, -(-known.count() // block_words))
    path = scratch(spark, "dictionary")
    numbered = known.select("word", F.xxhash64("word").alias("number"), F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"))
    numbered.repartition(blocks, "block").write.partitionBy("block").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(blocks):
                automaton = _automaton(path, block)
                rows, numbers, counts = [], [], []
                for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found: dict[int, int] = {}
                    for _, number in automaton.iter(text) if automaton and text else ():
                        found[number] = found.get(number, 0) + 1
                    rows += [row_id] * len(found)
                    numbers += found
                    counts += found.values()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, batch.column(0).type), pa.array(numbers, pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "number", "n"])

    low = texts.select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("text"))
    kind = f"{id_col} {texts.schema[id_col].dataType.simpleString()}, number long, n long"
    back = spark.read.schema("word string, number long, block int").parquet(path).select("word", "number")
    return low.mapInArrow(run, kind).join(back, "number").select(id_col, "word", "n")


def domains(texts: DataFrame, entries: DataFrame, id_col: str, text_col: str, otherwise: str = "general") -> DataFrame:
    """id, domains: the domains (sorted, by commas) one of whose words a text holds, `otherwise` where there is none. entries: domain, word."""
    low = entries.select("domain", F.lower("word").alias("word")).distinct()
    found = matches(texts, low, id_col, text_col).join(low, "word").groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    return texts.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("domains", F.lit(otherwise)).alias("domains"))


def best_entry(texts: DataFrame, entries: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """id, entry, score: of each text the entry whose words in it weigh most, `least` or more; ties: the smaller entry.

    entries: entry, word, weight; a word counts once a text, whatever its occurrences.
    """
    low = entries.select("entry", F.lower("word").alias("word"), "weight")
    scored = matches(texts, low, id_col, text_col).join(low, "word").groupBy(id_col, "entry").agg(F.sum("weight").alias("score"))
    best = scored.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("less"), "entry")).alias("b"))
    return best.select(id_col, "b.entry", (-F.col("b.less")).alias("score")).where(F.col("score") >= least)
