"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 60-bit key of the text (59 bits of its hash, then whether doc_id is missing), then doc_id, so equal
texts stand together. Splitters are found by counting: each round puts candidate boundaries evenly inside the interval that
still holds a splitter, counts the exact bytes (and rows) below each across all partitions, and narrows the interval, until
a boundary is within tolerance or its cell is one key. Then rows are exchanged once, by shard and cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the hash, and how many of them (or of the range of doc_id) one round resolves.
HASH_BITS, ROUND_BITS = 60, 10
LEAST_ID = -(1 << 63)


def text_hash(text: Column) -> Column:
    """Sixty bits of the text's MD5; equal texts have equal hashes. Null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("binary"), F.lit(b""))), 1, 15), 16, 10).cast("long")


@dataclass
class Probe:
    """An interval of keys that holds splitters. With `h` set, keys of that hash and ids from low on; else hashes."""

    low: int
    bits: int
    below: int
    rows_below: int
    targets: list[int]
    h: int | None = None


@dataclass
class Splitter:
    """Keys (h, id) smaller than this are below; exact bytes and rows below."""

    h: int
    id: int
    below: int
    rows_below: int


def keyed(docs: DataFrame) -> DataFrame:
    """What sharding needs of each row; the text isn't carried."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(text.cast("binary"), F.lit(b"")))
    return docs.select(doc_id.alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *_key(text, doc_id))


def _key(text: Column, doc_id: Column) -> list[Column]:
    """h, the text's hash, odd for rows without doc_id, which stand behind the others of their text; and id.

    id is half of doc_id in order: differences of two can't overflow; ids 2k and 2k + 1 share a key and are never cut apart.
    Rows without doc_id have 32 bits that differ by row, so that copies without it can be cut apart too.
    """
    h = text_hash(text).bitwiseAND(F.lit(-2)) + doc_id.isNull().cast("long")
    return [h.alias("h"), F.coalesce(F.shiftright(doc_id, 1), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)).alias("id")]


def find_splitters(rows: DataFrame, shares: int, tolerance: float) -> list[Splitter]:
    """shares - 1 splitters of rows (h, id, size), none without rows. At most shares * 2 ** ROUND_BITS sums reach the driver a round.

    A splitter is put between two texts if one such boundary is within `tolerance` of a share, else between two documents.
    """
    total, n, least, most = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("id"), F.max("id")).first()
    slack = tolerance * total / shares
    open_probes = [Probe(0, HASH_BITS, 0, 0, [total * k // shares for k in range(1, shares)])] if n and shares > 1 else []
    done: dict[int, Splitter] = {}
    while open_probes:
        by_hash, by_id = [p for p in open_probes if p.h is None], [p for p in open_probes if p.h is not None]
        counts: dict[tuple, list[tuple[int, int, int]]] = {}
        if by_hash:
            bits, cut = by_hash[0].bits, max(0, by_hash[0].bits - ROUND_BITS)
            inside = rows if bits == HASH_BITS else rows.where(F.shiftright("h", bits).isin([p.low >> bits for p in by_hash]))
            for r in inside.groupBy(F.shiftright("h", cut).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
                counts.setdefault((None, r.cell << cut >> bits << bits), []).append((r.cell << cut, r.b, r.n))
        if by_id:
            bits, cut = by_id[0].bits, max(0, by_id[0].bits - ROUND_BITS)
            low = F.col("id") - F.lit(least)
            wanted = F.lit(False)
            for p in by_id:
                wanted = wanted | ((F.col("h") == p.h) & (F.shiftright(low, bits) == (p.low >> bits)))
            for r in rows.where(wanted).groupBy("h", F.shiftright(low, cut).alias("cell")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
                counts.setdefault((r.h, r.cell << cut >> bits << bits), []).append((r.cell << cut, r.b, r.n))
        then: dict[tuple, Probe] = {}
        for p in open_probes:
            cut = max(0, p.bits - ROUND_BITS)
            cells = sorted(counts.get((p.h, p.low), []))
            for target in p.targets:
                below, rows_below = p.below, p.rows_below
                for at, b, k in cells:
                    if below + b > target:
                        break
                    below, rows_below = below + b, rows_below + k
                else:
                    at, b, k = (cells[-1][0] + (1 << cut), 0, 0) if cells else (p.low, 0, 0)
                # the target lies in the cell at `at`: below it are `below` bytes, below the next boundary `below + b`
                first, last = (below, rows_below, at), (below + b, rows_below + k, at + (1 << cut))
                best = min((first, last), key=lambda x: abs(x[0] - target))
                if p.h is None and (abs(best[0] - target) <= slack or k <= 1):
                    done[target] = Splitter(best[2], LEAST_ID, best[0], best[1])
                elif p.h is None and cut:
                    then.setdefault((None, at), Probe(at, cut, below, rows_below, [])).targets.append(target)
                elif p.h is None:  # one text, too many copies of it: go on by doc_id
                    width = max(1, (most - least).bit_length())
                    width = -(-width // ROUND_BITS) * ROUND_BITS
                    then.setdefault((at, 0), Probe(0, width, below, rows_below, [], at)).targets.append(target)
                elif abs(best[0] - target) <= slack or not cut or k <= 1:
                    done[target] = Splitter(p.h, least + best[2], best[0], best[1])
                else:
                    then.setdefault((p.h, at), Probe(at, cut, below, rows_below, [], p.h)).targets.append(target)
        open_probes = list(then.values())
    return [done[total * k // shares] for k in range(1, shares)] if done else []


#: What orders the cells of a shard.
CELL = ["cell", "seq", "part"]


def _with_cells(rows: DataFrame, n: int, cell_rows: int) -> DataFrame:
    """rows (with `shard`) and the names of their cells: runs of the key order of about cell_rows rows each.

    Hashes are even, so a cell is a range of hashes. A text with more than cell_rows copies in a shard is set apart (`seq`
    counts such texts, and what lies between them, within the range) and cut by ranges of the id (`part`). Such texts are
    at most n / cell_rows; the join may broadcast them only where their size, known at run time, allows it.
    """
    bits = max(0, (-(-n // cell_rows) - 1).bit_length())
    named = rows.withColumn("cell", F.shiftright("h", HASH_BITS - bits))
    full = named.groupBy("shard", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("shard", "cell")
    copies = named.join(full, ["shard", "cell"], "left_semi").groupBy("shard", "cell", "h").agg(F.count("*").alias("n"), F.min("id").cast("double").alias("low"), F.max("id").cast("double").alias("high"))
    width = F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / F.lit(cell_rows)))
    hot = copies.where(F.col("n") > cell_rows).groupBy("shard", "cell").agg(F.sort_array(F.collect_list(F.struct("h", "low", width.alias("width")))).alias("hot"))
    joined = named.join(hot, ["shard", "cell"], "left").withColumn("own", F.get(F.filter("hot", lambda x: x.h == F.col("h")), F.lit(0)))
    before = F.coalesce(F.size(F.filter("hot", lambda x: x.h < F.col("h"))), F.lit(0))
    before = F.when(F.col("hot").isNull(), 0).otherwise(2 * before + F.col("own").isNotNull().cast("int"))
    part = F.coalesce(F.floor((F.col("id").cast("double") - F.col("own.low")) / F.col("own.width")), F.lit(0)).cast("long")
    return joined.withColumn("seq", before).withColumn("part", part).drop("hot", "own")


def assign_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, cell_rows: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of every row.

    size is UTF-8 bytes plus 16 (null text: 16). Shards are near equal in bytes: each splitter is within `tolerance` of a
    share or as near as one document allows. Slots of a shard run from 0 in key order; rows that repeat a key are ordered
    as they come. Rows without doc_id stand behind the others of their text, in any order. Empty input: no rows; texts of any length only count. A shard
    is made of cells of about `cell_rows` rows, each ordered in a task of its own, so a large shard, or a text that fills
    many shards, never meets in one task; where a cell begins is a running sum over the counts of the cells.
    """
    rows = materialize(keyed(docs), "shard-keys")
    marks = find_splitters(rows, shards, tolerance)
    placed = _with_cells(rows.withColumn("shard", _shard(marks)), rows.count(), cell_rows)
    before = Window.partitionBy("shard").orderBy(*CELL).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", *CELL).agg(F.count("*").alias("n"))
    starts = counts.select("shard", *CELL, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy("shard", *CELL).orderBy("h", "id", "doc_id"))
    numbered = placed.join(starts, ["shard", *CELL]).withColumn("slot", F.col("start") + row - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _shard(marks: list[Splitter]) -> Column:
    """How many marks, one less than shards, are at or below the key, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        m = marks[middle]
        above = (F.col("h") > m.h) | ((F.col("h") == m.h) & (F.col("id") >= m.id))
        return F.when(above, tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(marks))


def sharded(docs: DataFrame, shards: int = 40, tolerance: float = 0.001) -> DataFrame:
    """docs, all columns, and last `shard` (in place of a column of that name): whole rows are exchanged once, by shard.

    Copies without doc_id are cut by numbers drawn for each row, so their shards are even, not exact.
    """
    marks = find_splitters(materialize(keyed(docs), "shard-keys"), shards, tolerance)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    own = docs.select(F.struct(*[c for c in docs.columns if c != "shard"]).alias("row"), *_key(text, doc_id))
    return own.select("row.*", _shard(marks).alias("shard")).repartition("shard")
