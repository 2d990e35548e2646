"""Fill-in-middle transformation with big integers: a text's class mask is one integer, one bit for each code point.

bytes.translate turns the text into a string of 0 (white space) and 1 (other); read in base 2 it is the mask, first code point
highest. A shift of the mask against itself leaves one bit at the last code point of every token, bit_count() counts them,
and the bit of a given rank is found by halving the integer again and again, so a text takes time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, id_text, slices

#: The marks of prefix, suffix and middle, and the white space that parts tokens.
MARKS = ("<P>", "<S>", "<M>")
SPACE = "\t\n\x0b\x0c\r "
_CLASSES = bytes(ord("0") if chr(c) in SPACE else ord("1") for c in range(256))


def token_ends(text: str) -> int:
    """An integer of len(text) bits: the bit of a code point (the first is the highest) is 1 if a token ends there.

    A token is white space and what follows it up to the next white space; white space at the end is a token of its own.
    """
    if not text:
        return 0
    solid = int(text.encode("latin-1", "replace").translate(_CLASSES), 2)  # what isn't Latin-1 becomes a question mark
    return (solid & ~(solid << 1)) | (~solid & 1)


def ranked_bit(bits: int, width: int, rank: int) -> int:
    """Place, counted from the lowest, of the rank-th set bit of `bits`, counted from 1 at the lowest."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        if rank <= (n := low.bit_count()):
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - n, at + half
    return at


def cut_after(bits: int, width: int, n: int, tokens: int) -> int:
    """Code points of the first `tokens` of n tokens."""
    return width - ranked_bit(bits, width, n - tokens + 1) if tokens else 0


def dice(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers that follow from the seed and the id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformed(text: str, h: list[int], rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle (None if plain), output."""
    bits, width = token_ends(text), len(text)
    n = bits.bit_count()
    if not text or h[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted(cut_after(bits, width, n, k) for k in (h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = marks
    if h[3] % 100 < spm_rate:
        return n, "spm", first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output of every row.

    `rate` percent of the documents are cut in three at token bounds, `spm_rate` percent of these put the suffix first; both,
    and the cuts, follow from seed and doc_id alone, so a retried task gives the same. Null texts are empty, empty texts and
    texts that hold a mark stay plain; a null doc_id draws as an empty one; repeated rows are repeated; texts are whole
    whatever their length. Needs no shuffle.
    """
    marks = tuple(marks)
    if any(not m or set(m[1:]) & {x[:1] for x in marks} or sum(x.startswith(m) for x in marks) > 1 for m in marks):
        raise ValueError("no mark may begin another, or hold another's first character after its own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in slices(batches):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield doc_id, *transformed(text or "", dice(seed, doc_id), rate, spm_rate, marks)

        yield from gathered(rows(), OUT)

    return id_text(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made from. No mark stands in a text that isn't plain, so its output has four parts."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The outputs of fill_in_middle() as digests, beside those of the texts restored from them."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     k AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
                  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
     f AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
     c AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m,
                  array_to_string(list_slice(w, b + 1, n), '') AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
