"""Spelling variants: words one edit apart, found by merging the subtrees of tries.

Words meet in groups that share half of a word, so that every pair one edit apart meets in exactly one: in front groups (first
half) if the first difference lies behind it, in back groups (second half, words reversed) if not. Groups are also of one length
and the next. A group is a trie, held as its sorted words, where a subtree is a stretch of them. Along each heavy path the light
subtrees of a node are merged with one character skipped or replaced, small to large: a light word's variants are looked up
among the terminals of the heavy subtree, and light words meet in the node's own table of what follows the changed character.
A group too heavy for a task is opened: its words move on to longer shared parts, and the variants by the characters in between
are matched by their digests, so nothing unbounded meets in one place and no pair is lost.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, gathered, materialize, path_of

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each form has at least twice the count of its word, and counts are below 2 ** 63, so a chain has fewer steps than this.
CHAIN = 63


def words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: the distinct words of all texts with their occurrences, one of `every` hashed occurrences losing a character.

    Null texts have no words, a null doc_id hashes as an empty one; repeated rows count each. Summed where the text is read,
    so a frequent word is one row a task in the shuffle.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= min_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


class Best:
    """Near words of each word of a group: how many, and the one of largest n (ties: smallest)."""

    def __init__(self, shorter: int, back: bool, rows: Iterable[tuple[str, int]]):
        self.shorter, self.half, self.turn = shorter, shorter // 2, -1 if back else 1
        self.n, self.count, self.best = {w[:: self.turn]: n for w, n in rows}, defaultdict(int), {}

    def add(self, a: str, b: str) -> None:
        """Pairs of another length, and in back groups those that a front group has, are left to their own groups."""
        if min(len(a), len(b)) != self.shorter:
            return
        a, b = a[:: self.turn], b[:: self.turn]
        if self.turn < 0 and a[: self.half] == b[: self.half]:
            return
        for x, y in ((a, b), (b, a)):
            self.count[x] += 1
            entry = (-self.n[y], y)
            if x not in self.best or entry < self.best[x]:
                self.best[x] = entry

    def rows(self) -> Iterator[tuple]:
        for word, count in self.count.items():
            yield word, count, *self.best[word]


def near_in_trie(found: list[str], pair: Callable[[str, str], None]) -> None:
    """Call pair(a, b) once for each two of the sorted words that are one edit apart.

    Heavy path decomposition: a node's largest subtree is followed, never enumerated there; the others are merged into it and
    then trees of their own. Each word is light on at most log2(words) nodes.
    """
    known, todo = set(found), [(0, len(found))]
    while todo:
        lo, hi = todo.pop()
        while hi - lo > 1:
            at = len(os.path.commonprefix([found[lo], found[hi - 1]]))
            parts, i = [], lo
            here = len(found[lo]) == at  # a terminal on this node
            i += here
            while i < hi:
                j = bisect_left(found, found[i][: at + 1] + "\U0010ffff", i, hi)
                parts.append((i, j))
                i = j
            heavy = max(parts, key=lambda p: p[1] - p[0])
            _merge(found, lo if here else -1, at, heavy, [p for p in parts if p != heavy], known, pair)
            todo += [p for p in parts if p != heavy and p[1] - p[0] > 1]
            lo, hi = heavy


def _merge(found: list[str], here: int, at: int, heavy: tuple[int, int], light: list[tuple[int, int]], known: set[str], pair: Callable[[str, str], None]) -> None:
    """Pairs that differ first at place `at` of one node: terminals that coincide once a character is skipped or replaced there."""
    top = found[heavy[0]][at]
    stem = found[heavy[0]][:at]
    replaced: dict[str, list[str]] = defaultdict(list)
    if here >= 0:  # the word that ends on the node: others have one character more
        for a, _ in [heavy, *light]:
            if len(found[a]) == at + 1:
                pair(found[here], found[a])
    for a, b in light:
        for word in found[a:b]:
            rest = word[at + 1 :]
            for other in (stem + top + rest, stem + top + word[at:]):  # replaced by the heavy character; skipped in the heavy word
                if other in known:
                    pair(word, other)
            if rest and rest[0] != word[at] and (other := stem + rest) in known:  # skipped in the light word, whatever subtree the other is in
                pair(word, other)
            for other in replaced[rest]:  # replaced among light words
                if other[at] != word[at]:
                    pair(word, other)
            replaced[rest].append(word)


def _groups(found: DataFrame) -> DataFrame:
    """Four rows a word: front and back, as the shorter and as the longer of a pair. `word` is reversed in back groups."""
    size = F.length("word")
    shorter = F.explode(F.array(size, size - 1)).alias("shorter")
    split = found.select("word", "n", shorter).withColumn("half", F.expr("shorter div 2"))
    front = split.select("word", "n", "shorter", F.lit(False).alias("back"), F.col("half").alias("depth"))
    back = split.select(F.reverse("word").alias("word"), "n", "shorter", F.lit(True).alias("back"), (F.col("shorter") - F.col("half")).alias("depth"))
    return front.unionByName(back).where("shorter > 0")


def _key() -> Column:
    """128 bits of what a group shares; groups of one depth are apart from those of another."""
    return F.md5(F.concat_ws(":", F.col("shorter").cast("string"), F.col("back").cast("string"), F.col("depth").cast("string"), F.substring("word", F.lit(1), F.col("depth"))).cast("binary"))


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())])
_NEAR = "word string, n_near long, less long, form string"


def _flush(rows: list[tuple[str, int]], shorter: int, back: bool) -> Iterator[tuple]:
    """Near words of one group of sorted words."""
    best = Best(shorter, back, rows)
    near_in_trie([w for w, _ in rows], best.add)
    yield from best.rows()


def _in_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group and word; a group ends where the next begins, wherever the batches are cut."""

    def rows() -> Iterator[tuple]:
        key, held, about = None, [], (0, False)
        for batch in batches:
            for k, w, n, shorter, back in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield from _flush(held, *about)
                    key, held, about = k, [], (shorter, back)
                held.append((w, n))
        if len(held) > 1:
            yield from _flush(held, *about)

    yield from gathered(rows(), NEAR)


def _by_digest(opened: DataFrame) -> DataFrame:
    """Near words of opened groups whose first difference lies in [first, deeper): equal once that character is skipped or replaced.

    One row for each place: what is left without it, and whether the word is the longer one there. Words that share such a
    digest differ in one character at one place, so a group has at most as many as the alphabet has letters, and the word itself.
    """
    at = F.explode(F.sequence(F.col("first"), F.least(F.col("deeper") - 1, F.length("word")))).alias("at")
    placed = opened.select("word", "n", "shorter", "back", at)
    rest = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
    whole = F.length("word") == F.col("shorter")
    # of replaced characters, and of a longer word without one: it equals the shorter word itself
    roles = F.explode(F.when(whole, F.array(F.struct(F.lit("r").alias("role"), rest.alias("left")), F.struct(F.lit("s").alias("role"), F.col("word").alias("left")))).otherwise(F.array(F.struct(F.lit("s").alias("role"), rest.alias("left"))))).alias("x")
    lined = placed.where("at < length(word) or length(word) = shorter").select("word", "n", "shorter", "back", "at", roles)
    lined = lined.where("x.role = 's' or at < length(word)")
    met = lined.groupBy(F.md5(F.concat_ws(":", F.col("shorter").cast("string"), F.col("back").cast("string"), F.col("at").cast("string"), "x.role", "x.left").cast("binary")).alias("key"), "shorter", "back", "at", F.col("x.role").alias("role"))
    met = met.agg(F.collect_list(F.struct("word", "n")).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for shorter, back, at, role, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    best = Best(shorter, back, [(m["word"], m["n"]) for m in members])
                    for a, b in combinations([m["word"] for m in members], 2):
                        if (role == "r" or len(a) != len(b)) and a[at : at + 1] != b[at : at + 1]:
                            best.add(a, b)
                    yield from best.rows()

        yield from gathered(rows(), NEAR)

    return met.select("shorter", "back", "at", "role", "members").mapInArrow(run, _NEAR)


def near_words(found: DataFrame, weight: int = 1 << 20) -> DataFrame:
    """word, n_near, less (minus n of the best near word), form (that word): partial results, some rows a word.

    `weight`: code points that a group may have; heavier ones are opened. found: word (distinct), n.
    """
    groups, parts, step = _groups(found), [], 1
    while True:
        groups = groups.withColumn("key", _key())
        heavy = groups.groupBy("key").agg(F.sum(F.length("word")).alias("weight"), F.count(F.lit(1)).alias("members"))
        heavy = materialize(heavy.where((F.col("weight") > weight) & (F.col("members") > 1)).select("key"), "heavy-groups")
        if heavy.isEmpty():
            parts.append(groups)
            break
        parts.append(groups.join(heavy, "key", "left_anti"))
        held = materialize(groups.join(heavy, "key"), "opened-groups")
        # where a group's smallest and largest word part, all of its words do
        differ = F.expr("array_position(zip_with(split(low, ''), split(high, ''), (a, b) -> coalesce(a = b, false)), false) - 1")
        parting = held.groupBy("key").agg(F.min("word").alias("low"), F.max("word").alias("high")).select("key", differ.cast("int").alias("first"))
        opened = materialize(held.join(parting, "key").withColumn("deeper", F.col("first") + step).drop("key"), "opened-groups")
        parts.append(opened)
        groups = opened.where(F.length("word") >= F.col("deeper")).select("word", "n", "shorter", "back", F.col("deeper").alias("depth"))
        step *= 2
    out = None
    for part in parts:
        near = _by_digest(part) if "deeper" in part.columns else part.repartition("key").sortWithinPartitions("key", "word").select("key", "word", "n", "shorter", "back").mapInArrow(_in_tries, _NEAR)
        out = near if out is None else out.unionByName(near)
    return out


def variants(docs: DataFrame, min_chars: int = 5, min_count: int = 3, weight: int = 1 << 20, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `min_chars` code points and `min_count` occurrences.

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n (ties: smallest in
    code-point order), if that n is at least `ratio` times the word's; root: the last of the chain of forms, the word itself
    where there is none. Null and empty texts have no words; an empty table gives no rows; other columns are not read.
    """
    found = materialize(words(docs, min_chars, min_count), "spelling-words")
    best = near_words(found, weight).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    forms = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form")).alias("form"), F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    forms = materialize(forms, "spelling-forms")
    roots = _roots(forms.where("form is not null").select("word", "form"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: pointers that jump twice as far each round, until none moves; counts grow along a chain, so none is a ring."""
    links = materialize(links.withColumnRenamed("form", "root"), "spelling-links")
    for _ in range(CHAIN.bit_length()):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        before, links = path_of(links), jumped.select("word", "root")
        if before:
            drop_path(jumped.sparkSession, before)
        if jumped.where("moved").isEmpty():
            break
    return links


#: crc32 from its table of 256, made here by rule; words of what a word is without each of its characters.
SQL = r"""
WITH RECURSIVE
     turn AS (SELECT b, 0 AS k, CAST(b AS BIGINT) AS c FROM range(256) AS r(b)
              UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM turn WHERE k < 8),
     entries AS (SELECT list(c ORDER BY b) AS entry FROM turn WHERE k = 8),
     runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
     lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 5),
     counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM lowered GROUP BY id, run),
     hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                                   lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) AS h FROM counted, entries),
     dropped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
     found AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM dropped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM found),
     less AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM places),
     pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
               UNION SELECT a.word, b.word, b.n FROM less a JOIN found b ON a.rest = b.word
               UNION SELECT b.word, a.word, a.n FROM less a JOIN found b ON a.rest = b.word),
     ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM pairs),
     forms AS (SELECT f.word, f.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 2 * f.n THEN r.other END AS form, CASE WHEN r.m >= 2 * f.n THEN r.m END AS form_n
               FROM found f LEFT JOIN ranked r ON r.word = f.word AND r.place = 1),
     steps AS (SELECT word, word AS at, form AS onward FROM forms
               UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.onward)
SELECT f.word, f.form, s.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN steps s ON s.word = f.word AND s.onward IS NULL
"""
