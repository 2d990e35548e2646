"""Personal data: detection, and keyed surrogates that keep type, gender, script and format.

The surrogate of an entity is a keyed function (HMAC-SHA256) of its kind and normal form, so every mention of it, in any
format, gets the same one without a shuffle. A name is one entity in the whole corpus, whatever its titles: what it is (given or
family name, a man's or a woman's) is settled by all of them, and all names share one space of surrogates. Distinctness is checked globally: entities whose surrogate another entity (or a
real value of the corpus) has too are given the next of their surrogates, round by round, until none is shared. These
exceptions are few; they are broadcast if a count proves them under `max_exceptions`, else joined to their documents.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, materialize, slices, text_key

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
CARD = re.compile(r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Forms of address by gender, before a name, or after it in scripts that put them there.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин", "г-н", "Κύριος", "السيد", "أستاذ")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Signora", "Госпожа", "г-жа", "Κυρία", "السيدة", "أستاذة")
EITHER = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Mx", "Rev", "Доктор", "Профессор", "الدكتور", "الدكتورة")
AFTER_MALE, AFTER_FEMALE = ("先生", "くん", "君"), ("女士", "小姐", "太太")
AFTER_EITHER = ("さん", "様", "さま", "氏", "博士", "教授", "선생님", "씨", "님", "교수", "박사")
_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TITLES = MALE + FEMALE + EITHER
_FIRST = "".join(sorted({t[0] for t in _TITLES}))
#: Begins with a set of letters, which the expression engine skips to; what stands before is looked at from there.
_LED = "|".join(rf"(?<={c})(?:{_any([t[1:] for t in _TITLES if t[0] == c])})" for c in _FIRST)
TITLE = re.compile(rf"([{_FIRST}](?<!\w.)(?:{_LED}))\.? ([^\W\d_]+(?:-[^\W\d_]+)?)(?: ([^\W\d_]+(?:-[^\W\d_]+)?))?")
_WHOLE_LETTERS = re.compile("[\u3400-\u9fff\uac00-\ud7af]")
HONORIFIC = re.compile(rf"(?<![\u3400-\u9fff\uac00-\ud7af])([\u3400-\u9fff]{{1,4}}?|[\uac00-\ud7af]{{2,4}}?)\x20?({_any(AFTER_MALE + AFTER_FEMALE + AFTER_EITHER)})")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
NAMES = ("given_m", "given_f", "given_u", "family", "full_m", "full_f", "full_u")
KINDS = ("email", "card", "iban", "ssn", "ip", "phone", *NAMES)
#: Letters that names of a script are made of: consonants, vowels, and the last letter of a woman's given name.
SCRIPTS = {"latin": ("bdfglmnprstvk", "aeiou", "a"), "cyrillic": ("бдвглмнпрстк", "аеиоу", "а"), "greek": ("βγδζκλμνπρστ", "αειου", "α"), "arabic": ("بتدرسفقكلمنه", "اوي", "ة")}
#: Scripts without case and spaces: surnames, then letters of given names of men, women, either. Fixed values.
WHOLE = {"han": ("王李張劉陳楊黃趙周吳徐孫馬朱胡林郭何高羅", "偉強磊軍勇傑濤明超剛", "芳娜敏靜麗艷娟霞秀玲", "文平安寧永春新光華玉"), "hangul": ("김이박최정강조윤장임한오서신권황안송류홍", "준민호석진우성현태훈", "지은영미선혜숙희경아", "수연주원하유재인서윤")}

Mention = tuple[int, int, str, str]


def _luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(word: str) -> str:
    c = next((c for c in word if c.isalpha()), "a")
    for name, low, high in (("cyrillic", "\u0400", "\u04ff"), ("greek", "\u0370", "\u03ff"), ("arabic", "\u0600", "\u06ff"), ("han", "\u3400", "\u9fff"), ("hangul", "\uac00", "\ud7af")):
        if low <= c <= high:
            return name
    return "latin"


def _could_be_name(word: str) -> bool:
    return word[0].isupper() or script_of(word) == "arabic"


def candidates(text: str) -> Iterator[Mention]:
    """Everything that looks like an entity, by kind; what comes first wins where two overlap."""
    if "@" in text:
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email", m[0].lower()
    if re.search(r"\d", text):
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if len(digits) == 16 or _luhn(digits) == 0:
                yield m.start(), m.end(), "card", digits
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if _iban_rest(plain) == 1:
                yield m.start(), m.end(), "iban", plain
        for m in SSN.finditer(text):
            yield m.start(), m.end(), "ssn", m[0].replace("-", "")
        for m in IPV4.finditer(text):
            parts = m[0].split(".")
            if all(int(p) < 256 for p in parts):
                yield m.start(), m.end(), "ip", ".".join(str(int(p)) for p in parts)
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 9 <= len(digits) <= 15:
                yield m.start(), m.end(), "phone", digits
    yield from _names(text)


def _names(text: str) -> list[Mention]:
    """Names after (or, in Han and Hangul, before) a form of address, and every later or earlier mention of them.

    A name that one title shows to be a man's or a woman's is that throughout the text.
    """
    spans: list[tuple[int, int, str]] = []
    kinds: dict[str, str] = {}

    def know(word: str, kind: str) -> None:
        if word not in kinds or kinds[word][-2:] == "_u" and kind[:-1] == kinds[word][:-1]:
            kinds[word] = kind

    for m in TITLE.finditer(text):
        if not _could_be_name(m[2]):
            continue
        sex = "m" if m[1] in MALE else "f" if m[1] in FEMALE else "u"
        if script_of(m[2]) == "arabic":  # without case the second word may be anything
            know(m[2], f"given_{sex}")
            spans.append((*m.span(2), m[2]))
        elif m[3] and m[3][0].isupper() and m[3] not in MALE + FEMALE + EITHER:
            know(m[2].lower(), f"given_{sex}")
            know(m[3].lower(), "family")
            spans += [(*m.span(2), m[2].lower()), (*m.span(3), m[3].lower())]
        else:
            know(m[2].lower(), "family")
            spans.append((*m.span(2), m[2].lower()))
    honoured = list(HONORIFIC.finditer(text)) if _WHOLE_LETTERS.search(text) else []
    for m in honoured:
        know(m[1], f"full_{'m' if m[2] in AFTER_MALE else 'f' if m[2] in AFTER_FEMALE else 'u'}")
    if not kinds:
        return []
    spans += [(*m.span(), m[0].lower()) for m in WORD.finditer(text) if m[0].lower() in kinds and _could_be_name(m[0])]
    if whole := [k for k in kinds if script_of(k) in WHOLE and len(k) > 1]:
        spans += [(*m.span(), m[0]) for m in re.finditer(_any(map(re.escape, whole)), text)]
    spans += [(*m.span(1), m[1]) for m in honoured]
    return [(a, b, kinds[w], w) for a, b, w in spans if w in kinds]


def mentions(text: str) -> list[Mention]:
    """(start, end, kind, normal form), in order and apart, in time proportional to the text and what is in it."""
    taken, found = bytearray(len(text)), []
    for a, b, kind, norm in candidates(text):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind, norm))
    return sorted(found)


class _Stream:
    """Keyed numbers below a bound, without end."""

    def __init__(self, key: bytes, *about: object):
        self.key, self.about, self.n, self.held = key, "\0".join(map(str, about)).encode(), 0, 0

    def below(self, bound: int) -> int:
        if self.held < 1 << 64:
            block = hmac.digest(self.key, self.about + self.n.to_bytes(4, "big"), "sha256")
            self.n, self.held = self.n + 1, self.held << 256 | int.from_bytes(block, "big") | 1 << 255
        self.held, out = divmod(self.held, bound)
        return out


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """A value of the same kind and shape as norm. Late attempts leave the shape where it holds too few values: longer
    names and addresses of mail, other private networks."""
    r = _Stream(key, kind, norm, attempt)
    digits = lambda n: "".join(str(r.below(10)) for _ in range(n))
    if kind == "email":
        head, _, tail = norm.rpartition(".")
        swap = lambda c: str(r.below(10)) if c.isdigit() else chr(97 + r.below(26)) if c.isalpha() else c
        more = "".join(chr(97 + r.below(26)) for _ in range(attempt // 3))
        return more + "".join(map(swap, head)) + "." + tail
    if kind == "card":
        body = norm[0] + digits(len(norm) - 2)
        check = (10 - _luhn(body + "0")) % 10
        if _luhn(norm):  # the real one fails the check, so this one may
            check = (check + 1 + r.below(9)) % 10
        return body + str(check)
    if kind == "iban":
        body = "".join(str(r.below(10)) if c.isdigit() else chr(65 + r.below(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - _iban_rest(norm[:2] + '00' + body):02d}{body}"
    if kind == "ssn":
        return f"9{digits(2)}{1 + r.below(99):02d}{1 + r.below(9999):04d}"
    if kind == "ip":
        keep = norm.split(".")[: 2 if norm.startswith("192.168.") else 1] if ipaddress.ip_address(norm).is_private else []
        keep = ["10"] if keep and attempt > 3 else keep
        return ".".join(keep + [str(1 + r.below(254)) for _ in range(4 - len(keep))])
    if kind == "phone":
        keep = len(norm) - 10 if len(norm) > 10 else 0
        return norm[:keep] + str(2 + r.below(8)) + digits(len(norm) - keep - 1)
    pick = lambda letters: letters[r.below(len(letters))]
    if (script := script_of(norm)) in WHOLE:
        surnames, *given = WHOLE[script]
        own = given["mfu".index(kind[-1])] if kind[-2] == "_" else given[2]
        return pick(surnames) + "".join(pick(own) for _ in range(max(len(norm) - 1, 1 if len(norm) > 1 else 0) + attempt // 2))
    consonants, vowels, last = SCRIPTS[script]
    name = "".join(pick(consonants) + pick(vowels) for _ in range(max(2, min(len(norm) // 2, 5)) + attempt // 4))
    return name[:-1] + last if kind == "given_f" else name + pick(consonants)


def render(mention: str, kind: str, value: str) -> str:
    """The surrogate in the format of this mention: its separators, its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        letters = iter(value)
        return "".join(next(letters) if c.isalnum() else c for c in mention)
    if kind == "email":
        more = len(value) - len(mention)
        return value[:more] + "".join(v.upper() if c.isupper() else v for c, v in zip(mention, value[more:], strict=True))
    if kind == "ip":
        return value
    return value.upper() if mention.isupper() and len(mention) > 1 else value[:1].upper() + value[1:]


def _entities(docs: DataFrame) -> DataFrame:
    """text_key, kind, norm of every entity of every text."""
    schema = pa.schema([("text_key", pa.int64()), ("kind", pa.string()), ("norm", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((d, *e) for part in slices(batches) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t for e in sorted({m[2:] for m in mentions(t)})), schema)

    return docs.select(text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "text_key long, kind string, norm string")


def _with_value(entities: DataFrame, key: bytes, attempt: int, make: Callable) -> DataFrame:
    """entities with the value of this attempt."""
    schema = pa.schema([("space", pa.string()), ("norm", pa.string()), ("kind", pa.string()), ("mixed", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(((s, n, k, x, make(key, k, n, attempt)) for part in batches for s, n, k, x in zip(*(c.to_pylist() for c in part.columns), strict=True)), schema)

    return entities.select("space", "norm", "kind", "mixed").mapInArrow(run, "space string, norm string, kind string, mixed boolean, value string")


def space(kind: str) -> str:
    """What surrogates must be distinct in: all names together, other kinds each."""
    return "name" if kind in NAMES else kind


def resolved(entities: DataFrame) -> DataFrame:
    """space, norm, kind, mixed: one entity for each normal form of a space. A name that is a given name somewhere is one; it is
    a man's or a woman's if the titles say one of them and never the other. mixed: texts differ in what they take it for."""
    names = F.col("kind").isin(*NAMES)
    found = entities.groupBy(F.when(names, "name").otherwise(F.col("kind")).alias("space"), "norm").agg(F.collect_set("kind").alias("kinds"))
    role = F.when(F.exists("kinds", lambda k: k.startswith("full")), "full").when(F.exists("kinds", lambda k: k.startswith("given")), "given").otherwise("family")
    men, women = F.exists("kinds", lambda k: k.endswith("_m")), F.exists("kinds", lambda k: k.endswith("_f"))
    sex = F.when(men & ~women, "_m").when(women & ~men, "_f").otherwise("_u")
    kind = F.when(F.col("space") != "name", F.col("space")).when(role == "family", "family").otherwise(F.concat(role, sex))
    return found.select("space", "norm", kind.alias("kind"), (F.size("kinds") > 1).alias("mixed"))


def exceptions(entities: DataFrame, key: bytes, rounds: int = 32, make: Callable = surrogate) -> DataFrame:
    """space, norm, value of the entities (kind, norm) whose surrogate doesn't follow from what a single text takes them for:
    the first one is another entity's, or real, or texts differ in the kind.

    Each round takes the surrogates of those still open; one stays with its smallest entity unless it was given out before
    or, in the first half of the rounds, is a real value (which is replaced itself, so outputs stay distinct without this).
    Raises if some are still open after `rounds` (then the space of surrogates is too small).
    """
    every = materialize(resolved(entities), "entities-resolved")
    real = every.select("space", F.col("norm").alias("value"))
    open_, given, moved = every, None, None
    for attempt in range(rounds):
        tried = materialize(_with_value(open_, key, attempt, make), "surrogates")
        free = tried.select("space", "value").distinct()
        if 2 * attempt < rounds:
            free = free.join(real, ["space", "value"], "left_anti")
        if given is not None:
            free = free.join(given, ["space", "value"], "left_anti")
        owners = tried.join(free, ["space", "value"], "left_semi").groupBy("space", "value").agg(F.min(F.struct("norm", "mixed")).alias("x"))
        settled = materialize(owners.select("space", "value", "x.norm", "x.mixed"), "surrogates-settled")
        given = settled.select("space", "value") if given is None else given.unionByName(settled.select("space", "value"))
        told = settled if attempt else settled.where("mixed")
        moved = told if moved is None else moved.unionByName(told)
        open_ = materialize(tried.join(settled.select("space", "norm"), ["space", "norm"], "left_anti").select("space", "norm", "kind", "mixed"), "surrogates-open")
        if open_.isEmpty():
            return moved.select("space", "norm", "value")
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def replace(text: str, key: bytes, moved: dict[tuple[str, str], str], make: Callable = surrogate) -> tuple[str, list[Mention]]:
    found = mentions(text)
    out, at = [], 0
    for a, b, kind, norm in found:
        value = moved.get((space(kind), norm)) or make(key, kind, norm, 0)
        out += [text[at:a], render(text[a:b], kind, value)]
        at = b
    return "".join([*out, text[at:]]), found


OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_replaced", pa.int64()), ("spans", pa.string())])


def pseudonymise(docs: DataFrame, key: bytes, max_exceptions: int = 20_000, make: Callable = surrogate) -> DataFrame:
    """doc_id, text with surrogates, n_replaced, spans (kind:start:end of the original, comma-joined) of every row.

    Null texts stay null with no spans; texts without entities are unchanged; repeated rows, and rows without doc_id, are
    treated each. Texts of any length are read whole. Entities with one normal form are one entity in all documents
    (coreference), names too, whatever stands before them in each; different ones get different surrogates. A name is known by a form of address somewhere in
    its document and is then replaced wherever it stands there.
    """
    spark = docs.sparkSession
    found = materialize(_entities(docs), "entities")
    moved = materialize(exceptions(materialize(found.select("kind", "norm").distinct(), "entities-distinct"), key, make=make), "exceptions")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    if moved.count() <= max_exceptions:
        few = spark.sparkContext.broadcast({(r.space, r.norm): r.value for r in moved.collect()})
        source = keyed.select("doc_id", "text", F.lit(None).cast("array<struct<space:string,norm:string,value:string>>").alias("moved"))
    else:  # each text gets the exceptions that it mentions
        few = spark.sparkContext.broadcast({})
        named = found.withColumn("space", F.when(F.col("kind").isin(*NAMES), "name").otherwise(F.col("kind")))
        own = named.join(moved, ["space", "norm"]).groupBy("text_key").agg(F.collect_set(F.struct("space", "norm", "value")).alias("moved"))
        source = keyed.join(own, "text_key", "left").select("doc_id", "text", "moved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in slices(batches):
                for d, t, m in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    extra = few.value | {(x["space"], x["norm"]): x["value"] for x in m} if m else few.value
                    text, spans = (t, []) if not t else replace(t, key, extra, make)
                    yield d, text, len(spans), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)

        yield from gathered(rows(), OUT)

    return source.mapInArrow(run, "doc_id long, text string, n_replaced long, spans string")
