"""Columns over JSON payloads: paths with fallbacks, guards, edits, the array of sources, repair of broken JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import canonical_platform

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_name", "platform", "title", "url", "type", "created_at", "published_at")])
SOURCES = T.ArrayType(SOURCE)


class Parsed:
    """A payload that was read into a struct once; its fields are reached without the text."""

    def __init__(self, column: Column):
        self.column = column

    def get(self, at: str) -> Column:
        c = self.column
        for name in at.split("."):
            c = c[name]
        return c


def get(payload: Column | Parsed, at: str) -> Column:
    """The text at a path, of a JSON text or of what was read from it."""
    return payload.get(at) if isinstance(payload, Parsed) else F.get_json_object(payload, f"$.{at}")


def path(payload: Column | Parsed, *paths: str) -> Column:
    """The first of several paths that is there and not empty."""
    return F.coalesce(*[F.nullif(get(payload, p), F.lit("")) for p in paths])


def array_length(payload: Column, at: str) -> Column:
    """Length of an array; 0 where there is none or something else."""
    return F.coalesce(F.json_array_length(F.get_json_object(payload, f"$.{at}")), F.lit(0))


def has_key(payload: Column, key: str) -> Column:
    """Whether a key is there, even with a JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def _raw(payload: Column) -> Column:
    return F.from_json(F.coalesce(payload, F.lit("{}")), "map<string,variant>")


def with_fields(payload: Column, fields: dict[str, Column]) -> Column:
    """Top-level fields set, with the type of their column; other fields stay as they are, whatever their type."""
    new = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("variant"))])
    kept = F.map_filter(_raw(payload), lambda k, _: ~k.isin(list(fields)))
    return F.to_json(F.map_concat(kept, new))


def without_fields(payload: Column, keys: list[str]) -> Column:
    """Top-level fields left out; the others keep their types."""
    return F.to_json(F.map_filter(_raw(payload), lambda k, _: ~k.isin(keys)))


def without_keys(payload: Column, keys: list[str]) -> Column:
    """Fields of these names left out at every depth; what isn't JSON stays as it is."""

    def pruned(value: object) -> object:
        if isinstance(value, dict):
            return {k: pruned(v) for k, v in value.items() if k not in keys}
        return [pruned(v) for v in value] if isinstance(value, list) else value

    def one(text: str | None) -> str | None:
        if text is None or not any(k in text for k in keys):
            return text
        try:
            return json.dumps(pruned(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(payload)


def sources(payload: Column | Parsed) -> Column:
    """The array of sources; null where it isn't one."""
    if isinstance(payload, Parsed):
        return payload.get("sources")
    return F.from_json(F.get_json_object(payload, "$.sources"), SOURCES)


def healed_sources(payload: Column, platform: Column, url: Column, title: Column, created: Column) -> Column:
    """Sources with the item itself put first where it is missing, other videos of its own channel left out."""
    primary = F.struct(platform.alias("source_name"), platform.alias("platform"), title.alias("title"), url.alias("url"), F.lit("primary").alias("type"), created.alias("created_at"), F.lit(None).cast("string").alias("published_at"))
    own, here = F.lower(F.trim(platform)), F.trim(F.coalesce(url, F.lit("")))
    found = F.coalesce(sources(payload), F.array().cast(SOURCES))
    theirs = lambda s: F.lower(F.trim(F.coalesce(s["platform"], s["source_name"], F.lit(""))))
    kept = F.filter(found, lambda s: ~(own.contains("youtube") & (theirs(s) == own) & (F.trim(F.coalesce(s["url"], F.lit(""))) != here)))
    missing = (F.size(kept) == 0) | ((here != "") & ~F.exists(kept, lambda s: F.trim(F.coalesce(s["url"], F.lit(""))) == here))
    return F.when(missing, F.concat(F.array(primary), kept)).otherwise(kept)


def merged_sources(primary: Column, secondary: Column) -> Column:
    """Sources of the primary, then those of the secondary whose URL and platform aren't there yet, one for each platform."""
    platform = lambda s: canonical_platform(F.coalesce(s["platform"], s["source_name"]), s["url"])
    urls, platforms = F.transform(primary, lambda s: s["url"]), F.transform(primary, platform)
    fresh = F.filter(secondary, lambda s: s["url"].isNotNull() & (s["url"] != "") & ~F.array_contains(F.array_compact(urls), s["url"]) & ~F.array_contains(platforms, platform(s)))

    def first_of_platform(s: Column, i: Column) -> Column:
        before = F.slice(fresh, F.lit(1), i)
        return ~F.exists(before, lambda b: (platform(b) == platform(s)) | (b["url"] == s["url"]))

    return F.concat(primary, F.filter(fresh, first_of_platform))


def repair(text: str | None) -> str | None:
    """JSON out of an answer of a language model: fences and chatter off, what is cut short closed; null if hopeless."""
    plain = re.sub(r"(?is)<think>.*?</think>", "", text or "").strip()
    plain = re.sub(r"(?i)^```(?:json)?\s*|\s*```$", "", plain).strip()
    starts = [i for i in (plain.find("["), plain.find("{")) if i >= 0]
    plain = plain[min(starts) :] if starts else plain

    def read(s: str) -> object:
        try:
            return json.loads(s)
        except ValueError:
            return None

    candidates = [plain]
    for pattern in (r"\[\s*\{.*\}\s*\]", r"\{.*\}"):
        if m := re.search(pattern, plain, re.DOTALL):
            candidates.append(m[0])
    closers, inside, escaped = [], False, False
    for c in plain:  # close what is open, innermost first
        if inside:
            inside, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            closers.append("]" if c == "[" else "}")
        elif c in "]}" and closers:
            closers.pop()
    candidates.append(plain.rstrip().rstrip(",") + '"' * inside + "".join(reversed(closers)))
    for c in candidates:
        value = read(c)
        if isinstance(value, (dict, list)):
            return json.dumps(value if isinstance(value, list) else [value], ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def repaired(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """repair() over Arrow batches; no built-in expresses it."""
    for s in texts:
        yield s.map(repair)
