"""URL columns: canonical forms, tracking parameters, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking parameters; fixed values.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id ref ref_src ref_url source fbclid gclid msclkid twclid si spm igshid yclid mc_cid mc_eid aff affiliate".split()


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """Before the query, host included; pairs of the query; fragment with its mark; scheme with its marks."""
    body = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return body, F.filter(F.split(query, "&"), lambda p: p != ""), fragment, query


def _name(pair: Column) -> Column:
    return F.lower(F.substring_index(pair, "=", 1))


def canonical(url: Column) -> Column:
    """https, lower-case host without www., sorted parameters without tracking, no trailing slash, no fragment."""
    body, pairs, _, _ = _parts(F.trim(F.coalesce(url, F.lit(""))))
    host = F.regexp_replace(F.lower(F.regexp_extract(body, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(body, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", 1), "/+$", "")
    kept = F.array_sort(F.filter(pairs, lambda p: ~(_name(p).startswith("utm_") | _name(p).startswith("ref") | _name(p).isin("fbclid", "gclid", "source", "s")) & (F.instr(p, "=") > 0) & (F.substring_index(p, "=", -1) != "")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit("https://"), host, path, query))


def without_tracking(url: Column, also_containing: str | None = None) -> Column:
    """The URL without tracking parameters, the rest in order, fragment kept. also_containing: drop keys with this in them too."""
    body, pairs, fragment, _ = _parts(F.coalesce(url, F.lit("")))

    def tracks(p: Column) -> Column:
        bad = _name(p).isin(TRACKING) | _name(p).startswith("utm_")
        return bad | _name(p).contains(also_containing) if also_containing else bad

    kept = F.filter(pairs, lambda p: ~tracks(p))
    return F.concat(body, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)


def bare(url: Column) -> Column:
    """without_tracking() in lower case, without scheme, www. and trailing slash."""
    u = F.trim(F.lower(without_tracking(url)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", ""), "/+$", "")


def fingerprint(url: Column) -> Column:
    """SHA-256 of the URL in lower case without scheme, www. and trailing slash."""
    u = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "^https?://", ""), r"^www\.", "")
    return F.sha2(F.regexp_replace(u, "/+$", ""), 256)


def canonical_hash(platform: Column, url: Column, slug: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(platform), F.lit(":"), F.coalesce(F.nullif(bare(url), F.lit("")), slug)), 256), 1, 16)
