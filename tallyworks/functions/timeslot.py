"""Time columns: six-hour slots and days at a fixed offset, parsing with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that local days are ahead of stored times.
OFFSET_HOURS = 9


def shifted(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return ts + F.expr(f"INTERVAL {hours} HOURS")


def slot(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    """0, 6, 12 or 18: the local six-hour slot."""
    return (F.floor(F.hour(shifted(ts, hours)) / 6) * 6).cast("int")


def local_date(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return F.to_date(shifted(ts, hours))


def parsed(text: Column, formats: list[str], default: Column) -> Column:
    """The first format that reads the text, a leading weekday left out, else ISO, else default."""
    plain = F.regexp_replace(text, r"^[A-Za-z]{3,9}, *", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats], F.try_to_timestamp(plain), default)


#: Date formats of feeds.
RFC_822 = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz"]


def case_date(case_id: Column) -> Column:
    """The date inside an id such as 2026-01-31_name; null without one."""
    part = lambda i: F.regexp_extract(case_id, r"(\d{4})[-_](\d{2})[-_](\d{2})", i)
    return F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")


def hours_apart(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("SECOND", a, b)) / 3600.0


def zoned(text: Column, default: Column, hours: int = OFFSET_HOURS) -> Column:
    """UTC time of a text: one with a zone is read by it, one without, or a day alone, is local; else the default."""
    named = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    local = F.regexp_replace(text, "T", " ").try_cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return F.when(text.rlike(r"T.*(Z|[+-]\d\d:?\d\d)$"), F.coalesce(named, default)).when(text.rlike(r"T|^\d{4}-\d{2}-\d{2}$"), F.coalesce(local, default)).otherwise(default)


def local_text(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return F.date_format(shifted(ts, hours), "yyyy-MM-dd HH:mm")


def session(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    """1 to 4: the local quarter of the day."""
    return (F.floor(F.hour(shifted(ts, hours)) / 6) + 1).cast("int")
