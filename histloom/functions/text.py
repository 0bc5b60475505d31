"""Column helpers for the dirty text fields of commit records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove outer white space of every kind (SQL trim removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_email(c: Column) -> Column:
    """Trimmed lower-case e-mail; null where nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def instant(text: Column, inverted_offset: Column | None = None) -> Column:
    """Unix seconds of a date written in any of the ways found in commit records.

    ``YYYY-MM-DD`` and ``HH:MM[:SS[.f]]`` apart by a blank or T, then nothing, Z, or an offset with or
    without colon and blank. Without an offset, ``inverted_offset`` (seconds, sign inverted) is added;
    where that is null too, UTC is taken. Unreadable text gives null. Independent of the session zone.
    """
    t = strip(text)
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})[ T]", 1)
    clock = r"^\d{4}-\d{2}-\d{2}[ T](\d{2}):(\d{2})(?::(\d{2}))?"
    zone = r"^\S+[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)? ?([+-])(\d{2}):?(\d{2})$"
    num = lambda p, g: F.coalesce(F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("long"), F.lit(0))
    days = F.datediff(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("yyyy-MM-dd")).cast("date"), F.lit("1970-01-01").cast("date"))
    local = days.cast("long") * 86400 + num(clock, 1) * 3600 + num(clock, 2) * 60 + num(clock, 3)
    sign = F.regexp_extract(t, zone, 1)
    given = F.when(sign == "-", -1).otherwise(1) * (num(zone, 2) * 3600 + num(zone, 3) * 60)
    fallback = F.coalesce(inverted_offset.cast("long"), F.lit(0)) if inverted_offset is not None else F.lit(0)
    shift = F.when(sign != "", given).when(F.upper(t).endswith("Z"), 0).otherwise(-fallback)
    return F.when(t.rlike(clock), local - shift)
