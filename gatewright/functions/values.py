"""Scalar helpers whose edge cases the rules rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(c: Column) -> Column:
    """Null or empty: the gate's notion of blank, to which a space is a value."""
    return c.isNull() | (c == "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only: the feeds' notion of blank."""
    return c.isNull() | c.rlike(r"^\s*\z")


def is_trimmed_empty(c: Column) -> Column:
    """Null, empty or spaces only: ``trim(x) = ''`` of the daily rules."""
    return c.isNull() | (F.trim(c) == "")


def number(c: Column, fallback: float | None = None) -> Column:
    """A text as a double; ``fallback`` (or null) where it is none."""
    value = c.cast("string").try_cast("double")
    return value if fallback is None else F.coalesce(value, F.lit(float(fallback)))


def iso_date(c: Column) -> Column:
    """A strict ``yyyy-MM-dd`` text as a date; null otherwise, as for ``2026-1-5``."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def is_distinct(a: Column, b: Column) -> Column:
    """``IS DISTINCT FROM``."""
    return ~a.eqNullSafe(b)


def is_whole(c: Column) -> Column:
    """Whether a double is integral; ``rint`` holds beyond the range of bigint, ``floor`` does not."""
    return F.rint(c) == c


def nullify(c: Column) -> Column:
    """'' as null (gate landing)."""
    return F.when(c != "", c)


def business_days(first: str, last: str) -> Column:
    """An array of the weekdays from ``first`` to ``last``."""
    days = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def row_json(*columns: str) -> Column:
    """A row as JSON that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
