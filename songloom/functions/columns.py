"""Small scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Text without blanks of any kind at its ends."""
    return F.btrim(c, F.lit(BLANKS))


def text(c: Column) -> Column:
    """Missing becomes the empty string, then surrounding blanks go."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def blank_to_null(c: Column) -> Column:
    """Null for missing, empty or blank text."""
    return F.nullif(text(c), F.lit(""))


def half_even(c: Column) -> Column:
    """Round to the nearest integer value, ties to even, still a double."""
    return F.rint(c)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low,
                      F.least(F.lit(high) if not isinstance(high, Column) else high, c))


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def r6(c: Column) -> Column:
    """Double rounded to six places for reports."""
    return F.round(c.cast("double"), 6)


def seconds_to_micros(s) -> int:
    return int(round(float(s) * 1_000_000))
