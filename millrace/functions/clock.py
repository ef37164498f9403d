"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: RFC 3339 date-time with its zone (fixed format).
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339(text: Column) -> Column:
    """The instant of a valid RFC 3339 text with Z or an offset; null for anything else (no exception)."""
    return F.when(text.rlike(RFC3339), F.upper(text).try_cast("timestamp"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 UTC of a timestamp with or without zone; null for null."""
    return F.unix_micros(ts.cast("timestamp"))


def window_start_s(us: Column, seconds: int) -> Column:
    """Start, in seconds since 1970 UTC, of the aligned window of that length which holds the instant."""
    return (F.floor(us / F.lit(1_000_000 * seconds)) * seconds).cast("bigint")
