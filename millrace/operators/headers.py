"""Record headers: arrays of key and value, in which a key may come more than once (so they are no maps)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

KIND = "array<struct<key: string, value: binary>>"


def last_text(name: str, headers: str = "headers") -> Column:
    """The last header of that name as text, or null."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(-1))["value"].cast("string")


def replaced(entries: dict[str, Column], gone: Iterable[str] = (), headers: str = "headers") -> Column:
    """The headers with these entries (as UTF-8 texts) in place of all of their names and of `gone`; others stay in order."""
    names = sorted({*entries, *gone})
    others = F.filter(F.coalesce(F.col(headers), F.array().cast(KIND)), lambda h: h["key"].isNull() | ~h["key"].isin(names))
    return F.concat(others, F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v.cast("string"), "UTF-8").alias("value")) for k, v in entries.items()]))
