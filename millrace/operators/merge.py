"""MERGE, rebuild and re-key for tables without a table format: pure functions of old and new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def insert_only(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """The rows of source to append: keys that target lacks. Of repeated source keys an arbitrary one; null keys never match, so they are inserted."""
    return source.dropDuplicates(key).join(target.select(*key).distinct(), key, "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target with source's rows in place of those of the same key (absolute values, so a replay changes nothing)."""
    fresh = source.dropDuplicates(key)
    return target.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def changed(target: DataFrame, source: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """The rows of source whose key is new or whose attributes are distinct from target's (null-safe): a type-1 MERGE."""
    old = target.select(*key, F.struct(*attributes).alias("_old"))
    return source.dropDuplicates(key).join(old, key, "left").where(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.struct(*attributes))).drop("_old")


def rebuild(target: DataFrame, fresh: DataFrame, affected: DataFrame, key: list[str]) -> DataFrame:
    """target with all rows of the affected keys replaced by those of fresh (delete and insert; idempotent)."""
    keys = affected.select(*key).distinct()
    return target.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"), allowMissingColumns=True)


def rekey(facts: DataFrame, versions: DataFrame, natural: str, at: str, surrogate: str, low: str = "effective_from_utc", high: str = "effective_to_utc") -> DataFrame:
    """facts with the surrogate key of the version valid at their time; a fact without such a version keeps its key."""
    side = versions.select(F.col(natural).alias("_n"), F.col(low).alias("_low"), F.col(high).alias("_high"), F.col(surrogate).alias("_k"))
    met = facts.join(side, (F.col(natural) == F.col("_n")) & (F.col(at) >= F.col("_low")) & (F.col(at) < F.col("_high")), "left")
    return met.withColumn(surrogate, F.coalesce("_k", surrogate)).select(*facts.columns)
