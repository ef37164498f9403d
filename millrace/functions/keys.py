"""Deterministic keys, time bounds and null-safe arithmetic of the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

UNKNOWN, NOT_APPLICABLE = -1, -2
BEGINNING, END = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def md5_lower64(text: Column) -> Column:
    """The low 64 bits of the MD5 as an unsigned number, decimal(20,0)."""
    return F.conv(F.right(F.md5(text), F.lit(16)), 16, 10).cast("decimal(20,0)")


def scd2_key(natural: Column, effective_from: Column) -> Column:
    """Key of a version: md5_lower64 of natural key and start with nine fraction digits."""
    return md5_lower64(F.concat(natural, F.lit("|"), F.date_format(effective_from, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("000")))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def beginning_of_time() -> Column:
    return F.lit(BEGINNING).cast("timestamp")


def end_of_time() -> Column:
    return F.lit(END).cast("timestamp")


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b in doubles, rounded to digits if given; null where b is null or 0."""
    quotient = F.try_divide(a.cast("double"), b.cast("double"))
    return quotient if digits is None else F.round(quotient, digits)


def qualify_row_number(df: DataFrame, partition: list[str], order: list[Column], at_most: int = 1) -> DataFrame:
    """The first rows of each partition in that order (ties are broken only by `order`)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_rn") <= at_most).drop("_rn")


def distinct_from(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))
