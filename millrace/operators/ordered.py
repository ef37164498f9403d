"""Neighbours and running counts in the order of a key, without putting a whole key into one task.

A key's rows are cut into chunks of its order axis. Each chunk is summarised (map-side combined) to one row; the window
over a key sees only these summaries, the window over the rows only one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_neighbours(df: DataFrame, key: list[str], chunk: str, order: list[str], value: Column, before: str | None = None, after: str | None = None) -> DataFrame:
    """df with the value of the row before (and after) within key by (chunk, *order); null at the ends.

    key and chunk: not null. chunk must not decrease along order. Ties in order are broken by Spark at will, so order
    should end in a unique column. value should be a struct: a null value is taken for an end.
    """
    at = F.struct(*order)
    rows = df.withColumn("_v", value)
    ends = rows.groupBy(*key, chunk).agg(F.max_by("_v", at).alias("_last"), F.min_by("_v", at).alias("_first"))
    over = Window.partitionBy(*key).orderBy(chunk)
    ends = ends.select(*key, chunk, F.lag("_last").over(over).alias("_carry"), F.lead("_first").over(over).alias("_ahead"))
    inside = Window.partitionBy(*key, chunk).orderBy(*order)
    out = rows.join(ends, [*key, chunk])
    if before:
        out = out.withColumn(before, F.coalesce(F.lag("_v").over(inside), F.col("_carry")))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead("_v").over(inside), F.col("_ahead")))
    return out.drop("_v", "_carry", "_ahead")


def with_position(df: DataFrame, key: list[str], chunk: str, order: list[str], name: str) -> DataFrame:
    """df with its row number (from 1) within key by (chunk, *order). Conditions as of with_neighbours."""
    sizes = df.groupBy(*key, chunk).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, chunk, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*key, chunk).orderBy(*order)
    return df.join(sizes, [*key, chunk]).withColumn(name, (F.row_number().over(inside) + F.col("_base")).cast("bigint")).drop("_base")
