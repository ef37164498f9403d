"""Tumbling-window aggregates of sales, for bounded and for streaming input alike."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

WATERMARK = "10 minutes"


class Tumbling(NamedTuple):
    """Windows of one length: what is grouped by, what is summed up (name, SQL, type), and over which rows.

    per: SQL of an array whose elements (as `x`) are the rows, or empty for the rows themselves. A null key gives no row
    where there is an array.
    """

    length: str
    key: tuple[str, str]
    sums: tuple[tuple[str, str, str], ...]
    per: str = ""


# Lengths, names and types of the served tables (fixed values).
STORE_REVENUE_5M = Tumbling("5 minutes", ("store_id", "store_id"), (("revenue", "coalesce(total_amount, 0)", "decimal(14,2)"), ("transactions", "1", "bigint"), ("units", "reduce(transform(coalesce(line_items, array()), x -> coalesce(x.quantity, 0)), 0L, (n, q) -> n + q)", "bigint")))
PRODUCT_UNITS_1H = Tumbling("1 hour", ("product_id", "x.product_id"), (("units", "x.quantity", "bigint"), ("revenue", "cast(x.quantity as decimal(18,0)) * x.unit_price - coalesce(x.discount_amount, 0)", "decimal(14,2)")), "line_items")


def watermarked(sales: DataFrame, watermark: str = WATERMARK, event_id: str = "event_id") -> DataFrame:
    """Projected columns only, de-duplicated by event id: within the watermark on a stream, exactly on bounded input.

    sales: event_id, event_ts, store_id, line_items, total_amount. Null event ids count as one value.
    """
    columns = sales.select(event_id, *["event_ts", "store_id", "line_items", "total_amount"])
    return columns.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark([event_id]) if sales.isStreaming else columns.dropDuplicates([event_id])


def tumbling(sales: DataFrame, spec: Tumbling) -> DataFrame:
    """key, window_start, window_end and the sums; money is summed as decimal(28,6) and rounded once, at the end."""
    name, key = spec.key
    rows = sales.select("event_ts", F.explode(spec.per).alias("x")) if spec.per else sales
    exact = lambda sql, kind: F.expr(sql).cast("decimal(28,6)" if kind.startswith("decimal") else kind)
    slim = rows.select("event_ts", F.expr(key).alias(name), *[exact(sql, kind).alias(n) for n, sql, kind in spec.sums])
    slim = slim.where(F.col(name).isNotNull()) if spec.per else slim
    by = slim.groupBy(F.window("event_ts", spec.length).alias("w"), name).agg(*[F.sum(n).cast(kind).alias(n) for n, _, kind in spec.sums])
    return by.select(name, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[n for n, _, _ in spec.sums])


def store_revenue_5m(sales: DataFrame) -> DataFrame:
    """store_id, window_start, window_end, revenue, transactions, units per five minutes; null amounts and quantities add 0."""
    return tumbling(sales, STORE_REVENUE_5M)


def product_units_1h(sales: DataFrame) -> DataFrame:
    """product_id, window_start, window_end, units, revenue (after discount) per hour over the exploded lines."""
    return tumbling(sales, PRODUCT_UNITS_1H)
