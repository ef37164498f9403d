"""The queries p2 to p7: the general operators over the domain tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.clock import micros, rfc3339
from millrace.operators import asof, dedup, history, late, nested, orphans
from millrace.session import pin_semantics, work_path, written

#: Arrival slices in which the late-event operator replays the sales.
INCREMENTS = 3
#: Recorded batches in which the ledger takes the updates.
LEDGER_BATCHES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_semantics(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_ids(sales: DataFrame) -> DataFrame:
    return sales.select("record_id", F.col("metadata.event_id").alias("event_id"), F.col("payload.transaction_id").alias("business_id"))


def movement_ids(moves: DataFrame) -> DataFrame:
    return moves.select("record_id", F.col("metadata.event_id").alias("event_id"), F.col("payload.movement_id").alias("business_id"))


def surplus_sales(sales: DataFrame) -> DataFrame:
    """record_id of the sales records that are further copies."""
    return dedup.surplus(sales_ids(sales), "record_id", ["event_id", "business_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = surplus_sales(table(spark, sf_dir, "pos_transactions"))
    moves = dedup.surplus(movement_ids(table(spark, sf_dir, "inventory_events")), "record_id", ["event_id", "business_id"])
    named = lambda df, name: df.select(F.lit(name).alias("source_table"), "record_id")
    return named(sales, "pos_transactions").unionByName(named(moves, "inventory_events"))


def corrected_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "pos_transactions")
    kept = late.timed_sales(sales).join(surplus_sales(sales), "record_id", "left_anti")
    return late.replay(kept, INCREMENTS).current()


def p2_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every store and window as corrected."""
    return corrected_windows(spark, sf_dir).select("store_id", "window_start_s", F.col("revenue").cast("decimal(18,2)").alias("revenue"), "transactions")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.differences(corrected_windows(spark, sf_dir), table(spark, sf_dir, "store_revenue_5m"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = table(spark, sf_dir, "product_updates")
    known = orphans.parents(products, table(spark, sf_dir, "customer_events"), table(spark, sf_dir, "store_reference"))
    return orphans.orphans(orphans.references(table(spark, sf_dir, "pos_transactions")), known, orphans.withdrawn(products))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("record_id", "ref_table", "ref_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad references per parent table and day."""
    return orphans.orphan_report(_orphans(spark, sf_dir))


def _lines_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales lines with the product version valid at their time."""
    lines = table(spark, sf_dir, "vw_sales").select("transaction_id", "line_number", "product_id", micros(F.col("event_ts_utc")).alias("at_us"), "brand", "category", "subcategory", "quantity", "cost_amount")
    dim = table(spark, sf_dir, "dim_product").select("product_id", micros(F.col("effective_from_utc")).alias("low_us"), micros(F.col("effective_to_utc")).alias("high_us"), "version_number", "product_key", "brand", "category", "subcategory", "unit_cost")
    return asof.attach_as_of(lines, dim, "product_id", "at_us", "low_us", "high_us", ["brand", "category", "subcategory", "unit_cost", "version_number"], ["low_us", "version_number", "product_key"], ["transaction_id", "line_number"])


def p4_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the attributes valid at its time (null where no version is)."""
    v = _lines_as_of(spark, sf_dir)
    return v.select("transaction_id", "line_number", "product_id", *[F.col(f"version.{c}").alias(c) for c in ("brand", "category", "subcategory", "version_number")], (F.col("quantity") * F.col("version.unit_cost")).cast("decimal(18,2)").alias("cost_amount"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _lines_as_of(spark, sf_dir).where("version is not null")  # a line without a version is no case
    same = F.lit(True)
    for c in ("brand", "category", "subcategory"):
        same &= F.col(c).eqNullSafe(F.col(f"version.{c}"))
    cost = F.col("quantity").cast("decimal(18,0)") * F.col("version.unit_cost")
    same &= F.col("cost_amount").cast("decimal(31,2)").eqNullSafe(cost.cast("decimal(31,2)"))
    return v.where(~same).select("transaction_id", "line_number")


def _changes(df: DataFrame, source: str, entity: str, first: str, second: str, nth: int) -> DataFrame:
    """Updates for the ledger with event_id, ord (unique over the tables) and arrival."""
    comparable = lambda c: F.col(f"payload.{c}").cast("string") if c == "list_price" else history.normal(F.col(f"payload.{c}"))
    event = F.when(F.col("metadata.event_id").isNotNull(), F.concat(F.lit(f"{nth}|"), F.col("metadata.event_id")))
    return df.select(F.lit(source).alias("source_table"), F.col(f"payload.{entity}").alias("entity_id"), micros(rfc3339(F.col("metadata.event_timestamp"))).alias("valid_from"), F.col("record_id").alias("seq"), F.struct(comparable(first).alias("a"), comparable(second).alias("b")).alias("attrs"), event.alias("event_id"), (F.col("record_id") * 2 + nth).alias("ord"), micros(F.col("kafka_timestamp")).alias("arrived"))


def history_ledger(spark: SparkSession, sf_dir: str) -> history.Ledger:
    """The bitemporal ledger of products and customers, fed in LEDGER_BATCHES arrival slices of equal record_id range.

    Records with the same event_id count once (the smallest record_id). A batch is recorded when its last record arrived.
    """
    every = written(_changes(table(spark, sf_dir, "product_updates"), "product_updates", "product_id", "list_price", "category", 0).unionByName(_changes(table(spark, sf_dir, "customer_events"), "customer_events", "customer_id", "loyalty_tier", "home_store_id", 1)), "changes")
    bounds = {r.source_table: (r.low, r.high) for r in every.groupBy("source_table").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect()}  # one row per source table
    slot = F.lit(0)
    for name, (low, high) in bounds.items():
        slot = F.when(F.col("source_table") == name, F.least(F.floor((F.col("seq") - low) * LEDGER_BATCHES / max(1, high - low)), F.lit(LEDGER_BATCHES - 1))).otherwise(slot)
    updates = written(dedup.keep_first(every, "ord", ["event_id"]).withColumn("slot", slot.cast("int")), "updates")
    times = {r.slot: r.t for r in updates.groupBy("slot").agg(F.max("arrived").alias("t")).collect()}  # one row per batch
    ledger = history.Ledger(spark, work_path(spark, "ledger"))
    for batch in sorted(times):
        ledger.apply(batch, updates.where(F.col("slot") == batch), times[batch])
    return ledger


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ledger rows, superseded ones included."""
    return history_ledger(spark, sf_dir).rows().select("source_table", "entity_id", "valid_from", "valid_to", "seq", "recorded_at", "superseded_at", F.col("attrs.a").alias("attribute_a"), F.col("attrs.b").alias("attribute_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.versions(history_ledger(spark, sf_dir).believed())
    return out.select("source_table", "entity_id", "version_no", F.col("valid_from").alias("valid_from_us"), F.col("valid_to").alias("valid_to_us"))


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat line table: quantity and unit_price as written."""
    return nested.flat_lines(table(spark, sf_dir, "landing_events"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = p6_lines(spark, sf_dir)
    return lines.select("raw_id", "transaction_id", "line_pos", "product_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_corrected, p3_found, p3_report, p4_found, p4_attributes, p5_found, p5_ledger, p6_found, p6_lines, p7_found)}
