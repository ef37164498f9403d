"""Set-level data-quality rules SF-001 to SF-008. Each gives one row; none raises.

rule_id, severity, status (PASS, FAIL), observed, threshold (decimal(38,4)), details (JSON). All clocks are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.keys import UNKNOWN

NAMES = {
    "SF-001": ("INFO", "transport duplicates in the raw layer"),
    "SF-002": ("WARN", "business duplicates"),
    "SF-003": ("WARN", "facts on inferred members"),
    "SF-004": ("ERROR", "facts with unknown keys"),
    "SF-005": ("ERROR", "valid records per batch equal loaded records"),
    "SF-006": ("ERROR", "completeness from raw to staging to facts"),
    "SF-007": ("WARN", "minutes that facts lag behind"),
    "SF-008": ("WARN", "stock on hand progresses by the movements"),
}
FRESH_MINUTES = 60


def result(df: DataFrame, rule_id: str, observed: Column, details: Column, threshold: int = 0, failed: Column | None = None) -> DataFrame:
    severity, name = NAMES[rule_id]
    bad = failed if failed is not None else observed > threshold
    wide = lambda c: c.cast("decimal(38,4)")
    return df.select(F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"), F.when(bad, "FAIL").otherwise("PASS").alias("status"), wide(observed).alias("observed"), wide(F.lit(threshold)).alias("threshold"), F.to_json(details).alias("details"))


def sf001(raw: dict[str, DataFrame]) -> DataFrame:
    """raw: datasets with event_id (already restricted to the period of interest)."""
    each = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("dataset"), "event_id") for name, df in raw.items()])
    per = each.groupBy("dataset", "event_id").agg(F.count(F.lit(1)).alias("n")).groupBy("dataset").agg((F.sum("n") - F.count("event_id")).alias("dup"))
    return result(per.agg(F.coalesce(F.sum("dup"), F.lit(0)).alias("t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "dup")))).alias("d")), "SF-001", F.col("t"), F.col("d"))


def sf002(duplicates: DataFrame, samples: int = 10) -> DataFrame:
    """duplicates: business_key. The sample is the smallest keys, by a top-k, never a whole collection."""
    few = duplicates.select("business_key").orderBy("business_key").limit(samples).agg(F.array_sort(F.collect_list("business_key")).alias("sample_keys")).withColumn("n", F.lit(0).cast("bigint"))
    count = duplicates.agg(F.count(F.lit(1)).alias("n")).withColumn("sample_keys", F.lit(None).cast("array<string>"))
    return result(few.unionByName(count).agg(F.sum("n").alias("n"), F.max("sample_keys").alias("sample_keys")), "SF-002", F.col("n"), F.struct("sample_keys"))


def _counts(**parts: DataFrame) -> DataFrame:
    """One row with a count per name; the frames have column n of one row each."""
    named = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("k"), F.col("n").cast("bigint").alias("n")) for k, df in parts.items()])
    return named.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in parts])


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def sf003(sales: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    inferred = lambda dim, key: dim.where("is_inferred").select(key)
    c = _counts(sales_inferred_product=_n(sales.join(inferred(products, "product_key"), "product_key", "left_semi")), sales_inferred_customer=_n(sales.join(inferred(customers, "customer_key"), "customer_key", "left_semi")), inferred_products=_n(products.where("is_inferred")))
    return result(c, "SF-003", F.col("sales_inferred_product") + F.col("sales_inferred_customer"), F.struct("sales_inferred_product", "sales_inferred_customer", "inferred_products"))


def sf004(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    has = lambda keys: reduce(lambda a, b: a | b, [F.col(k) == UNKNOWN for k in keys])
    c = _counts(fact_sales=_n(sales.where(has(("store_key", "date_key", "product_key", "customer_key")))), fact_inventory=_n(inventory.where(has(("store_key", "date_key", "product_key")))))
    return result(c, "SF-004", F.col("fact_sales") + F.col("fact_inventory"), F.struct("fact_sales", "fact_inventory"))


def latest_audit(audit: DataFrame) -> DataFrame:
    """One row per dataset, query, batch, topic and partition: the last processed, so a batch landed again counts once."""
    key = ["dataset", "spark_query_id", "spark_batch_id", "kafka_topic", "kafka_partition"]
    rest = [c for c in audit.columns if c not in key]
    return audit.groupBy(*key).agg(F.max_by(F.struct(*rest), "processed_at").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def sf005(audit: DataFrame, raw: DataFrame) -> DataFrame:
    """audit rows against distinct raw offsets (dataset, spark_query_id, spark_batch_id, kafka_topic, kafka_partition, kafka_offset)."""
    key = ["dataset", "spark_query_id", "spark_batch_id"]
    valid = latest_audit(audit).groupBy(*key).agg(F.sum("records_valid").alias("valid"))
    loaded = raw.groupBy(*key).agg(F.count_distinct("kafka_topic", "kafka_partition", "kafka_offset").alias("loaded"))
    both = valid.unionByName(loaded, allowMissingColumns=True).groupBy(*key).agg(F.max("valid").alias("valid"), F.coalesce(F.max("loaded"), F.lit(0)).alias("loaded")).where("valid is not null")
    wrong = F.coalesce(F.count_if(F.col("valid") != F.col("loaded")), F.lit(0))
    total = both.agg(F.count(F.lit(1)).alias("batches_checked"), F.coalesce(F.sum("valid"), F.lit(0)).alias("records_valid"), F.coalesce(F.sum("loaded"), F.lit(0)).alias("records_loaded"), wrong.alias("wrong"))
    return result(total, "SF-005", F.col("wrong"), F.struct("batches_checked", "records_valid", "records_loaded"))


def sf006(raw_keys: DataFrame, staged_keys: DataFrame, raw_moves: DataFrame, staged_moves: DataFrame, staged_lines: DataFrame, facts: DataFrame) -> DataFrame:
    c = _counts(
        pos_transactions_not_staged=_n(raw_keys.distinct().join(staged_keys, raw_keys.columns, "left_anti")), inventory_movements_not_staged=_n(raw_moves.distinct().join(staged_moves, raw_moves.columns, "left_anti")),
        staged_lines_not_in_fact_sales=_n(staged_lines.join(facts, ["transaction_id", "line_number"], "left_anti")),
    )
    names = ["pos_transactions_not_staged", "inventory_movements_not_staged", "staged_lines_not_in_fact_sales"]
    return result(c, "SF-006", F.col(names[0]) + F.col(names[1]) + F.col(names[2]), F.struct(*names))


def sf007(sales: DataFrame, now: str) -> DataFrame:
    """Fails beyond FRESH_MINUTES, and without any fact."""
    top = sales.agg(F.max("event_ts").alias("max_event_ts_utc"))
    behind = F.timestamp_diff("MINUTE", F.col("max_event_ts_utc"), F.lit(now).cast("timestamp"))
    return result(top, "SF-007", behind, F.struct("max_event_ts_utc"), FRESH_MINUTES, F.coalesce(behind, F.lit(10**9)) > FRESH_MINUTES)


def sf008(inventory: DataFrame) -> DataFrame:
    """Movements of the period; the first of each store and product has nothing to compare with.

    The window is per store and product; movements of a pair are few against the table even where a store is hot.
    """
    prior = F.lag("quantity_on_hand_after").over(Window.partitionBy("store_id", "product_id").orderBy("event_ts", "movement_id"))
    rows = inventory.withColumn("prior", prior)
    c = rows.agg(F.count_if(F.col("quantity_on_hand_after") - F.col("prior") != F.col("quantity_delta")).alias("n"), F.count_if(F.col("prior").isNotNull()).alias("movements_checked"))
    return result(c, "SF-008", F.col("n"), F.struct("movements_checked"))


def run_checks(results: list[DataFrame]) -> DataFrame:
    """All results; the gate fails on any ERROR with FAIL (see errors)."""
    return reduce(DataFrame.unionByName, results)


def errors(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if((F.col("severity") == "ERROR") & (F.col("status") == "FAIL")).alias("errors"))
