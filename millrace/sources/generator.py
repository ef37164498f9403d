"""A deterministic generator of sales events for scale tests, and faults for it.

Everything derives from hashes of (seed, event number, purpose), so equal parameters give equal rows whatever the
partitioning. Product popularity falls off as a power of the rank (a Zipf-like tail); basket sizes are geometric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.contracts import POS
from millrace.operators.decode import frame

FAULTS = ("duplicate", "late", "unknown_product", "invalid_value", "missing_field", "malformed")


def uniform(seed: int, purpose: str, *parts: Column) -> Column:
    """A number in [0, 1) from the hash of its parts."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def sales(spark: SparkSession, count: int, seed: int = 7, stores: int = 30, products: int = 500, customers: int = 20_000, start: str = "2026-03-02 02:00:00", days: int = 7, partitions: int | None = None) -> DataFrame:
    """record_id, metadata, payload, kafka_partition, kafka_timestamp of `count` valid sales."""
    n = F.col("id")
    u = lambda purpose, *more: uniform(seed, purpose, n, *more)
    rank = lambda purpose, size, *more: F.floor(F.pow(u(purpose, *more), 3.0) * size)
    size = F.least(F.lit(10), 1 + F.floor(-F.log(1 - u("size")) / 0.5)).cast("int")
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.floor(u("at") * days * 86_400_000).cast("bigint") * 1000)
    line = lambda k: F.struct(k.cast("bigint").alias("line_number"), F.format_string("SKU-%05d", rank("product", products, k).cast("int")).alias("product_id"), (1 + F.floor(rank("quantity", 4, k))).cast("bigint").alias("quantity"), (F.floor(100 + u("price", k) * 9_900) / 100).cast("decimal(18,6)").alias("unit_price"), F.lit(0).cast("decimal(18,6)").alias("discount_amount"))
    rows = spark.range(0, count, 1, partitions or spark.sparkContext.defaultParallelism).withColumn("lines", F.transform(F.sequence(F.lit(1), size), line)).withColumn("at", at)
    total = F.aggregate("lines", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x["quantity"].cast("decimal(18,0)") * x["unit_price"] - x["discount_amount"]).cast("decimal(38,6)"))
    store = F.format_string("ST-%02d", rank("store", stores).cast("int"))
    ident = lambda purpose: F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), n.cast("string")))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select(
        n.alias("record_id"), F.struct(ident("event").alias("event_id"), F.lit(POS.event_types[0]).alias("event_type"), F.lit("1.0").alias("schema_version"), iso.alias("event_timestamp"), iso.alias("produced_at"), F.lit("millrace-generator").alias("producer"), ident("correlation").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id")).alias("metadata"),
        F.struct(F.concat(F.lit("TXN-"), n.cast("string")).alias("transaction_id"), store.alias("store_id"), F.format_string("REG-%02d", F.floor(u("register") * 9).cast("int")).alias("register_id"), F.when(u("guest") > 0.35, F.format_string("CUST-%07d", rank("customer", customers).cast("int"))).alias("customer_id"), F.element_at(F.array(F.lit("CASH"), F.lit("CARD"), F.lit("EWALLET")), (1 + F.floor(u("payment") * 3)).cast("int")).alias("payment_method"), F.lit("MYR").alias("currency"), F.col("lines").alias("line_items"), total.cast("decimal(18,6)").alias("total_amount")).alias("payload"),
        F.pmod(F.xxhash64(store), F.lit(POS.partitions)).cast("int").alias("kafka_partition"), F.col("at").alias("kafka_timestamp"),
    )


def with_faults(events: DataFrame, rates: dict[str, float], seed: int = 7, schema_id: int = 1) -> DataFrame:
    """Framed records of the source's shape with column fault (null: none); at most one fault per event, by cumulative rate.

    duplicate: delivered twice. late: two hours older. unknown_product: a product nobody has. invalid_value: quantity -1.
    missing_field: no event_id. malformed: half a body.
    """
    roll, so_far = uniform(seed, "fault", F.col("record_id")), 0.0
    fault = F.lit(None).cast("string")
    for name in FAULTS:
        so_far += rates.get(name, 0.0)
        fault = F.coalesce(fault, F.when(roll < so_far, name))
    df = events.withColumn("fault", fault)
    is_ = lambda name: F.coalesce(F.col("fault") == name, F.lit(False))
    stamp = lambda c: F.date_format(F.col(f"metadata.{c}").cast("timestamp") - F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.col("metadata").withField("event_timestamp", F.when(is_("late"), stamp("event_timestamp")).otherwise(F.col("metadata.event_timestamp"))).withField("event_id", F.when(~is_("missing_field"), F.col("metadata.event_id")))
    first = F.col("payload.line_items")[0]
    broken = F.when(is_("unknown_product"), first.withField("product_id", F.lit("SKU-99999"))).when(is_("invalid_value"), first.withField("quantity", F.lit(-1).cast("bigint"))).otherwise(first)
    payload = F.col("payload").withField("line_items", F.concat(F.array(broken), F.slice("payload.line_items", 2, 1 << 20)))
    body = F.to_json(F.struct(meta.alias("metadata"), payload.alias("payload")))
    out = df.withColumn("b", body).withColumn("b", F.when(is_("malformed"), F.left("b", (F.length("b") / 2).cast("int"))).otherwise(F.col("b")))
    out = out.withColumn("copy", F.explode(F.when(is_("duplicate"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.select(F.encode("payload.store_id", "UTF-8").alias("key"), frame(F.col("b"), schema_id).alias("value"), F.lit(POS.topic).alias("topic"), F.col("kafka_partition").alias("partition"), (F.col("record_id") * 2 + F.col("copy")).alias("offset"), F.col("kafka_timestamp").alias("timestamp"), F.lit(0).alias("timestampType"), F.array().cast("array<struct<key: string, value: binary>>").alias("headers"), "fault")


def dry_run(judged: DataFrame) -> DataFrame:
    """topic, outcome, records of validated records; sends nothing."""
    return judged.groupBy("topic", F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("outcome")).agg(F.count(F.lit(1)).alias("records"))
