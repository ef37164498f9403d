"""Reconciliation of the log, the ingest audit, the raw layer and staging, per topic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators.quality import latest_audit


def gather(watermarks: DataFrame, audit: DataFrame, raw: DataFrame, staged: DataFrame) -> DataFrame:
    """One row per topic with what each layer knows.

    watermarks: topic, partition, low, high (high: the next offset). audit: audit rows, of which the last per batch and
    partition counts. raw: kafka_topic, kafka_partition, kafka_offset, business_key. staged: topic, staged_keys; no row
    or null means the dataset has no business key. Raw offsets and keys are both taken from the primary topic only.
    """
    last = latest_audit(audit)
    upto = last.groupBy(F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition")).agg(F.max("max_offset").alias("max_offset"))
    log = watermarks.join(upto, ["topic", "partition"], "left")
    behind = F.greatest(F.col("high") - F.greatest(F.coalesce(F.col("max_offset") + 1, F.col("low")), F.col("low")), F.lit(0))
    log = log.groupBy("topic").agg(F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("in_retention"), F.sum(behind).alias("not_yet_processed"))
    spark = last.groupBy(F.col("kafka_topic").alias("topic")).agg(F.sum("records_read").alias("spark_read"), F.sum("records_valid").alias("spark_valid"), F.sum("records_rejected").alias("spark_rejected"))
    kept = raw.groupBy(F.col("kafka_topic").alias("topic")).agg(F.count_distinct("kafka_partition", "kafka_offset").alias("raw_offsets"), F.count_distinct("business_key").alias("raw_keys"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [log, spark, kept, staged.select("topic", "staged_keys")])
    out = every.groupBy("topic").agg(*[F.max(c).alias(c) for c in every.columns if c != "topic"]).where("in_retention is not null")
    return out.fillna(0, ["spark_read", "spark_valid", "spark_rejected", "raw_offsets", "raw_keys"])


def reconcile(gathered: DataFrame) -> DataFrame:
    """Adds not_yet_loaded, duplicates (null without business key), balanced, unexplained and status.

    INVESTIGATE if read is not valid plus rejected, or if raw holds more offsets than were valid (lag explains only less).
    """
    over = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    out = gathered.withColumns({
        "balanced": F.col("spark_read") == F.col("spark_valid") + F.col("spark_rejected"),
        "not_yet_loaded": over("spark_valid", "raw_offsets"),
        "unexplained": over("raw_offsets", "spark_valid"),
        "duplicates": F.when(F.col("staged_keys").isNotNull(), over("raw_offsets", "raw_keys")),
        "keys_not_staged": F.when(F.col("staged_keys").isNotNull(), over("raw_keys", "staged_keys")),
    })
    return out.withColumn("status", F.when(F.col("balanced") & (F.col("unexplained") == 0), "OK").otherwise("INVESTIGATE"))


def gate(report: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: passed is false if any topic is to be investigated or any ERROR rule failed."""
    bad = report.where("status <> 'OK'").select(F.lit(1).alias("x")).unionByName(quality.where("severity = 'ERROR' and status = 'FAIL'").select(F.lit(1).alias("x")))
    return bad.agg((F.count("x") == 0).alias("passed"))
