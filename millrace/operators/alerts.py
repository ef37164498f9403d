"""Alert predicates over tables of metric samples: name, labels (one text), ts, value.

Counters may restart: an increase adds the steps upwards, and a step down counts as the new value. A condition "for" some
minutes must hold at every sample of that period, and the samples must reach back to its start.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Alert(NamedTuple):
    alert_id: str
    severity: str
    metric: str
    kind: str  # increase, rate, age, value or changes
    minutes: int  # length of the range, or how long the condition must hold
    threshold: float
    below: bool = False


ALERTS = [
    Alert("ALR-01", "critical", "producer_failed_total", "increase", 5, 0),
    Alert("ALR-02", "warning", "producer_validation_failures_total", "increase", 10, 0),
    Alert("ALR-03", "critical", "query_failures_total", "increase", 10, 0),
    Alert("ALR-04", "critical", "query_last_progress_seconds", "age", 2, 180),
    Alert("ALR-05", "warning", "offsets_behind_max", "value", 5, 20_000),
    Alert("ALR-07", "warning", "late_rows_dropped_total", "increase", 15, 50),
    Alert("ALR-08", "warning", "loader_last_success_seconds", "age", 0, 2_700),
    Alert("ALR-09", "warning", "landing_backlog_batches", "value", 15, 200),
    Alert("ALR-10", "critical", "loader_up", "changes", 30, 3),
    Alert("ALR-11", "critical", "component_up", "value", 2, 1, True),
    Alert("ALR-12", "warning", "dlq_offset_total", "rate", 5, 30),
]


def increases(samples: DataFrame) -> DataFrame:
    """samples with `step`: what a counter rose since the sample before."""
    prior = F.lag("value").over(Window.partitionBy("name", "labels").orderBy("ts"))
    return samples.withColumn("step", F.when(prior.isNull(), 0.0).when(F.col("value") < prior, F.col("value")).otherwise(F.col("value") - prior)).withColumn("moved", (prior.isNotNull() & (F.col("value") != prior)).cast("int"))


def evaluate(samples: DataFrame, now: str) -> DataFrame:
    """alert_id, severity, labels, observed of every alert that fires at `now`; also ALR-06 on rejected against input rows."""
    at = F.lit(now).cast("timestamp")
    recent = increases(samples.where(F.col("ts") <= at))
    spark = samples.sparkSession
    table = spark.createDataFrame([(*a[:5], float(a.threshold), a.below) for a in ALERTS], "alert_id string, severity string, name string, kind string, minutes int, threshold double, below boolean")
    rows = recent.join(F.broadcast(table), "name")  # eleven rows
    age = (at.cast("double") - F.col("ts").cast("double")) / 60
    inside: Column = age <= F.col("minutes")
    value = F.when(F.col("kind") == "age", at.cast("double") - F.col("value")).otherwise(F.col("value"))
    holds = F.when(F.col("below"), value < F.col("threshold")).otherwise(value > F.col("threshold"))
    by = rows.groupBy("alert_id", "severity", "kind", "minutes", "threshold", "labels").agg(
        F.sum(F.when(inside, F.col("step"))).alias("rise"), F.sum(F.when(inside, F.col("moved"))).alias("changes"), F.max_by(value, "ts").alias("last"), F.max_by(holds, "ts").alias("last_holds"), F.bool_and(F.when(inside, holds)).alias("all_hold"), F.max(age).alias("oldest"), F.max_by(F.when(age > F.col("minutes"), holds), F.when(age > F.col("minutes"), F.col("ts"))).alias("before"),
    )
    lasting = F.col("last_holds") & ((F.col("minutes") == 0) | (F.coalesce("all_hold", F.lit(True)) & (F.col("oldest") >= F.col("minutes")) & F.coalesce("before", F.lit(True))))
    kind = F.col("kind")
    # The rate is per minute.
    observed = F.when(kind == "increase", F.col("rise")).when(kind == "rate", F.col("rise") / F.col("minutes")).when(kind == "changes", F.col("changes").cast("double")).otherwise(F.col("last"))
    fires = F.when(kind.isin("value", "age"), lasting).otherwise(observed > F.col("threshold"))
    out = by.where(fires).select("alert_id", "severity", "labels", observed.alias("observed"))
    window = recent.where(F.col("name").isin("records_rejected_total", "input_rows_total") & ((at.cast("double") - F.col("ts").cast("double")) <= 300))
    share = window.groupBy("labels").agg(F.sum(F.when(F.col("name") == "records_rejected_total", F.col("step"))).alias("r"), F.sum(F.when(F.col("name") == "input_rows_total", F.col("step"))).alias("i"))
    rejects = share.withColumn("observed", F.col("r") / F.greatest("i", F.lit(1e-9))).where("observed > 0.05").select(F.lit("ALR-06").alias("alert_id"), F.lit("warning").alias("severity"), "labels", "observed")
    return out.unionByName(rejects)
