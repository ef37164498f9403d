"""Inspecting and redriving dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contracts import HEADERS, MAX_REDRIVES, REDRIVE_COUNT, Dataset
from millrace.operators.headers import last_text, replaced


def redrive_count() -> Column:
    """How often a record was redriven; 0 if the header is missing or no number."""
    return F.coalesce(last_text(REDRIVE_COUNT).try_cast("int"), F.lit(0))


def redrive(dead: DataFrame, dataset: Dataset, error_code: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records for the retry topic, report of outcomes with counts).

    Records of another error code are skipped_filter; redriven MAX_REDRIVES times or more they are loop_guarded unless
    force. Key and value stay byte for byte; the diagnostics go, the redrive count rises by one. A dry run is to use the
    report only; the caller commits its read position after the records are written.
    """
    wanted = F.lit(True) if error_code is None else F.coalesce(last_text(HEADERS["error_code"]) == error_code, F.lit(False))
    outcome = F.when(~wanted, "skipped_filter").when((redrive_count() >= MAX_REDRIVES) & F.lit(not force), "loop_guarded").otherwise("redriven")
    marked = dead.withColumn("outcome", outcome)
    records = marked.where("outcome = 'redriven'").select(F.lit(dataset.retry).alias("topic"), "key", "value", replaced({REDRIVE_COUNT: redrive_count() + 1}, HEADERS.values()).alias("headers"))
    return records, marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def inspect(dead: DataFrame) -> DataFrame:
    """error_code, error_stage, records, oldest, newest; most frequent first. Without headers: unknown."""
    code, stage = F.coalesce(last_text(HEADERS["error_code"]), F.lit("unknown")), F.coalesce(last_text(HEADERS["error_stage"]), F.lit("unknown"))
    by = dead.groupBy(code.alias("error_code"), stage.alias("error_stage")).agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    return by.orderBy(F.desc("records"), "error_code", "error_stage")
