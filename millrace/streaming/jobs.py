"""The streaming queries: stateless ingest (nothing is lost for being late) and stateful real-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.contracts import POS, Dataset
from millrace.operators.decode import parse, unframe
from millrace.operators.rules import DERIVED, apply_rules, rules_for
from millrace.operators.windows import product_units_1h, store_revenue_5m, watermarked

INGEST_TRIGGER, REALTIME_TRIGGER = "30 seconds", "10 seconds"
OBSERVED = "ingest"


def validated(records: DataFrame, dataset: Dataset, now: Column | str | None = None) -> DataFrame:
    """Source records, decoded, parsed and judged by the rules of their dataset."""
    return apply_rules(parse(unframe(records), dataset), rules_for(dataset), now, DERIVED.get(dataset.name))


def observed(df: DataFrame, name: str = OBSERVED) -> DataFrame:
    """df with per-batch counts and lag collected on the way, without another pass."""
    lag = F.current_timestamp().cast("double") - F.col("event_ts").cast("double")
    valid = F.when(F.col("is_valid"), lag)
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected"), F.count_if(F.col("is_valid") & (F.size("dq_warnings") > 0)).alias("warned"), F.max(valid).alias("max_lag_s"), F.avg(valid).alias("avg_lag_s"))


def _start(df: DataFrame, name: str, mode: str, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return df.writeStream.queryName(name).outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_ingest(records: DataFrame, dataset: Dataset, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, now: Column | str | None = None) -> StreamingQuery:
    """Stateless: no watermark, so an event of any age is landed."""
    return _start(observed(validated(records, dataset, now)), f"ingest-{dataset.name}", "append", write, checkpoint, trigger or {"processingTime": INGEST_TRIGGER})


def valid_sales(records: DataFrame, now: Column | str | None = None) -> DataFrame:
    """The columns that windows need, of valid sales, de-duplicated: little state."""
    good = validated(records, POS, now).where("is_valid")
    slim = good.select(F.col("metadata.event_id").alias("event_id"), "event_ts", F.col("payload.store_id").alias("store_id"), F.col("payload.line_items").alias("line_items"), F.col("payload.total_amount").alias("total_amount"))
    return watermarked(slim)


def start_realtime(source: Callable[[], DataFrame], writers: dict[str, Callable[[DataFrame, int], None]], checkpoints: str, trigger: dict | None = None, now: Column | str | None = None) -> list[StreamingQuery]:
    """Two independent queries, each with its own reader and checkpoint, in update mode with absolute values."""
    aggregates = {"store_revenue_5m": store_revenue_5m, "product_units_1h": product_units_1h}
    return [_start(aggregates[name](valid_sales(source(), now)), f"realtime-{name}", "update", write, f"{checkpoints}/{name}", trigger or {"processingTime": REALTIME_TRIGGER}) for name, write in writers.items()]


def supervise(spark: SparkSession, stop: Callable[[], bool], poll_s: int = 5) -> None:
    """Until `stop` says so, or a query dies (its error is raised); in the end all queries are stopped."""
    try:
        while not stop():
            if spark.streams.awaitAnyTermination(poll_s):
                for q in spark.streams.active:
                    q.stop()
                spark.streams.resetTerminated()
                return
    finally:
        for q in spark.streams.active:
            q.stop()
