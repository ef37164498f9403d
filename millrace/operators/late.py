"""Per-period aggregates by event time, corrected as late records arrive, until a cut-off.

A batch of arrivals names the periods it touches. Its records are appended to the retained ones of these periods, exactly
these periods are recomputed entirely from their retained records and written as a new version, and one rename publishes
the manifest that says which version of each period holds: a reader sees all of a batch's corrections or none, a job that
dies leaves the former manifest in force, and a batch that comes again replaces what its first attempt wrote. Periods not
touched are neither read nor written. A period whose end lies KEEP_S behind the newest event is closed: its retained
records are deleted, its last version stays, and records that still come for it are set aside, not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.clock import micros, rfc3339, window_start_s
from millrace.operators.parts import Parts
from millrace.session import work_path, written
from millrace.sources.landing import Files

WINDOW_S = 300
LATENESS_S = 6 * 3600
#: A partition of the tables; a multiple of the window.
PERIOD_S = 86_400
#: The cut-off: how long after its end (by the newest event seen) a period is still corrected.
KEEP_S = 14 * 86_400


def timed_sales(df: DataFrame, lateness_s: int = LATENESS_S, window_s: int = WINDOW_S, period_s: int = PERIOD_S) -> DataFrame:
    """The records that count: store_id, window_start_s, period, amount, record_id, batch.

    Dropped, by definition: a record whose event_timestamp or produced_at is null or not RFC 3339 with a zone, one
    produced more than lateness_s after its event (exactly lateness_s still counts; produced before the event too), and
    one without store. A null amount counts as a transaction of 0. A null batch is the first.
    """
    event, produced = micros(rfc3339(F.col("metadata.event_timestamp"))), micros(rfc3339(F.col("metadata.produced_at")))
    slim = df.select("record_id", F.col("payload.store_id").alias("store_id"), event.alias("event_us"), produced.alias("produced_us"), F.coalesce("payload.total_amount", F.lit(0)).cast("decimal(18,6)").alias("amount"), F.coalesce("spark_batch_id", F.lit(-1)).cast("bigint").alias("batch"))
    slim = slim.where(F.col("store_id").isNotNull() & (F.col("produced_us") - F.col("event_us") <= lateness_s * 1_000_000))
    slim = slim.withColumn("window_start_s", window_start_s(F.col("event_us"), window_s))
    return slim.select("record_id", "store_id", "window_start_s", F.floor(F.col("window_start_s") / period_s).cast("int").alias("period"), "amount", "batch")


RETAINED = "record_id bigint, store_id string, window_start_s bigint, amount decimal(18,6), period int, arrival int"
TOTALS = "store_id string, window_start_s bigint, revenue decimal(38,6), transactions bigint"


class CorrectedWindows:
    """The retained records and the versions of the aggregates (operators/parts.py) under one root.

    raw/period=P/arrival=B: retained records of batch B. aside/arrival=B: its records of closed periods. The newest window
    seen is published along with the versions.
    """

    def __init__(self, spark: SparkSession, root: str, keep_s: int = KEEP_S):
        self.spark, self.root, self.keep_s, self.parts, self._files = spark, root.rstrip("/"), keep_s, Parts(spark, root, "period"), Files(spark, root)

    @property
    def newest(self) -> int | None:
        return self.parts.note

    def closed(self, period: int) -> bool:
        return self.newest is not None and (period + 1) * PERIOD_S + self.keep_s <= self.newest

    def arrive(self, number: int, records: DataFrame) -> list[int]:
        """Take a batch (columns of timed_sales; written or cached, as it is read twice); the periods it corrected.

        Batches are numbered upwards; one that was taken already changes nothing.
        """
        if number <= self.parts.applied:
            return []
        found = {r.period: r.newest for r in records.groupBy("period").agg(F.max("window_start_s").alias("newest")).collect()}  # one row per period
        touched, shut = sorted(p for p in found if not self.closed(p)), [p for p in found if self.closed(p)]
        own = records.select("record_id", "store_id", "window_start_s", "amount", "period").withColumn("arrival", F.lit(number))
        if shut:
            own.where(F.col("period").isin(shut)).drop("arrival").write.mode("overwrite").parquet(f"{self.root}/aside/arrival={number}")
        if touched:
            # Rebalancing splits what is large of a period and joins what is small.
            fresh = own.where(F.col("period").isin(touched)).hint("rebalance", "period")
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "arrival").parquet(f"{self.root}/raw")
            totals = self.retained(touched).where(F.col("arrival") <= number).groupBy("period", "store_id", "window_start_s").agg(F.sum(F.col("amount").cast("decimal(28,6)")).alias("revenue"), F.count(F.lit(1)).alias("transactions"))
            self.parts.write(number, totals)
        newest = max([*found.values(), *([self.newest] if self.newest is not None else [])], default=None)
        self.parts.publish(number, touched, newest)
        for p in [p for p in self.parts.versions if self.closed(p)]:
            self._files.delete(f"{self.root}/raw/period={p}")
        return touched

    def retained(self, periods: list[int]) -> DataFrame:
        """The retained records of some periods; no other folder is listed."""
        return self.spark.read.schema(RETAINED).option("basePath", f"{self.root}/raw").parquet(*[f"{self.root}/raw/period={p}" for p in periods])

    def current(self) -> DataFrame:
        """store_id, window_start_s, revenue, transactions as corrected by all batches."""
        return self.parts.read(TOTALS)

    def set_aside(self) -> DataFrame:
        """The records that came for closed periods."""
        kind = RETAINED.replace(", arrival int", "")
        paths = [f"{self.root}/aside/{n}" for n, _, _ in self._files.children(f"{self.root}/aside")]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)


def replay(records: DataFrame, increments: int, root: str | None = None, keep_s: int = KEEP_S) -> CorrectedWindows:
    """Feed records (columns of timed_sales) to CorrectedWindows in `increments` arrival slices of equal batch range.

    The final state does not depend on the slicing as long as no record comes for a closed period (set_aside says).
    """
    spark = records.sparkSession
    windows = CorrectedWindows(spark, root or work_path(spark, "late"), keep_s)
    records = written(records, "arrivals")
    low, high = records.agg(F.min("batch"), F.max("batch")).first()
    if low is None:
        return windows
    width = max(1, -(-(high - low + 1) // increments))
    for number, start in enumerate(range(low, high + 1, width)):
        windows.arrive(number, records.where((F.col("batch") >= start) & (F.col("batch") < start + width)))
    return windows


def differences(corrected: DataFrame, published: DataFrame) -> DataFrame:
    """store_id, window_start_s where the published revenue or transactions differ; absent on either side is 0 and 0.

    Both sides are combined to one row per store and window first, so repeated published rows add up.
    """
    sides = corrected.select("store_id", "window_start_s", F.col("revenue").cast("decimal(28,6)").alias("revenue"), "transactions")
    other = published.select("store_id", F.floor(micros(F.col("window_start")) / 1_000_000).cast("bigint").alias("window_start_s"), (-F.coalesce("revenue", F.lit(0)).cast("decimal(28,6)")).alias("revenue"), (-F.coalesce("transactions", F.lit(0))).cast("bigint").alias("transactions"))
    both = sides.unionByName(other.where("store_id is not null and window_start_s is not null"))
    net = both.groupBy("store_id", "window_start_s").agg(F.sum("revenue").alias("revenue"), F.sum("transactions").alias("transactions"))
    return net.where("revenue <> 0 or transactions <> 0").select("store_id", "window_start_s")
