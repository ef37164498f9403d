"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Settings every job of this package relies on; a cluster may override all but the first two.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, app: str = "millrace", shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with UTC, ANSI off, adaptive execution and a RocksDB state store.

    shuffle_partitions: left to the cluster (and to adaptive execution) unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SETTINGS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf | (extra or {})).getOrCreate()


def pin_semantics(spark: SparkSession) -> None:
    """UTC and non-ANSI casts, which the results depend on, in a session built elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"millrace-{os.getuid()}-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that cuts lineage."""
    run = f"{shared_dir(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(clean_up, spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


_RUNS: set[str] = set()


def clean_up(spark: SparkSession, run: str | None = None) -> None:
    """Delete the work tables of this application (all of them: results that read them must be written by then).

    Done when the driver's process ends; a long-running one may do it between queries.
    """
    for path in [run] if run else [x for x in _RUNS if x.endswith(f"run-{spark.sparkContext.applicationId}")]:
        try:
            jvm = spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
        except Exception:  # the JVM may be gone already; the folder is then left to its owner
            pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, reliably checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, written to and read from a Parquet table in the shared folder."""
    path = work_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Largest table that is broadcast, in bytes as rows are held (fixed parts and texts).
BROADCAST_BYTES = 64 << 20


def row_bytes(schema: StructType, at: str = "") -> Column:
    """About the bytes a row takes: 16 per value, and the lengths of texts, arrays by their number of elements."""
    size = F.lit(0)
    for f in schema.fields:
        name = f"{at}`{f.name}`"
        if isinstance(f.dataType, StructType):
            size = size + row_bytes(f.dataType, f"{name}.")
        elif isinstance(f.dataType, (StringType, BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            size = size + 16 + 32 * F.greatest(F.size(name), F.lit(0))
        else:
            size = size + 16
    return size


def broadcastable(df: DataFrame, limit: int | None = None) -> bool:
    """Whether df takes at most BROADCAST_BYTES (or limit), by measure; df should be written or checkpointed, as it is read for this."""
    size = df.agg(F.sum(row_bytes(df.schema)).alias("n")).first().n or 0
    return size <= (BROADCAST_BYTES if limit is None else limit)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many tasks as there are cores, by hash of key; as it is where the input has as many already.

    For work that costs far more than moving its rows; a large input is never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
