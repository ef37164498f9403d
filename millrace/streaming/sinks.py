"""Batch writers of the streaming queries: idempotent under replay."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.contracts import AUDIT, DEAD_LETTERS, Dataset
from millrace.operators.merge import upsert
from millrace.operators.outputs import audit, dead_letters, dead_records, landed
from millrace.sources.landing import Files, batch_path


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the checkpoint keeps over restarts; an error if the checkpoint has none."""
    try:
        rows = spark.read.text(f"{checkpoint}/metadata").collect()  # one line
        return json.loads("".join(r.value for r in rows))["id"]
    except Exception as e:
        raise ValueError(f"no query id in {checkpoint}") from e


class IngestWriter:
    """Lands one validated micro-batch: dead-letter records, dead-letter rows, audit, and last the events.

    The events' _SUCCESS marker commits the batch. A batch whose marker exists is skipped whole; otherwise every output is
    overwritten, so what a crashed attempt left vanishes (only dead-letter records may be sent again). An empty batch
    writes nothing; a batch of rejects only writes an empty events folder. files: output files per batch.
    """

    def __init__(self, dataset: Dataset, landing: str, checkpoint: str, send: Callable[[DataFrame], None], files: int = 1):
        self.dataset, self.landing, self.checkpoint, self.send, self.files = dataset, landing, checkpoint, send, files

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        qid = query_id(spark, self.checkpoint)
        path = lambda what: batch_path(self.landing, what, qid, batch_id)
        if Files(spark, self.landing).exists(f"{path(self.dataset.name)}/_SUCCESS"):
            return
        batch.persist()
        try:
            counts = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_valid")).alias("bad")).first()
            if not counts.n:
                return
            write = lambda df, what: df.coalesce(self.files).write.mode("overwrite").parquet(path(what))
            if counts.bad:
                self.send(dead_records(batch, self.dataset))
                write(dead_letters(batch, qid, batch_id), DEAD_LETTERS)
            write(audit(batch, self.dataset, qid, batch_id), AUDIT)
            write(landed(batch, qid, batch_id), self.dataset.name)
        finally:
            batch.unpersist()


def topic_folder(path: str) -> Callable[[DataFrame], None]:
    """Appends records to a folder that stands in for a topic."""
    return lambda records: records.write.mode("append").parquet(path)


class WindowTable:
    """A serving table of window aggregates with absolute values, upserted by key.

    A version is written beside the current one and the pointer file is replaced last, so readers never see half a batch.
    Rows older than `keep` are dropped every PURGE_EVERY batches. A batch with a number already applied is skipped.
    """

    PURGE_EVERY = 360

    def __init__(self, root: str, key: list[str], keep: str = "7 days"):
        self.root, self.key, self.keep = root.rstrip("/"), key, keep

    def _versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[2:]) for n, is_dir, _ in Files(spark, self.root).children(self.root) if is_dir and n.startswith("v="))

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The current rows; None before the first batch."""
        versions = self._versions(spark)
        return spark.read.parquet(f"{self.root}/v={versions[-1]}") if versions else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = self._versions(spark)
        if versions and versions[-1] >= batch_id:
            return
        rows = batch.withColumn("updated_at", F.current_timestamp())
        now = self.read(spark)
        merged = rows.dropDuplicates(self.key) if now is None else upsert(now, rows, self.key)
        if batch_id and batch_id % self.PURGE_EVERY == 0:
            merged = expired(merged, self.keep)[0]
        made = f"{self.root}/_writing-{batch_id}"
        merged.write.mode("overwrite").parquet(made)
        files = Files(spark, self.root)
        files.move(made, f"{self.root}/v={batch_id}")
        for v in versions[:-1]:  # the former version stays for readers that have begun
            files.delete(f"{self.root}/v={v}")


def expired(rows: DataFrame, keep: str, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows whose window began longer than `keep` ago)."""
    limit = (F.current_timestamp() if now is None else F.lit(now).cast("timestamp")) - F.expr(f"interval {keep}")
    return rows.where(F.col("window_start") >= limit), rows.where(F.col("window_start") < limit)


def jdbc_upsert(url: str, table: str, key: list[str], values: list[str], options: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer for a relational store: executors write a staging table, one statement merges it. Needs a driver on the class path."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{table}_stage_{batch_id}"
        batch.write.format("jdbc").options(url=url, dbtable=stage, **(options or {})).mode("overwrite").save()
        names = ", ".join([*key, *values])
        merge = f"insert into {table} ({names}) select {names} from {stage} on conflict ({', '.join(key)}) do update set " + ", ".join(f"{v} = excluded.{v}" for v in values)
        connection = spark._jvm.java.sql.DriverManager.getConnection(url)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            statement.executeUpdate(merge)
            statement.executeUpdate(f"drop table {stage}")
            connection.commit()
        finally:
            connection.close()

    return write
