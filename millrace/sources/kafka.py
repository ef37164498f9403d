"""Sources of framed records: a broker, or files of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.contracts import KAFKA, Dataset


def kafka_stream(spark: SparkSession, dataset: Dataset, bootstrap: str, max_offsets: int, starting: str = "earliest", options: dict[str, str] | None = None) -> DataFrame:
    """A dataset's primary and retry topics; committed records only, headers included. Needs the connector on the class path."""
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": bootstrap, "subscribe": f"{dataset.topic},{dataset.retry}", "startingOffsets": starting, "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(max_offsets), "kafka.isolation.level": "read_committed", "includeHeaders": "true"})
    return reader.options(**(options or {})).load()


def file_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Parquet files of the source's shape, found in subfolders too; max_files per trigger takes the place of the offset cap."""
    return spark.readStream.schema(KAFKA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).parquet(path)


def kafka_sink(records: DataFrame, bootstrap: str, options: dict[str, str] | None = None) -> None:
    """Append records (topic, key, value, headers) idempotently, acknowledged by all replicas."""
    records.write.format("kafka").options(**{"kafka.bootstrap.servers": bootstrap, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "zstd", "includeHeaders": "true"}).options(**(options or {})).save()
