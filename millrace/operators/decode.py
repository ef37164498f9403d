"""Framed records to typed envelopes. Nothing here throws on untrusted bytes: what cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contracts import Dataset

FRAME_BYTES = 5


def safe_text(data: Column) -> Column:
    """Bytes as text, or null if they are not valid UTF-8."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def repaired_text(data: Column) -> Column:
    """Bytes as text, invalid sequences replaced; for previews."""
    return F.make_valid_utf8(data.cast("string"))


def unframe(records: DataFrame) -> DataFrame:
    """Adds wire_ok, schema_id and body of a value framed as 0x00, four bytes of schema id (big-endian), JSON.

    wire_ok is false for null, for up to five bytes and for another first byte. Schema ids beyond a signed 32-bit number
    are null. body is null unless wire_ok and valid UTF-8.
    """
    value = F.col("value")
    framed = F.coalesce((F.length(value) > FRAME_BYTES) & (F.hex(F.substring(value, 1, 1)) == "00"), F.lit(False))
    ident = F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")
    return records.withColumns({"wire_ok": framed, "schema_id": F.when(framed & (ident < 1 << 31), ident.cast("int")), "body": F.when(framed, safe_text(F.substring(value, FRAME_BYTES + 1, 1 << 30)))})


def parse(records: DataFrame, dataset: Dataset) -> DataFrame:
    """Adds is_envelope, metadata, payload and event_ts.

    is_envelope: the body is an object whose metadata and payload are objects; found by the one parse that all else uses.
    A leaf of another type is null and its siblings stay; a body that is no JSON gives null structs. Unknown fields are
    ignored. event_ts is null if unreadable; a date alone is its midnight.
    """
    parsed = computed_once(records, "_p", F.from_json("body", dataset.envelope, {"mode": "PERMISSIVE"}))
    whole = F.coalesce(F.ltrim("body", F.lit(" \n\r\t")).startswith("{"), F.lit(False)) & F.col("_p.metadata").isNotNull() & F.col("_p.payload").isNotNull()
    return parsed.withColumns({"is_envelope": whole, "metadata": F.col("_p.metadata"), "payload": F.col("_p.payload"), "event_ts": F.col("_p.metadata.event_timestamp").try_cast("timestamp")}).drop("_p")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections read but never repeat the computation of.

    Filters are pushed through projections by repeating their expressions, not through a generator; this one yields one row.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def frame(body: Column, schema_id: int = 1) -> Column:
    """JSON text as a framed value; the inverse of unframe."""
    return F.concat(F.unhex(F.lit(f"00{schema_id:08x}")), F.encode(body, "UTF-8"))


def kafka_shaped(events: DataFrame, dataset: Dataset, schema_id: int = 1) -> DataFrame:
    """Typed events (record_id, metadata, payload, kafka_partition, kafka_timestamp) as records of the source's shape."""
    body = F.to_json(F.struct("metadata", "payload"), {"ignoreNullFields": "false"})
    return events.select(F.encode(F.col("metadata.event_id"), "UTF-8").alias("key"), frame(body, schema_id).alias("value"), F.lit(dataset.topic).alias("topic"), F.col("kafka_partition").cast("int").alias("partition"), F.col("record_id").alias("offset"), F.col("kafka_timestamp").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"), F.array().cast("array<struct<key: string, value: binary>>").alias("headers"))
