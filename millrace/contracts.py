"""Datasets, topics and schemas of the event streams (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

METADATA = "event_id string, event_type string, schema_version string, event_timestamp string, produced_at string, producer string, correlation_id string, causation_id string"
POS_PAYLOAD = "transaction_id string, store_id string, register_id string, customer_id string, payment_method string, currency string, line_items array<struct<line_number: bigint, product_id: string, quantity: bigint, unit_price: decimal(18,6), discount_amount: decimal(18,6)>>, total_amount decimal(18,6)"
INVENTORY_PAYLOAD = "movement_id string, store_id string, product_id string, movement_type string, quantity_delta bigint, quantity_on_hand_after bigint, reason_code string, reference_id string, unit_cost decimal(18,6)"
CUSTOMER_PAYLOAD = "customer_id string, loyalty_tier string, home_store_id string, city string, state string, signup_date string, birth_year bigint, email_sha256 string, marketing_opt_in boolean"
PRODUCT_PAYLOAD = "product_id string, product_name string, brand string, category string, subcategory string, list_price decimal(18,6), unit_cost decimal(18,6), currency string, unit_of_measure string, is_active boolean"
#: What a Kafka source yields; file sources of the same shape stand in for it.
KAFKA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int, headers array<struct<key: string, value: binary>>"
STORE_CSV = "store_id string, store_name string, city string, state string, region string, store_format string, size_sqm bigint, opened_date date, timezone string, traffic_weight decimal(6,2)"


@dataclass(frozen=True)
class Dataset:
    """A logical dataset: its landing directory, its topics, the types of its events and the fields of its payload."""

    name: str
    topic: str
    event_types: tuple[str, ...]
    payload: str
    business_key: str | None = None
    partitions: int = 3

    @property
    def retry(self) -> str:
        return f"{self.topic}.retry"

    @property
    def dead(self) -> str:
        return f"{self.topic}.dlq"

    @property
    def envelope(self) -> str:
        """The DDL that an event's JSON is parsed with."""
        fields = lambda ddl: f"struct<{ddl_to_struct(ddl)}>"
        return f"metadata {fields(METADATA)}, payload {fields(self.payload)}"


def ddl_to_struct(ddl: str) -> str:
    """`a int, b array<struct<c: int>>` as the inside of a struct type."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += c
    return ", ".join(out)


POS = Dataset("pos_transactions", "pos.transactions", ("pos.transaction.completed",), POS_PAYLOAD, "transaction_id", 6)
INVENTORY = Dataset("inventory_movements", "inventory.events", ("inventory.movement.recorded",), INVENTORY_PAYLOAD, "movement_id", 6)
CUSTOMER = Dataset("customer_events", "customer.events", ("customer.registered", "customer.profile_updated"), CUSTOMER_PAYLOAD)
PRODUCT = Dataset("product_events", "product.updates", ("product.created", "product.updated"), PRODUCT_PAYLOAD)
DATASETS = {d.name: d for d in (POS, INVENTORY, CUSTOMER, PRODUCT)}
#: The test tables that hold each dataset's events.
TABLES = {"pos_transactions": POS, "inventory_events": INVENTORY, "customer_events": CUSTOMER, "product_updates": PRODUCT}
EVENTS, DEAD_LETTERS, AUDIT = "events", "dead_letters", "ingest_audit"
# Headers of dead-lettered records.
HEADERS = {"error_code": "dlq.error.code", "error_message": "dlq.error.message", "error_stage": "dlq.error.stage", "source_topic": "dlq.source.topic", "source_partition": "dlq.source.partition", "source_offset": "dlq.source.offset", "failed_at": "dlq.failed_at", "app": "dlq.app"}
REDRIVE_COUNT, MAX_REDRIVES = "dlq.redrive_count", 3

# Outputs of an ingest batch (fixed names and order): column, how it is made (see operators/outputs.py), from what.
_ENVELOPE = [("event_id", "as", "metadata.event_id"), ("event_type", "as", "metadata.event_type"), ("schema_version", "as", "metadata.schema_version"), ("event_timestamp", "iso", "event_ts"), ("produced_at", "iso", "try_cast(metadata.produced_at as timestamp)"), ("producer", "as", "metadata.producer"), ("correlation_id", "as", "metadata.correlation_id"), ("causation_id", "as", "metadata.causation_id")]
_BATCH = [("spark_query_id", "query", ""), ("spark_batch_id", "batch", "")]
LANDED = [("kafka_topic", "as", "topic"), ("kafka_partition", "as", "partition"), ("kafka_offset", "as", "offset"), ("kafka_timestamp", "iso", "timestamp"), ("kafka_key", "text", "key"), ("schema_id", "as", "schema_id"), *_ENVELOPE, ("event_json", "as", "body"), ("dq_warnings", "json", "dq_warnings"), ("ingested_at", "iso", "current_timestamp()"), *_BATCH]
DEAD_LETTER = [("source_topic", "as", "topic"), ("source_partition", "as", "partition"), ("source_offset", "as", "offset"), ("kafka_timestamp", "iso", "timestamp"), ("kafka_key", "repaired", "key"), ("error_code", "as", "rejection.rule_id"), ("error_stage", "as", "rejection.stage"), ("error_message", "as", "rejection.message"), ("event_id", "as", "metadata.event_id"), ("raw_value_base64", "base64", "value"), ("raw_value_preview", "preview", "value"), ("failed_at", "iso", "current_timestamp()"), *_BATCH]
#: Diagnostics of a dead-lettered record: name in HEADERS, how it is made, from what.
DIAGNOSTICS = [("error_code", "as", "rejection.rule_id"), ("error_message", "as", "rejection.message"), ("error_stage", "as", "rejection.stage"), ("source_topic", "as", "topic"), ("source_partition", "as", "partition"), ("source_offset", "as", "offset"), ("failed_at", "iso", "current_timestamp()"), ("app", "app", "")]
AUDIT_COUNTS = {"records_read": "true", "records_valid": "is_valid", "records_rejected": "not is_valid", "records_warned": "is_valid and size(dq_warnings) > 0"}
PREVIEW_CHARS = 2000
