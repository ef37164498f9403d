"""Producer-side contract checks: patterns, ranges and lists of values, field by field.

A violation reads "path: what is wrong"; a record's first MOST are kept, in table order. Null means missing: it violates
unless the field may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.contracts import Dataset

MOST = 5
# Patterns (fixed values).
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
WIRE_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?Z$"
STORE, PRODUCT, CUSTOMER, CURRENCY = "^[A-Z]{2,6}-[0-9]{2}$", "^SKU-[0-9]{5}$", "^CUST-[0-9]{7}$", "^[A-Z]{3}$"
# (path, may be null, kind, argument); kinds: like (pattern), range (least, most), oneof (values), length (least, most).
METADATA = [
    ("metadata.event_id", False, "like", UUID), ("metadata.event_type", False, "like", "^[a-z]+([.][a-z_]+)+$"), ("metadata.schema_version", False, "like", "^1[.][0-9]+$"), ("metadata.event_timestamp", False, "like", WIRE_TIME), ("metadata.produced_at", False, "like", WIRE_TIME), ("metadata.producer", False, "like", "^[a-z0-9-]{1,50}/[0-9]+[.][0-9]+[.][0-9]+$"),
    ("metadata.correlation_id", False, "like", UUID), ("metadata.causation_id", True, "like", UUID),
]
PAYLOAD = {
    "pos_transactions": [("payload.transaction_id", False, "like", "^TXN-[A-Z0-9-]{4,40}$"), ("payload.store_id", False, "like", STORE), ("payload.register_id", False, "like", "^REG-[0-9]{2}$"), ("payload.customer_id", True, "like", CUSTOMER), ("payload.payment_method", False, "oneof", ("CASH", "CARD", "EWALLET")), ("payload.currency", False, "like", CURRENCY), ("payload.total_amount", False, "range", (0, None))],
    "inventory_movements": [("payload.movement_id", False, "like", "^MOV-[A-Z0-9-]{4,40}$"), ("payload.store_id", False, "like", STORE), ("payload.product_id", False, "like", PRODUCT), ("payload.movement_type", False, "oneof", ("RECEIPT", "SALE", "ADJUSTMENT")), ("payload.quantity_delta", False, "range", (-100_000, 100_000)), ("payload.quantity_on_hand_after", False, "range", (-100_000, 1_000_000)), ("payload.reason_code", True, "oneof", ("REPLENISHMENT", "POS_SALE", "DAMAGED", "EXPIRED", "SHRINKAGE", "STOCK_COUNT_CORRECTION")), ("payload.reference_id", True, "like", "^(PO|TXN)-[A-Z0-9-]{4,40}$"), ("payload.unit_cost", True, "range", (0, 100_000))],
    "customer_events": [("payload.customer_id", False, "like", CUSTOMER), ("payload.loyalty_tier", False, "oneof", ("BASIC", "SILVER", "GOLD", "PLATINUM")), ("payload.home_store_id", False, "like", STORE), ("payload.city", False, "length", (1, 100)), ("payload.state", False, "length", (1, 100)), ("payload.signup_date", False, "like", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("payload.birth_year", True, "range", (1900, 2015)), ("payload.email_sha256", True, "like", "^[0-9a-f]{64}$"), ("payload.marketing_opt_in", False, "oneof", None)],
    "product_events": [("payload.product_id", False, "like", PRODUCT), ("payload.product_name", False, "length", (1, 200)), *[(f"payload.{c}", False, "length", (1, 100)) for c in ("brand", "category", "subcategory")], ("payload.list_price", False, "range", (0, 100_000)), ("payload.unit_cost", False, "range", (0, 100_000)), ("payload.currency", False, "like", CURRENCY), ("payload.unit_of_measure", False, "oneof", ("EACH", "KG", "LITRE", "PACK")), ("payload.is_active", False, "oneof", None)],
}
LINE = [("line_number", "l.line_number < 1"), ("product_id", f"not regexp_like(l.product_id, '{PRODUCT}')"), ("quantity", "l.quantity < 1 or l.quantity > 999"), ("unit_price", "l.unit_price < 0 or l.unit_price > 100000"), ("discount_amount", "l.discount_amount < 0 or l.discount_amount > 100000")]
MESSAGES = {"like": "does not match its pattern", "range": "is out of range", "oneof": "is none of its values", "length": "has the wrong length"}


def constraints(dataset: Dataset, like: str = "regexp_like") -> list[tuple[str, str, str]]:
    """(path, message, SQL predicate that holds where violated), for scalar fields; like: the SQL function for patterns."""
    out = []
    for path, nullable, kind, arg in METADATA + PAYLOAD[dataset.name]:
        if not nullable:
            out.append((path, "is missing", f"{path} is null"))
        if kind == "like":
            bad = f"not {like}({path}, '{arg}')"
        elif kind == "oneof":
            bad = f"{path} not in ({', '.join(repr(v) for v in arg)})" if arg else None
        else:
            size = f"length({path})" if kind == "length" else path
            bad = " or ".join([f"{size} < {arg[0]}"] + ([f"{size} > {arg[1]}"] if arg[1] is not None else []))
        if bad:
            out.append((path, MESSAGES[kind], bad))
    return out


def violations(df: DataFrame, dataset: Dataset) -> DataFrame:
    """df (metadata, payload) with `violations`, the first MOST as texts; [] for a record that keeps the contract."""
    found = [F.when(F.expr(f"({bad})"), F.lit(f"{path}: {message}")) for path, message, bad in constraints(dataset)]
    if dataset.name == "pos_transactions":
        found.append(F.when(F.expr("payload.line_items is null or size(payload.line_items) = 0"), F.lit("payload.line_items: is missing")))
        found += [F.when(F.expr(f"exists(payload.line_items, l -> l is null or l.{c} is null or {bad})"), F.lit(f"payload.line_items.{c}: is missing or wrong")) for c, bad in LINE]
    return df.withColumn("violations", F.slice(F.array_compact(F.array(*found)), 1, MOST))
