"""The merge family and the record rules over the domain tables as queries, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.contracts import TABLES
from millrace.operators import merge
from millrace.operators.decode import frame, kafka_shaped
from millrace.plans.ingest import _judged_sql, judged, now
from millrace.plans.warehouse import Warehouse, stage_stores
from millrace.streaming.jobs import validated


def snk_merge_insert(w: Warehouse) -> DataFrame:
    """Insert-only merge: event ids of the customer events that those of the product updates' table lack after its own are held."""
    ids = lambda t: w.raw(t).select(F.col("metadata.event_id").alias("event_id"))
    half = w.raw("customer_events").agg(F.avg("record_id").alias("m")).first().m or 0
    rows = w.raw("customer_events").select("record_id", F.col("metadata.event_id").alias("event_id"))
    held = rows.where(F.col("record_id") <= half).select("event_id").unionByName(ids("product_updates"))
    return merge.insert_only(held, rows.where(F.col("record_id") > half).select("event_id"), ["event_id"])


_STORE = ["store_name", "city", "state", "region", "store_format"]


def snk_merge_scd1(w: Warehouse) -> DataFrame:
    """Type-1 merge: the stores that the last load added or changed against what the loads before it gave."""
    loads = w.raw("store_reference")
    last = loads.agg(F.max("loaded_at").alias("t")).first().t
    return merge.changed(stage_stores(loads.where(F.col("loaded_at") < F.lit(last))), stage_stores(loads), ["store_id"], _STORE).select("store_id", *_STORE)


def snk_rebuild(w: Warehouse) -> DataFrame:
    """Delete and insert: all rows of the customers that were ever GOLD are replaced, others stay."""
    rows = w.raw("customer_events").select("record_id", F.col("payload.customer_id").alias("customer_id"), F.col("payload.loyalty_tier").alias("loyalty_tier"))
    affected = rows.where("loyalty_tier = 'GOLD'").where("customer_id is not null")
    return merge.rebuild(rows, rows.withColumn("loyalty_tier", F.lit("rebuilt")), affected, ["customer_id"])


def snk_rekey(w: Warehouse) -> DataFrame:
    """Update from a join: lines under the unknown key get the key of the version valid at their time."""
    facts = w.raw("vw_sales").select("transaction_id", "line_number", "product_id", "event_ts_utc", F.lit(-1).cast("decimal(20,0)").alias("product_key"))
    return merge.rekey(facts, w.raw("dim_product"), "product_id", "event_ts_utc", "product_key").select("transaction_id", "line_number", F.col("product_key").cast("string").alias("product_key"))


def _lines(**fields: str) -> Column:
    """payload with fields of all lines replaced (SQL over the line l)."""
    line = "named_struct(" + ", ".join(f"'{c}', {fields.get(c, 'l.' + c)}" for c in ("line_number", "product_id", "quantity", "unit_price", "discount_amount")) + ")"
    kind = "array<struct<line_number: bigint, product_id: string, quantity: bigint, unit_price: decimal(18,6), discount_amount: decimal(18,6)>>"
    return F.col("payload").withField("line_items", F.expr(f"transform(payload.line_items, l -> {line})").cast(kind))


def _put(column: str, field: str, sql: str, kind: str = "string") -> dict[str, Column]:
    return {column: F.col(column).withField(field, F.expr(sql).cast(kind))}


_MONEY = "decimal(18,6)"
# The rule that must reject a valid record spoilt in the way of mutations() (the position is record_id modulo their number).
EXPECTED: dict[str, list[str | None]] = {
    "pos_transactions": ["ENV-001", "ENV-002", "ENV-003", "ENV-004", "ENV-005", "ENV-006", "POS-001", "POS-002", "POS-003", "POS-004", "POS-005", "POS-006", "POS-007", "POS-009", None],
    "inventory_events": ["INV-001", "INV-002", None],
    "customer_events": ["CUS-001", None],
    "product_updates": ["PRD-001", "PRD-002", "ENV-003"],
}


def mutations() -> dict[str, list[tuple[str | None, dict[str, Column] | str]]]:
    return {
        "pos_transactions": [
            ("ENV-001", "frame"), ("ENV-002", "body"), ("ENV-003", _put("metadata", "producer", "null")), ("ENV-004", _put("metadata", "event_type", "'other'")), ("ENV-005", _put("metadata", "schema_version", "'2.0'")), ("ENV-006", _put("metadata", "event_timestamp", "'n/a'")),
            ("POS-001", _put("payload", "register_id", "null")), ("POS-002", {"payload": F.col("payload").withField("line_items", F.expr("slice(payload.line_items, 1, 0)"))}), ("POS-003", {"payload": _lines(quantity="0")}), ("POS-004", {"payload": _lines(unit_price="-1")}), ("POS-005", {"payload": _lines(discount_amount="l.quantity * l.unit_price + 1")}),
            ("POS-006", _put("payload", "total_amount", "payload.total_amount + 1", _MONEY)), ("POS-007", _put("payload", "total_amount", "payload.total_amount + 0.001", _MONEY)), ("POS-009", {"payload": _lines(line_number="1")}), (None, _put("payload", "payment_method", "'BARTER'")),
        ],
        "inventory_events": [("INV-001", _put("payload", "store_id", "null")), ("INV-002", _put("payload", "quantity_delta", "0", "bigint")), (None, _put("payload", "quantity_on_hand_after", "-1", "bigint"))],
        "customer_events": [("CUS-001", _put("payload", "home_store_id", "null")), (None, _put("payload", "loyalty_tier", "'TIN'"))],
        "product_updates": [("PRD-001", _put("payload", "brand", "null")), ("PRD-002", _put("payload", "list_price", "-1", _MONEY)), ("ENV-003", _put("metadata", "correlation_id", "null"))],
    }


def rules_mutated(w: Warehouse) -> DataFrame:
    """All valid records, each spoilt in one way, judged again: every record rule has to fire."""
    parts = []
    for table, ways in mutations().items():
        d, which = TABLES[table], F.col("record_id") % len(ways)
        rows = judged(w, table).where("is_valid").select(F.col("offset").alias("record_id"), F.col("partition").alias("kafka_partition"), F.col("timestamp").alias("kafka_timestamp"), "metadata", "payload")
        for column in ("metadata", "payload"):
            value = F.col(column)
            for k, (_, change) in enumerate(ways):
                value = F.when(which == k, change[column]).otherwise(value) if isinstance(change, dict) and column in change else value
            rows = rows.withColumn(f"_{column}", value)
        framed = kafka_shaped(rows.select("record_id", "kafka_partition", "kafka_timestamp", F.col("_metadata").alias("metadata"), F.col("_payload").alias("payload")), d)
        how = {change: k for k, (_, change) in enumerate(ways) if isinstance(change, str)}
        at = F.col("offset") % len(ways)
        if how:
            framed = framed.withColumn("value", F.when(at == how["frame"], F.concat(F.unhex(F.lit("01")), F.substring("value", 2, 1 << 30))).when(at == how["body"], frame(F.lit("[1]"))).otherwise(F.col("value")))
        parts.append(validated(framed, d, now()).select(F.lit(table).alias("source_table"), F.col("offset").alias("record_id"), F.col("rejection.rule_id").alias("rejected_by")))
    return reduce(DataFrame.unionByName, parts)


def _expected(table: str) -> str:
    ways = EXPECTED[table]
    cases = " ".join(f"when {k} then {'null' if rule is None else chr(39) + rule + chr(39)}" for k, rule in enumerate(ways))
    rule = f"case record_id % {len(ways)} {cases} end"
    # One line alone repeats no line number.
    rule = f"case when record_id % {len(ways)} = 13 and len(payload.line_items) < 2 then null else {rule} end" if table == "pos_transactions" else rule
    return f"select '{table}' as source_table, record_id, {rule} as rejected_by from {_judged_sql(table)} where rejected_by is null"


_STAGED = "select * from store_reference where store_id is not null {} qualify row_number() over (partition by store_id order by loaded_at desc, src_file desc) = 1"
SQL = {
    "snk_merge_insert": "select distinct event_id from (select record_id, metadata.event_id as event_id from customer_events) s where record_id > (select avg(record_id) from customer_events) and not exists (select 1 from (select metadata.event_id as e from customer_events where record_id <= (select avg(record_id) from customer_events) union all select metadata.event_id from product_updates) t where t.e = s.event_id)",
    "snk_merge_scd1": f"select s.store_id, {', '.join('s.' + c for c in _STORE)} from ({_STAGED.format('')}) s left join ({_STAGED.format('and loaded_at < (select max(loaded_at) from store_reference)')}) t on s.store_id = t.store_id where t.store_id is null or {' or '.join(f's.{c} is distinct from t.{c}' for c in _STORE)}",
    "snk_rebuild": "select record_id, payload.customer_id as customer_id, case when payload.customer_id in (select payload.customer_id from customer_events where payload.loyalty_tier = 'GOLD' and payload.customer_id is not null) then 'rebuilt' else payload.loyalty_tier end as loyalty_tier from customer_events",
    "snk_rekey": "select transaction_id, line_number, cast(coalesce(d.product_key, -1) as varchar) as product_key from vw_sales v left join dim_product d on v.product_id = d.product_id and d.effective_from_utc <= v.event_ts_utc and v.event_ts_utc < d.effective_to_utc",
    "rules_mutated": " union all ".join(map(_expected, EXPECTED)),
}
FUNCTIONS = {f.__name__: f for f in (snk_merge_insert, snk_merge_scd1, snk_rebuild, snk_rekey, rules_mutated)}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(Warehouse(spark, sf_dir))) for name, f in FUNCTIONS.items()}
