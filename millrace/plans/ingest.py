"""Ingest, quality and accounting as batch queries over the domain tables, with SQL where it can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.contracts import DATASETS, INVENTORY, POS, TABLES, Dataset
from millrace.operators import alerts, contract, outputs, quality, reconcile, redrive
from millrace.operators.decode import kafka_shaped
from millrace.operators.windows import product_units_1h, store_revenue_5m, watermarked
from millrace.plans.analytics import sql
from millrace.plans.warehouse import Warehouse, business_duplicates, typed_movements, typed_sales
from millrace.session import spread, work_path
from millrace.sources import generator, landing
from millrace.sources.kafka import file_stream
from millrace.streaming.jobs import start_ingest, start_realtime, validated
from millrace.streaming.sinks import IngestWriter, WindowTable, topic_folder

NOW = "2026-04-21 00:00:00"
QUERY_ID, BATCH = "batch", 0


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def judged(w: Warehouse, table: str) -> DataFrame:
    """A table's events, framed and judged as the ingest would (decode, parse, rules)."""
    return validated(kafka_shaped(spread(w.raw(table), "record_id"), TABLES[table]), TABLES[table], now())


def verdicts(w: Warehouse, table: str) -> DataFrame:
    """What accounting needs of a table's judged events, written once: decoding and judging is the dear part."""
    d = TABLES[table]
    key = (F.col(f"payload.{d.business_key}") if d.business_key else F.lit(None).cast("string")).alias("business_key")
    return w.table(f"verdicts_{table}", lambda: judged(w, table).select("topic", "partition", "offset", "event_ts", "is_valid", "dq_warnings", key))


def _rule_query(table: str):
    def query(w: Warehouse) -> DataFrame:
        return judged(w, table).select(F.col("offset").alias("record_id"), F.col("rejection.rule_id").alias("rejected_by"), F.concat_ws(",", "dq_warnings").alias("warnings"))

    return query


SALES = {"pos_transactions": POS}


def _each(w: Warehouse, tables: dict[str, Dataset], f) -> DataFrame:
    """f (judged events, dataset) of some tables, united."""
    return reduce(DataFrame.unionByName, [f(judged(w, t), d) for t, d in tables.items()])


def ing_audit(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    """Audit rows of one batch of sales per partition; ing_audit_all: of all topics."""
    a = _each(w, tables, lambda df, d: outputs.audit(df, d, QUERY_ID, BATCH))
    return a.select("dataset", "kafka_topic", "kafka_partition", "min_offset", "max_offset", "records_read", "records_valid", "records_rejected", "records_warned", "min_event_timestamp", "max_event_timestamp")


def ing_landed(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    return _each(w, tables, lambda df, d: outputs.landed(df, QUERY_ID, BATCH)).select("kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "kafka_key", "schema_id", "event_id", "event_type", "schema_version", "event_timestamp", "producer", "correlation_id", "dq_warnings")


def ing_dead_letters(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    return _each(w, tables, lambda df, d: outputs.dead_letters(df, QUERY_ID, BATCH)).select("source_topic", "source_partition", "source_offset", "error_code", "error_stage", "event_id")


def dlq_inspect(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    dead = _each(w, tables, outputs.dead_records).withColumn("timestamp", now())
    return redrive.inspect(dead).select("error_code", "error_stage", "records")


def dlq_redrive(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    """Outcomes of redriving everything rejected by POS-002."""
    reports = _each(w, tables, lambda df, d: redrive.redrive(outputs.dead_records(df, d), d, "POS-002")[1])
    return reports.groupBy("outcome").agg(F.sum("records").alias("records"))


def str_store_revenue_5m(w: Warehouse) -> DataFrame:
    """The batch form of the real-time windows, from staged events (one per transaction), exact de-duplication."""
    out = store_revenue_5m(watermarked(w.pos_events))
    return out.select("store_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "revenue", "transactions", "units")


def str_product_units_1h(w: Warehouse) -> DataFrame:
    return product_units_1h(watermarked(w.pos_events)).select("product_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "units", "revenue")


def wh_business_duplicates(w: Warehouse) -> DataFrame:
    """Business duplicates of sales and movements, as staging logs them."""
    pos = business_duplicates(typed_sales(w.raw("pos_transactions")), "pos_transactions", "transaction_id")
    moves = business_duplicates(typed_movements(w.raw("inventory_events")), "inventory_movements", "movement_id")
    return pos.unionByName(moves).withColumn("duplicate_event_ts", F.col("duplicate_event_ts").cast("timestamp_ntz"))


def _raw_ids(w: Warehouse) -> dict[str, DataFrame]:
    return {d.name: w.raw(t).select(F.col("metadata.event_id").alias("event_id")).where("event_id is not null") for t, d in TABLES.items()}


def _accounts(w: Warehouse, tables: dict[str, Dataset]) -> DataFrame:
    return reduce(DataFrame.unionByName, [outputs.audit(verdicts(w, t), d, QUERY_ID, BATCH) for t, d in tables.items()])


def _landed(w: Warehouse, table: str) -> DataFrame:
    """Offsets and keys of the landed events of one batch."""
    return verdicts(w, table).where("is_valid").select(F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "business_key")


def dq_results(w: Warehouse) -> DataFrame:
    """SF-001 to SF-008 over the whole warehouse (SF-005 over the audit of one ingest batch of each topic)."""
    audit = _accounts(w, TABLES)
    raw = reduce(DataFrame.unionByName, [_landed(w, t).select(F.lit(d.name).alias("dataset"), F.lit(QUERY_ID).alias("spark_query_id"), F.lit(BATCH).cast("bigint").alias("spark_batch_id"), "kafka_topic", "kafka_partition", "kafka_offset") for t, d in TABLES.items()])
    key = lambda df, c: df.select(c)
    return quality.run_checks([
        quality.sf001(_raw_ids(w)), quality.sf002(business_duplicates(typed_sales(w.raw("pos_transactions")), "pos_transactions", "transaction_id")), quality.sf003(w.fact_sales, w.dim_product, w.dim_customer), quality.sf004(w.fact_sales, w.fact_inventory), quality.sf005(audit, raw),
        quality.sf006(key(typed_sales(w.raw("pos_transactions")), "transaction_id"), key(w.stg_lines, "transaction_id").distinct(), key(typed_movements(w.raw("inventory_events")), "movement_id"), key(w.stg_movements, "movement_id"), w.stg_lines.select("transaction_id", "line_number"), w.fact_sales.select("transaction_id", "line_number")),
        quality.sf007(w.fact_sales, NOW), quality.sf008(w.fact_inventory),
    ]).select("rule_id", "severity", "status", "observed", "threshold", "details")


def rec_report(w: Warehouse, tables: dict[str, Dataset] = SALES) -> DataFrame:
    """Reconciliation of the sales topic: log, audit, landed and staged; rec_report_all: of all topics."""
    log = reduce(DataFrame.unionByName, [w.raw(t).select(F.lit(d.topic).alias("topic"), F.col("kafka_partition").cast("int").alias("partition"), F.col("record_id").alias("offset")) for t, d in tables.items()]).groupBy("topic", "partition").agg(F.min("offset").alias("low"), (F.max("offset") + 1).alias("high"))
    audit = _accounts(w, tables)
    landed = reduce(DataFrame.unionByName, [_landed(w, t) for t in tables])
    staged = [{POS: w.stg_lines, INVENTORY: w.stg_movements}[d].agg(F.count_distinct(d.business_key).alias("staged_keys")).select(F.lit(d.topic).alias("topic"), "staged_keys") for d in tables.values() if d.business_key]
    return reconcile.reconcile(reconcile.gather(log, audit, landed, reduce(DataFrame.unionByName, staged))).select("topic", "in_retention", "not_yet_processed", "spark_read", "spark_valid", "spark_rejected", "raw_offsets", "not_yet_loaded", "duplicates", "balanced", "unexplained", "status")


def rec_gate(w: Warehouse) -> DataFrame:
    """The gate over all topics and rules."""
    return reconcile.gate(rec_report(w, TABLES), dq_results(w))


def wh_freshness(w: Warehouse) -> DataFrame:
    """Latest event time per layer."""
    at = lambda df, layer: df.agg(F.max("event_ts").cast("timestamp_ntz").alias("max_event_ts")).select(F.lit(layer).alias("layer"), "max_event_ts")
    return at(typed_sales(w.raw("pos_transactions")), "raw").unionByName(at(w.stg_lines, "staging")).unionByName(at(w.fact_sales, "facts"))


def alr_fired(w: Warehouse) -> DataFrame:
    """Alerts at NOW over samples derived from the sales: read and rejected rows per partition and minute."""
    minute = F.date_trunc("minute", "timestamp")
    per = judged(w, "pos_transactions").groupBy(F.col("partition").cast("string").alias("labels"), minute.alias("ts")).agg(F.count(F.lit(1)).alias("i"), F.count_if(~F.col("is_valid")).alias("r"))
    upto = Window.partitionBy("labels").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = per.select("labels", "ts", F.sum("i").over(upto).cast("double").alias("i"), F.sum("r").over(upto).cast("double").alias("r"))
    long = total.select(F.lit("input_rows_total").alias("name"), "labels", "ts", F.col("i").alias("value")).unionByName(total.select(F.lit("records_rejected_total").alias("name"), "labels", "ts", F.col("r").alias("value")))
    at = w.raw("pos_transactions").agg(F.max(F.col("kafka_timestamp").cast("timestamp")).cast("string").alias("t")).first().t or NOW
    return alerts.evaluate(long, at)


def gen_dry_run(w: Warehouse) -> DataFrame:
    """2,000 generated sales with faults, judged; nothing is sent."""
    records = generator.with_faults(generator.sales(w.spark, 2_000), {"duplicate": 0.02, "late": 0.02, "unknown_product": 0.02, "invalid_value": 0.02, "missing_field": 0.02, "malformed": 0.02})
    return generator.dry_run(validated(records, POS, now()))


def flt03_contract_all(w: Warehouse) -> DataFrame:
    """Violations of the producers' contract per table and text, of all records of all four tables."""
    return _violations(w, TABLES)


def flt03_contract(w: Warehouse) -> DataFrame:
    """The part of flt03_contract_all that its SQL has: without the sales."""
    return _violations(w, {t: d for t, d in TABLES.items() if d is not POS})


def _violations(w: Warehouse, tables: dict[str, Dataset]) -> DataFrame:
    parts = [contract.violations(w.raw(t), d).select(F.lit(t).alias("source_table"), F.explode("violations").alias("violation")) for t, d in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("source_table", "violation").agg(F.count(F.lit(1)).alias("records"))


def _fed(w: Warehouse) -> str:
    """The sales as a folder of framed records, as a source would find them."""
    path = work_path(w.spark, "feed")
    kafka_shaped(w.raw("pos_transactions"), POS).write.parquet(path)
    return path


def str_stream_windows(w: Warehouse) -> DataFrame:
    """The real-time query itself, run over all records at hand, and its serving table."""
    feed, table = _fed(w), WindowTable(work_path(w.spark, "serving"), ["store_id", "window_start"])
    everything = lambda: file_stream(w.spark, feed, 1 << 20)  # noqa: E731  one batch: nothing is late
    start_realtime(everything, {"store_revenue_5m": table}, work_path(w.spark, "checkpoints"), {"availableNow": True}, NOW)[0].awaitTermination()
    return table.read(w.spark).select("store_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "revenue", "transactions", "units")


def snk_landing_cycle(w: Warehouse) -> DataFrame:
    """Streaming ingest into the landing zone, one load cycle into the raw table, and the raw table."""
    feed, zone, check, raw, kept, dead = _fed(w), *(work_path(w.spark, x) for x in ("landing", "checkpoints", "raw", "archive", "dead"))
    start_ingest(file_stream(w.spark, feed, 4), POS, IngestWriter(POS, zone, check, topic_folder(dead)), check, {"availableNow": True}, NOW).awaitTermination()
    landing.load_landed(w.spark, zone, raw, kept, [POS.name], NOW)
    return landing.raw_table(w.spark, raw, POS.name).select("kafka_partition", "kafka_offset", "event_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_ts"))


def _meta(types: str) -> list[tuple[str, str]]:
    m = "metadata.event_id metadata.event_type metadata.schema_version metadata.event_timestamp metadata.produced_at metadata.producer metadata.correlation_id".split()
    return [("ENV-003", " or ".join(f"{c} is null" for c in m)), ("ENV-004", f"metadata.event_type not in ({types})"), ("ENV-005", "not regexp_full_match(metadata.schema_version, '1[.][0-9]+')"), ("ENV-006", f"try_cast(metadata.event_timestamp as timestamptz) is null or try_cast(metadata.event_timestamp as timestamptz) > timestamptz '{NOW}+00' + interval 5 minute")]


def _null(fields: str) -> str:
    return " or ".join(f"payload.{f} is null" for f in fields.split())


_L = "payload.line_items"
_SQL_RULES: dict[str, tuple[list[tuple[str, str]], list[tuple[str, str]]]] = {
    "pos_transactions": (
        [*_meta("'pos.transaction.completed'"), ("POS-001", _null("transaction_id store_id register_id payment_method currency total_amount")), ("POS-002", f"{_L} is null or len({_L}) = 0 or len(list_filter({_L}, lambda l: l is null or l.line_number is null or l.product_id is null or l.quantity is null or l.unit_price is null or l.discount_amount is null)) > 0"), ("POS-003", f"len(list_filter({_L}, lambda l: l.quantity <= 0)) > 0"), ("POS-004", f"len(list_filter({_L}, lambda l: l.unit_price < 0 or l.discount_amount < 0)) > 0"), ("POS-005", f"len(list_filter({_L}, lambda l: l.discount_amount > l.quantity * l.unit_price)) > 0"),
         ("POS-006", f"abs(payload.total_amount - list_sum(list_transform({_L}, lambda l: cast(l.quantity * l.unit_price - l.discount_amount as decimal(38,6))))) > 0.01"), ("POS-007", f"payload.total_amount <> round(payload.total_amount, 2) or len(list_filter({_L}, lambda l: l.unit_price <> round(l.unit_price, 2) or l.discount_amount <> round(l.discount_amount, 2))) > 0"), ("POS-009", f"len(list_distinct(list_transform({_L}, lambda l: l.line_number))) <> len({_L})")],
        [("POS-008", "payload.payment_method not in ('CASH','CARD','EWALLET')")],
    ),
    "inventory_events": ([*_meta("'inventory.movement.recorded'"), ("INV-001", _null("movement_id store_id product_id movement_type quantity_delta quantity_on_hand_after")), ("INV-002", "payload.quantity_delta = 0 or payload.movement_type not in ('RECEIPT','SALE','ADJUSTMENT') or (payload.movement_type = 'RECEIPT' and payload.quantity_delta < 0) or (payload.movement_type = 'SALE' and payload.quantity_delta > 0)")], [("INV-003", "payload.quantity_on_hand_after < 0")]),
    "customer_events": ([*_meta("'customer.registered','customer.profile_updated'"), ("CUS-001", _null("customer_id loyalty_tier home_store_id signup_date"))], [("CUS-002", "payload.loyalty_tier not in ('BASIC','SILVER','GOLD','PLATINUM')")]),
    "product_updates": ([*_meta("'product.created','product.updated'"), ("PRD-001", _null("product_id product_name brand category subcategory list_price unit_cost unit_of_measure is_active")), ("PRD-002", "payload.list_price < 0 or payload.unit_cost < 0")], []),
}


def _judged_sql(table: str) -> str:
    rejects, warns = _SQL_RULES[table]
    case = " ".join(f"when coalesce({p}, true) then '{r}'" for r, p in rejects)
    listed = " || ".join(f"case when coalesce({p}, false) then '{r}' else '' end" for r, p in warns) or "''"
    return f"(select *, case {case} end as rejected_by, {listed} as warnings from {table})"


_POS = _judged_sql("pos_transactions")
_DUP = "select event_id, {k} as business_key, event_ts, record_id, first_value(event_id) over (partition by {k} order by event_ts, record_id) as kept from {t}"
SQL = {
    **{f"rules_{t}": f"select record_id, rejected_by, warnings from {_judged_sql(t)}" for t in TABLES},
    "ing_audit": f"select 'pos_transactions' as dataset, 'pos.transactions' as kafka_topic, kafka_partition, min(record_id) as min_offset, max(record_id) as max_offset, count(*) as records_read, count(*) filter (where rejected_by is null) as records_valid, count(*) filter (where rejected_by is not null) as records_rejected, count(*) filter (where rejected_by is null and warnings <> '') as records_warned, strftime(min(case when rejected_by is null then try_cast(metadata.event_timestamp as timestamptz) at time zone 'UTC' end), '%Y-%m-%dT%H:%M:%S.%fZ') as min_event_timestamp, strftime(max(case when rejected_by is null then try_cast(metadata.event_timestamp as timestamptz) at time zone 'UTC' end), '%Y-%m-%dT%H:%M:%S.%fZ') as max_event_timestamp from {_POS} group by kafka_partition",
    "ing_landed": f"select 'pos.transactions' as kafka_topic, kafka_partition, record_id as kafka_offset, strftime(kafka_timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') as kafka_timestamp, metadata.event_id as kafka_key, 1 as schema_id, metadata.event_id as event_id, metadata.event_type as event_type, metadata.schema_version as schema_version, strftime(try_cast(metadata.event_timestamp as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') as event_timestamp, metadata.producer as producer, metadata.correlation_id as correlation_id, case when warnings = '' then '[]' else '[\"' || warnings || '\"]' end as dq_warnings from {_POS} where rejected_by is null",
    "ing_dead_letters": f"select 'pos.transactions' as source_topic, kafka_partition as source_partition, record_id as source_offset, rejected_by as error_code, 'validate' as error_stage, metadata.event_id as event_id from {_POS} where rejected_by is not null",
    "dlq_inspect": f"select rejected_by as error_code, 'validate' as error_stage, count(*) as records from {_POS} where rejected_by is not null group by 1",
    "dlq_redrive": f"select case when rejected_by = 'POS-002' then 'redriven' else 'skipped_filter' end as outcome, count(*) as records from {_POS} where rejected_by is not null group by 1",
    "str_store_revenue_5m": sql(", once as (select * from pos_events qualify row_number() over (partition by event_id order by record_id) = 1) select store_id, time_bucket(interval '5 minutes', event_ts) as window_start, cast(sum(coalesce(total_amount, 0)) as decimal(14,2)) as revenue, count(*) as transactions, cast(sum(coalesce(list_sum(list_transform(line_items, lambda l: coalesce(l.quantity, 0))), 0)) as bigint) as units from once group by all"),
    "str_product_units_1h": sql(", once as (select * from pos_events qualify row_number() over (partition by event_id order by record_id) = 1), ls as (select event_ts, unnest(line_items) as l from once) select l.product_id as product_id, time_bucket(interval '1 hour', event_ts) as window_start, cast(sum(l.quantity) as bigint) as units, cast(sum(l.quantity * l.unit_price - coalesce(l.discount_amount, 0)) as decimal(14,2)) as revenue from ls where l.product_id is not null group by all"),
    "wh_business_duplicates": sql(", d as (select 'pos_transactions' as dataset, * from (" + _DUP.format(k="transaction_id", t="typed_sales") + ") union all select 'inventory_movements', * from (" + _DUP.format(k="movement_id", t="typed_moves") + ")) select dataset, business_key, kept as kept_event_id, event_id as duplicate_event_id, event_ts as duplicate_event_ts from d where event_id <> kept qualify row_number() over (partition by dataset, event_id order by record_id) = 1"),
    "dq_results": sql(f""", twice(dataset, n) as (select 'customer_events', count(metadata.event_id) - count(distinct metadata.event_id) from customer_events union all select 'inventory_movements', count(metadata.event_id) - count(distinct metadata.event_id) from inventory_events union all select 'pos_transactions', count(metadata.event_id) - count(distinct metadata.event_id) from pos_transactions union all select 'product_events', count(metadata.event_id) - count(distinct metadata.event_id) from product_updates),
        again as (select business_key from ({_DUP.format(k='transaction_id', t='typed_sales')}) where event_id <> kept qualify row_number() over (partition by event_id order by record_id) = 1),
        valid as ({' union all '.join(f"select '{t}' as t, count(*) as n, count(distinct (kafka_partition, record_id)) as m from {_judged_sql(t)} where rejected_by is null" for t in TABLES)}),
        inferred as (select (select count(*) from fact_sales f join dim_product p on p.product_key = f.product_key where p.is_inferred) as p, (select count(*) from fact_sales f join dim_customer c on c.customer_key = f.customer_key where c.is_inferred) as c, (select count(*) from dim_product where is_inferred) as d),
        unknown as (select (select count(*) from fact_sales where '-1' in (store_key, product_key, customer_key) or date_key = -1) as s, (select count(*) from fact_inventory where '-1' in (store_key, product_key) or date_key = -1) as i),
        lost as (select (select count(distinct transaction_id) from typed_sales where transaction_id not in (select transaction_id from stg_lines)) as a, (select count(distinct movement_id) from typed_moves where movement_id not in (select movement_id from fact_inventory)) as b, (select count(*) from stg_lines l where not exists (select 1 from fact_sales f where f.transaction_id = l.transaction_id and f.line_number = l.line_number)) as c),
        steps as (select quantity_on_hand_after - lag(quantity_on_hand_after) over (partition by store_id, product_id order by event_ts, movement_id) as d, quantity_delta from fact_inventory),
        r(rule_id, severity, observed, threshold, details) as (
        select 'SF-001', 'INFO', sum(n), 0, '{{' || string_agg('"' || dataset || '":' || n, ',' order by dataset) || '}}' from twice
        union all select 'SF-002', 'WARN', (select count(*) from again), 0, '{{"sample_keys":[' || coalesce((select string_agg('"' || business_key || '"', ',' order by business_key) from (select business_key from again order by 1 limit 10)), '') || ']}}'
        union all select 'SF-003', 'WARN', p + c, 0, '{{"sales_inferred_product":' || p || ',"sales_inferred_customer":' || c || ',"inferred_products":' || d || '}}' from inferred
        union all select 'SF-004', 'ERROR', s + i, 0, '{{"fact_sales":' || s || ',"fact_inventory":' || i || '}}' from unknown
        union all select 'SF-005', 'ERROR', count(*) filter (where n <> m), 0, '{{"batches_checked":' || count(*) || ',"records_valid":' || sum(n) || ',"records_loaded":' || sum(m) || '}}' from valid
        union all select 'SF-006', 'ERROR', a + b + c, 0, '{{"pos_transactions_not_staged":' || a || ',"inventory_movements_not_staged":' || b || ',"staged_lines_not_in_fact_sales":' || c || '}}' from lost
        union all select 'SF-007', 'WARN', date_diff('second', max(event_ts), timestamp '{NOW}') // 60, 60, '{{"max_event_ts_utc":"' || strftime(max(event_ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}' from fact_sales
        union all select 'SF-008', 'WARN', count(*) filter (where d <> quantity_delta), 0, '{{"movements_checked":' || count(d) || '}}' from steps)
        select rule_id, severity, case when observed > threshold then 'FAIL' else 'PASS' end as status, cast(observed as decimal(38,4)) as observed, cast(threshold as decimal(38,4)) as threshold, details from r"""),
    "rec_report": sql(f", j as (select * from {_POS}), v as (select * from j where rejected_by is null), p as (select kafka_partition, max(record_id) + 1 - min(record_id) as n from j group by 1) select 'pos.transactions' as topic, (select cast(sum(n) as bigint) from p) as in_retention, 0::bigint as not_yet_processed, (select count(*) from j) as spark_read, (select count(*) from v) as spark_valid, (select count(*) from j where rejected_by is not null) as spark_rejected, (select count(*) from v) as raw_offsets, 0::bigint as not_yet_loaded, (select count(*) - count(distinct payload.transaction_id) from v) as duplicates, true as balanced, 0::bigint as unexplained, 'OK' as status"),
    "wh_freshness": sql("select 'raw' as layer, max(event_ts) as max_event_ts from typed_sales union all select 'staging', max(event_ts) from stg_lines union all select 'facts', max(event_ts) from fact_sales"),
}
SQL |= {
    "str_stream_windows": f"select payload.store_id as store_id, time_bucket(interval '5 minutes', try_cast(metadata.event_timestamp as timestamptz) at time zone 'UTC') as window_start, cast(sum(payload.total_amount) as decimal(14,2)) as revenue, count(*) as transactions, cast(sum(list_sum(list_transform(payload.line_items, lambda l: l.quantity))) as bigint) as units from (select * from {_POS} where rejected_by is null qualify row_number() over (partition by metadata.event_id order by record_id) = 1) group by all",
    "snk_landing_cycle": f"select kafka_partition, record_id as kafka_offset, metadata.event_id as event_id, try_cast(metadata.event_timestamp as timestamptz) at time zone 'UTC' as event_ts from {_POS} where rejected_by is null",
}
SQL["flt03_contract"] = " union all ".join(f"select '{t}' as source_table, v as violation, count(*) as records from (select unnest(list_filter([{', '.join(f"case when {bad} then '{path}: {message}' end" for path, message, bad in contract.constraints(d, 'regexp_matches'))}], lambda x: x is not null)[:{contract.MOST}]) as v from {t}) group by 2" for t, d in TABLES.items() if d is not POS)
_BAD_SALE = ", ".join(
    [f"case when {bad} then '{path}: {message}' end" for path, message, bad in contract.constraints(POS, "regexp_matches")]
    + [f"case when {_L} is null or len({_L}) = 0 then '{_L}: is missing' end"]
    + [f"case when len(list_filter({_L}, lambda l: l is null or l.{c} is null or {bad.replace('regexp_like', 'regexp_matches')})) > 0 then '{_L}.{c}: is missing or wrong' end" for c, bad in contract.LINE]
)
SQL["flt03_contract_all"] = f"{SQL['flt03_contract']} union all select 'pos_transactions' as source_table, v as violation, count(*) as records from (select unnest(list_filter([{_BAD_SALE}], lambda x: x is not null)[:{contract.MOST}]) as v from pos_transactions) group by 2"


def _sql_of(name: str, table: str) -> str:
    """The SQL of one of the sales' queries over another table."""
    d, out = TABLES[table], SQL[name].replace(_POS, _judged_sql(table))
    return out.replace("'pos.transactions'", f"'{d.topic}'").replace("'pos_transactions' as dataset", f"'{d.name}' as dataset")


def _rec_sql(table: str) -> str:
    d = TABLES[table]
    twice = f"(select count(*) - count(distinct payload.{d.business_key}) from v)" if d.business_key else "null::bigint"
    return "select * from (" + _sql_of("rec_report", table).replace("(select count(*) - count(distinct payload.transaction_id) from v)", twice) + ")"


ALL = (ing_audit, ing_landed, ing_dead_letters, dlq_inspect, dlq_redrive, rec_report)
SQL |= {f"{n}_all": " union all ".join(f"select * from ({_sql_of(n, t)})" for t in TABLES) for n in ("ing_audit", "ing_landed", "ing_dead_letters")}
SQL |= {f"{n}_all": f"select {by}, cast(sum(records) as bigint) as records from ({' union all '.join(f'select * from ({_sql_of(n, t)})' for t in TABLES)}) group by all" for n, by in (("dlq_inspect", "error_code, error_stage"), ("dlq_redrive", "outcome"))}
_GATE = "select bool_and(ok) as passed from (select status = 'OK' as ok from ({report}) union all select not (severity = 'ERROR' and status = 'FAIL') from ({quality}))"
SQL["rec_report_all"] = " union all ".join(map(_rec_sql, TABLES))
SQL["rec_gate"] = _GATE.format(report=SQL["rec_report_all"], quality=SQL["dq_results"])
FUNCTIONS = {f.__name__: f for f in (flt03_contract, flt03_contract_all, str_stream_windows, snk_landing_cycle, ing_audit, ing_landed, ing_dead_letters, dlq_inspect, dlq_redrive, str_store_revenue_5m, str_product_units_1h, wh_business_duplicates, dq_results, rec_report, rec_gate, wh_freshness, alr_fired, gen_dry_run)} | {f"rules_{t}": _rule_query(t) for t in TABLES}
FUNCTIONS |= {f"{f.__name__}_all": (lambda w, f=f: f(w, TABLES)) for f in ALL}
QUERIES = {name: (lambda spark, sf_dir, f=f: f(Warehouse(spark, sf_dir))) for name, f in FUNCTIONS.items()}
assert set(DATASETS) == {d.name for d in TABLES.values()}
