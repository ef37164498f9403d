import json
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.contracts import CUSTOMER, INVENTORY, KAFKA, POS, PRODUCT, REDRIVE_COUNT
from millrace.operators import alerts, outputs, quality, reconcile, redrive
from millrace.operators.decode import unframe
from millrace.operators.windows import product_units_1h, store_revenue_5m, watermarked
from millrace.streaming.jobs import validated

NOW = "2026-09-01 12:00:00"
META = {"event_id": "e1", "event_type": "pos.transaction.completed", "schema_version": "1.0", "event_timestamp": "2026-09-01T04:01:00.000Z", "produced_at": "2026-09-01T04:01:01Z", "producer": "till", "correlation_id": "c"}
LINES = [{"line_number": 1, "product_id": "SKU-10293", "quantity": 2, "unit_price": 18.90, "discount_amount": 0.00}, {"line_number": 2, "product_id": "SKU-20011", "quantity": 1, "unit_price": 5.50, "discount_amount": 0.50}]
SALE = {"transaction_id": "T1", "store_id": "S1", "register_id": "R", "customer_id": None, "payment_method": "CARD", "currency": "MYR", "line_items": LINES, "total_amount": 42.80}
MOVE = {"movement_id": "M1", "store_id": "S1", "product_id": "P", "movement_type": "SALE", "quantity_delta": -2, "quantity_on_hand_after": 46}
CUST = {"customer_id": "C", "loyalty_tier": "GOLD", "home_store_id": "S1", "signup_date": "2024-01-01", "birth_year": 1988}
PROD = {"product_id": "P", "product_name": "n", "brand": "b", "category": "c", "subcategory": "s", "list_price": 18.9, "unit_cost": 12.4, "unit_of_measure": "EACH", "is_active": True}


def envelope(payload=SALE, meta=None, **changes):
    return json.dumps({"metadata": META | (meta or {}), "payload": payload | changes}).encode()


def framed(body, schema_id=1):
    return b"\0" + schema_id.to_bytes(4, "big") + body


def line(**changes):
    return [LINES[0] | changes, LINES[1]]


def kafka(spark, values, topic="pos.transactions", headers=()):
    return spark.createDataFrame([(b"S1", v, topic, 0, k, None, 0, list(headers)) for k, v in enumerate(values)], KAFKA)


def verdicts(spark, values, dataset=POS):
    got = validated(kafka(spark, values), dataset, NOW).orderBy("offset").collect()
    return [(r.rejection.rule_id if r.rejection else None, r.dq_warnings) for r in got]


def test_rules_of_sales(spark):
    drop = lambda d, k: {x: y for x, y in d.items() if x != k}
    cases = [
        (framed(envelope()), None), (b"no frame", "ENV-001"), (None, "ENV-001"), (b"\0\0\0\0\1", "ENV-001"), (framed(envelope()[:40]), "ENV-002"), (framed(b"\xff\xfe"), "ENV-002"), (framed(b"\xff\xfe", 128), "ENV-002"), (framed(b'{"metadata": [], "payload": {}}'), "ENV-002"), (framed(b"[" + envelope() + b"]"), "ENV-002"), (framed(json.dumps({"metadata": [META], "payload": SALE}).encode()), "ENV-002"), (framed(json.dumps({"metadata": META, "payload": json.dumps(SALE)}).encode()), "ENV-002"), (framed(b"\n " + envelope()), None), (framed(envelope() + b" garbage"), None), (framed(b"null"), "ENV-002"), (framed(b'{"metadata": "{", "payload": {}}'), "ENV-002"),
        (framed(json.dumps({"metadata": drop(META, "event_id"), "payload": SALE}).encode(), 200), "ENV-003"), (framed(envelope(meta={"event_type": "product.updated"})), "ENV-004"), (framed(envelope(meta={"schema_version": "2.0"})), "ENV-005"), (framed(envelope(meta={"schema_version": "1.1"}, extra="x")), None),
        (framed(envelope(meta={"event_timestamp": "2026-09-01T14:00:00Z"})), "ENV-006"), (framed(envelope(meta={"event_timestamp": "soon"})), "ENV-006"), (framed(envelope(meta={"event_timestamp": "2025-01-01T00:00:00Z"})), None), (framed(envelope(meta={"event_timestamp": "2026-09-01T12:05:00Z"})), None),
        (framed(envelope(store_id=None)), "POS-001"), (framed(envelope(line_items=[])), "POS-002"), (framed(envelope(line_items=[None])), "POS-002"), (framed(envelope(line_items=line(quantity="two"))), "POS-002"), (framed(envelope(line_items=line(quantity=2.0))), "POS-002"), (framed(envelope(line_items=line(quantity=-1))), "POS-003"),
        (framed(envelope(line_items=line(unit_price=-1))), "POS-004"), (framed(envelope(line_items=line(discount_amount=99))), "POS-005"), (framed(envelope(total_amount=42.82)), "POS-006"), (framed(envelope(total_amount=42.81)), None), (framed(envelope(line_items=line(unit_price=18.905), total_amount=42.81)), "POS-007"),
        (framed(envelope(line_items=line(line_number=2))), "POS-009"),
    ]
    assert [v for v, _ in verdicts(spark, [c[0] for c in cases])] == [c[1] for c in cases]
    assert verdicts(spark, [framed(envelope(payment_method="CRYPTO"))]) == [(None, ["POS-008"])]


def test_rules_of_other_datasets(spark):
    e = lambda kind, payload, **c: framed(envelope(payload, {"event_type": kind}, **c))
    inv, cus, prd = "inventory.movement.recorded", "customer.registered", "product.updated"
    assert verdicts(spark, [e(inv, MOVE), e(inv, MOVE, quantity_on_hand_after=-3), e(inv, MOVE, movement_id=None), e(inv, MOVE, quantity_delta=0), e(inv, MOVE, quantity_delta=2), e(inv, MOVE, movement_type="RECEIPT"), e(inv, MOVE, movement_type="GIFT"), e(inv, MOVE, movement_type="ADJUSTMENT")], INVENTORY) == [(None, []), (None, ["INV-003"]), ("INV-001", []), *[("INV-002", [])] * 4, (None, [])]
    assert verdicts(spark, [e(cus, CUST), e(cus, CUST, loyalty_tier="WOOD"), e(cus, CUST, signup_date=None)], CUSTOMER) == [(None, []), (None, ["CUS-002"]), ("CUS-001", [])]
    assert verdicts(spark, [e(prd, PROD), e(prd, PROD, brand=None), e(prd, PROD, unit_cost=-1)], PRODUCT) == [(None, []), ("PRD-001", []), ("PRD-002", [])]


def test_frame(spark):
    got = unframe(kafka(spark, [framed(b"{}", 7), framed(b"{}", 1 << 31), framed(b""), b"\1\0\0\0\1{}"])).orderBy("offset").collect()
    assert [(r.wire_ok, r.schema_id, r.body) for r in got] == [(True, 7, "{}"), (True, None, "{}"), (False, None, None), (False, None, None)]


def test_outputs(spark):
    judged = validated(kafka(spark, [framed(envelope()), b"\xff\xfegarbage", framed(envelope(payment_method="CRYPTO"))], headers=[("dlq.app", b"old"), (REDRIVE_COUNT, b"2"), ("trace", b"t")]), POS, NOW)
    landed = outputs.landed(judged, "q", 3).collect()
    assert len(landed) == 2 and len(landed[0]) == 19 and landed[0].event_timestamp == "2026-09-01T04:01:00.000000Z" and json.loads(landed[0].event_json)["payload"]["transaction_id"] == "T1"
    assert sorted(r.dq_warnings for r in landed) == ['["POS-008"]', "[]"]
    a = outputs.audit(judged, POS, "q", 3).first()
    assert (a.records_read, a.records_valid, a.records_rejected, a.records_warned, a.min_offset, a.max_offset) == (3, 2, 1, 1, 0, 2)
    letter = outputs.dead_letters(judged, "q", 3).first()
    assert letter.error_code == "ENV-001" and letter.raw_value_preview.endswith("garbage") and letter.raw_value_base64
    dead = outputs.dead_records(judged, POS).first()
    headers = [(h.key, bytes(h.value)) for h in dead.headers]
    assert bytes(dead.value) == b"\xff\xfegarbage" and (REDRIVE_COUNT, b"2") in headers and ("trace", b"t") in headers and ("dlq.app", b"old") not in headers and ("dlq.error.code", b"ENV-001") in headers


def test_redrive(spark):
    head = lambda n: [("dlq.error.code", b"POS-006"), ("dlq.error.stage", b"validate"), ("trace", b"t"), *([(REDRIVE_COUNT, n)] if n else [])]
    dead = spark.createDataFrame([(b"k", b"\xff\0one", None, head(None)), (b"k", b"two", None, head(b"3")), (b"k", b"three", None, [("dlq.error.code", b"ENV-001")])], "key binary, value binary, timestamp timestamp, headers array<struct<key: string, value: binary>>")
    records, report = redrive.redrive(dead, POS, "POS-006")
    assert {r.outcome: r.records for r in report.collect()} == {"redriven": 1, "loop_guarded": 1, "skipped_filter": 1}
    one = records.first()
    assert one.topic == "pos.transactions.retry" and bytes(one.value) == b"\xff\0one" and {h.key: bytes(h.value) for h in one.headers} == {"trace": b"t", REDRIVE_COUNT: b"1"}
    assert {bytes(r.value) for r in redrive.redrive(dead, POS, "POS-006", force=True)[0].collect()} == {b"\xff\0one", b"two"}
    assert [tuple(r)[:3] for r in redrive.inspect(dead).collect()] == [("POS-006", "validate", 2), ("ENV-001", "unknown", 1)]


def test_windows(spark):
    at = lambda m: {"event_timestamp": f"2026-09-01T04:{m:02d}:00Z", "event_id": f"e{m}"}
    judged = validated(kafka(spark, [framed(envelope(meta=at(m))) for m in (1, 4, 6, 6)]), POS, NOW)
    sales = watermarked(judged.select(F.col("metadata.event_id").alias("event_id"), "event_ts", "payload.store_id", "payload.line_items", "payload.total_amount"))
    assert [(r.window_start.minute, r.revenue, r.transactions, r.units) for r in store_revenue_5m(sales).orderBy("window_start").collect()] == [(0, Decimal("85.60"), 2, 6), (5, Decimal("42.80"), 1, 3)]
    assert {r.product_id: r.units for r in product_units_1h(sales).collect()} == {"SKU-10293": 6, "SKU-20011": 3}


def test_reconcile(spark):
    def report(p0_max=99, p1=True, read=150, valid=145, rejected=5, raw=145, keys=140):
        log = spark.createDataFrame([("t", 0, 0, 100), ("t", 1, 0, 50)], "topic string, partition int, low bigint, high bigint")
        audit = [("d", "q", 1, "t", 0, p0_max, read - 50, valid - 50, rejected, "1"), ("d", "q", 1, "t", 0, p0_max, 7, 7, 7, "0")] + ([("d", "q", 1, "t", 1, 49, 50, 50, 0, "1")] if p1 else [])
        a = spark.createDataFrame(audit, "dataset string, spark_query_id string, spark_batch_id int, kafka_topic string, kafka_partition int, max_offset bigint, records_read bigint, records_valid bigint, records_rejected bigint, processed_at string")
        r = spark.range(raw).selectExpr("'t' as kafka_topic", "0 as kafka_partition", "id as kafka_offset", f"cast(least(id, {keys - 1}) as string) as business_key")
        retry = spark.range(9).selectExpr("'t.retry' as kafka_topic", "0 as kafka_partition", "id as kafka_offset", "concat('r', id) as business_key")
        s = spark.createDataFrame([("t", 140)], "topic string, staged_keys bigint")
        return reconcile.reconcile(reconcile.gather(log, a, r.unionByName(retry), s)).first()

    base = report()
    assert (base.status, base.in_retention, base.duplicates, base.not_yet_processed, base.keys_not_staged) == ("OK", 150, 5, 0, 0)
    assert (report(p0_max=79).not_yet_processed, report(p0_max=79).status) == (20, "OK")
    assert (report(raw=120, keys=115).not_yet_loaded, report(raw=120, keys=115).status) == (25, "OK")
    assert (report(raw=150).unexplained, report(raw=150).status) == (5, "INVESTIGATE")
    assert report(read=151).status == "INVESTIGATE"
    assert report(p1=False, read=150).not_yet_processed == 50
    bad = spark.createDataFrame([("ERROR", "FAIL")], "severity string, status string")
    topics = spark.createDataFrame([("OK",)], "status string")
    assert not reconcile.gate(topics, bad).first().passed and reconcile.gate(topics, bad.where("false")).first().passed


def test_quality_rules(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    one = quality.sf001({"x": ids, "y": ids.distinct()}).first()
    assert (one.status, int(one.observed), json.loads(one.details)) == ("FAIL", 1, {"x": 1, "y": 0})
    dup = spark.createDataFrame([(f"k{i:02d}",) for i in range(15)], "business_key string")
    assert len(json.loads(quality.sf002(dup).first().details)["sample_keys"]) == 10 and quality.sf002(dup.where("false")).first().status == "PASS"
    sales = spark.createDataFrame([("2026-09-01 10:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("event_ts"))
    assert [quality.sf007(s, n).first().status for s, n in ((sales, "2026-09-01 11:00:59"), (sales, "2026-09-01 11:01:00"), (sales.where("false"), "2026-09-01 11:00:00"))] == ["PASS", "FAIL", "FAIL"]
    stock = spark.createDataFrame([("s", "p", 1, "a", 5, 5), ("s", "p", 2, "b", -2, 3), ("s", "p", 3, "c", -2, 2), ("s", "q", 1, "d", 9, 9)], "store_id string, product_id string, event_ts int, movement_id string, quantity_delta int, quantity_on_hand_after int")
    got = quality.sf008(stock).first()
    assert (got.status, int(got.observed), json.loads(got.details)) == ("FAIL", 1, {"movements_checked": 2})
    results = quality.run_checks([quality.sf008(stock), quality.sf007(sales, "2026-09-02 00:00:00")])
    assert quality.errors(results).first().errors == 0


def test_alerts(spark):
    def fired(samples, now="2026-09-01 10:30:00"):
        df = spark.createDataFrame([(n, "q", f"2026-09-01 10:{m:02d}:00", float(v)) for n, m, v in samples], "name string, labels string, t string, value double").select("name", "labels", F.col("t").cast("timestamp").alias("ts"), "value")
        return {r.alert_id for r in alerts.evaluate(df, now).collect()}

    assert fired([("producer_failed_total", 20, 5), ("producer_failed_total", 28, 6)]) == {"ALR-01"}
    assert fired([("producer_failed_total", 20, 5), ("producer_failed_total", 28, 5)]) == set()
    assert fired([("producer_failed_total", 20, 5), ("producer_failed_total", 28, 1)]) == {"ALR-01"}  # a restart
    lag = [("offsets_behind_max", m, 30_000) for m in (23, 26, 29)]
    assert fired(lag) == {"ALR-05"} and fired(lag[1:]) == set() and fired([*lag, ("offsets_behind_max", 30, 5)]) == set()
    assert fired([("records_rejected_total", 25, 0), ("records_rejected_total", 29, 6), ("input_rows_total", 25, 0), ("input_rows_total", 29, 100)]) == {"ALR-06"}
    assert fired([("component_up", m, 0) for m in (20, 28, 30)]) == {"ALR-11"}
    assert fired([("loader_up", m, m % 2) for m in (10, 11, 12, 13, 14)]) == {"ALR-10"}
    assert fired([("dlq_offset_total", 20, 0), ("dlq_offset_total", 29, 200)]) == {"ALR-12"}


def test_all_topics_are_reconciled(spark, data, monkeypatch):
    """A topic other than the sales whose accounts don't agree is reported and closes the gate."""
    from millrace.contracts import DATASETS
    from millrace.plans import ingest
    from millrace.plans.warehouse import Warehouse

    w = Warehouse(spark, data)
    audit, gate, clean = outputs.audit, reconcile.gate, []
    monkeypatch.setattr(reconcile, "gate", lambda report, quality: gate(report, quality.where("rule_id = 'SF-005'")))
    for lost in (None, *DATASETS):
        if lost not in (None, "pos_transactions"):
            # One valid record less than landed, in each partition.
            monkeypatch.setattr(outputs, "audit", lambda df, d, *a, lost=lost: audit(df, d, *a).withColumn("records_valid", F.col("records_valid") - (1 if d.name == lost else 0)))
        elif lost:
            continue
        status = {r.topic: r.status for r in ingest.QUERIES["rec_report_all"](spark, data).collect()}
        assert status == {d.topic: "INVESTIGATE" if n == lost else "OK" for n, d in DATASETS.items()}
        assert {r.rule_id: r.status for r in ingest.dq_results(w).where("rule_id = 'SF-005'").collect()} == {"SF-005": "FAIL" if lost else "PASS"}
        clean.append(ingest.rec_gate(w).first().passed)
    assert clean == [True, False, False, False]
