import json

from pyspark.sql import functions as F

from millrace.contracts import KAFKA, POS
from millrace.operators.windows import store_revenue_5m, watermarked
from millrace.sources import generator, landing
from millrace.sources.kafka import file_stream
from millrace.streaming.jobs import start_ingest, start_realtime, validated
from millrace.streaming.listener import SampleListener
from millrace.streaming.sinks import IngestWriter, WindowTable, expired, query_id, topic_folder

from .test_ingest import NOW, envelope, framed

ONCE = {"availableNow": True}


def put(spark, path, values, start=0):
    spark.createDataFrame([(b"S1", v, "pos.transactions", 0, start + k, None, 0, []) for k, v in enumerate(values)], KAFKA).coalesce(1).write.mode("append").parquet(path)


def sale(m, n=None, **c):
    return framed(envelope(meta={"event_timestamp": f"2026-09-01T04:{m:02d}:00Z", "event_id": f"e{m}-{n}"}, **c))


def test_ingest_lands_once_and_restarts(spark, tmp_path):
    src, zone, check, dlq = (str(tmp_path / x) for x in ("src", "zone", "check", "dlq"))
    put(spark, src, [sale(m) for m in range(5)] + [sale(6, total_amount=1), b"no frame"])
    listener = SampleListener()
    spark.streams.addListener(listener)
    run = lambda: start_ingest(file_stream(spark, src), POS, IngestWriter(POS, zone, check, topic_folder(dlq)), check, ONCE, NOW).awaitTermination()
    run()
    qid = query_id(spark, check)
    landed = lambda: spark.read.option("recursiveFileLookup", "true").parquet(f"{zone}/pos_transactions")
    audit = spark.read.option("recursiveFileLookup", "true").parquet(f"{zone}/ingest_audit").first()
    assert landed().count() == 5 and (audit.records_read, audit.records_valid, audit.records_rejected) == (7, 5, 2)
    codes = [{h.key: bytes(h.value) for h in r.headers}["dlq.error.code"] for r in spark.read.parquet(dlq).collect()]
    assert sorted(codes) == [b"ENV-001", b"POS-006"]
    put(spark, src, [sale(m) for m in range(10, 14)], start=7)
    run()
    assert landed().count() == 9 and landed().select("kafka_offset").distinct().count() == 9 and query_id(spark, check) == qid
    # A replay of a landed batch is skipped.
    before = sorted(p.name for p in (tmp_path / "zone").rglob("*.parquet"))
    IngestWriter(POS, zone, check, topic_folder(dlq))(validated(spark.read.parquet(src), POS, NOW), 0)
    assert sorted(p.name for p in (tmp_path / "zone").rglob("*.parquet")) == before
    spark.streams.removeListener(listener)

    found = landing.discover(spark, zone, ["pos_transactions", "ingest_audit"])
    assert [(b.dataset, b.batch_id) for b in found] == [("ingest_audit", 0), ("pos_transactions", 0), ("ingest_audit", 1), ("pos_transactions", 1)]
    (tmp_path / "zone/pos_transactions" / f"query_id={qid}" / "batch_id=000000000007").mkdir()  # not committed
    assert landing.backlog(spark, zone, ["pos_transactions"]) == {"pos_transactions": 2}
    raw, kept = str(tmp_path / "raw"), str(tmp_path / "kept")
    assert landing.load_landed(spark, zone, raw, kept, ["pos_transactions"], "2026-09-02 00:00:00", limit=1) == {"pos_transactions": 1}
    assert landing.load_landed(spark, zone, raw, kept, ["pos_transactions"], "2026-09-02 00:15:00") == {"pos_transactions": 1}
    assert landing.load_landed(spark, zone, raw, kept, ["pos_transactions"], "2026-09-02 00:30:00") == {}
    table = landing.raw_table(spark, raw, "pos_transactions")
    assert table.count() == 9 and dict(table.dtypes)["event_timestamp"] == "timestamp" and table.where("_file_name is null").isEmpty()
    assert landing.purge_archive(spark, kept, ["pos_transactions"], 0) == 0 and landing.purge_archive(spark, kept, ["pos_transactions"], 1 << 60) == 2


def test_only_rejects_and_empty_batches(spark, tmp_path):
    zone, check = str(tmp_path / "zone"), tmp_path / "check"
    check.mkdir()
    (check / "metadata").write_text(json.dumps({"id": "ab-1"}))
    sent = []
    write = IngestWriter(POS, zone, str(check), lambda df: sent.append(df.count()))
    bad = validated(spark.createDataFrame([(b"k", b"x", "pos.transactions", 0, 0, None, 0, None)], KAFKA), POS, NOW)
    write(bad, 0)
    write(bad.where("false"), 1)
    assert sent == [1] and [b.batch_id for b in landing.discover(spark, zone, ["pos_transactions"])] == [0]
    assert spark.read.parquet(f"{zone}/pos_transactions/query_id=ab-1/batch_id=000000000000").isEmpty()


def test_realtime_upserts_and_drops_late_rows(spark, tmp_path):
    src, serve, check = (str(tmp_path / x) for x in ("src", "serve", "check"))
    tables = {"store_revenue_5m": WindowTable(f"{serve}/a", ["store_id", "window_start"]), "product_units_1h": WindowTable(f"{serve}/b", ["product_id", "window_start"])}

    def run():
        queries = start_realtime(lambda: file_stream(spark, src), tables, check, ONCE, NOW)
        for q in queries:
            q.awaitTermination()
        return sum(s.numRowsDroppedByWatermark for q in queries for p in q.recentProgress for s in p.stateOperators)

    put(spark, src, [sale(1), sale(12), sale(30), sale(30)])
    run()
    put(spark, src, [sale(5), sale(31)], start=4)
    assert run() >= 1
    got = {r.window_start.minute: (float(r.revenue), r.transactions) for r in tables["store_revenue_5m"].read(spark).collect()}
    assert got == {0: (42.8, 1), 10: (42.8, 1), 30: (85.6, 2)}
    assert {r.product_id: r.units for r in tables["product_units_1h"].read(spark).collect()} == {"SKU-10293": 8, "SKU-20011": 4}


def test_window_table_replay_and_retention(spark, tmp_path):
    t = WindowTable(str(tmp_path / "t"), ["store_id", "window_start"])
    df = lambda v: spark.createDataFrame([("S", "2026-09-01 04:00:00", v)], "store_id string, w string, transactions int").select("store_id", F.col("w").cast("timestamp").alias("window_start"), "transactions")
    t(df(3), 0)
    t(df(7), 1)
    t(df(9), 1)  # a replay
    assert [r.transactions for r in t.read(spark).collect()] == [7]
    keep, gone = expired(t.read(spark), "7 days", "2026-09-09 00:00:00")
    assert keep.isEmpty() and gone.count() == 1


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    generator.with_faults(generator.sales(spark, 300, days=1), {}).drop("fault").coalesce(1).write.parquet(src)
    batch = validated(spark.read.schema(KAFKA).parquet(src), POS, NOW)
    slim = batch.where("is_valid").select(F.col("metadata.event_id").alias("event_id"), "event_ts", "payload.store_id", "payload.line_items", "payload.total_amount")
    want = {(r.store_id, r.window_start): (r.revenue, r.transactions, r.units) for r in store_revenue_5m(watermarked(slim)).collect()}
    table = WindowTable(str(tmp_path / "serve"), ["store_id", "window_start"])
    start_realtime(lambda: file_stream(spark, src), {"store_revenue_5m": table}, str(tmp_path / "check"), ONCE, NOW)[0].awaitTermination()
    assert {(r.store_id, r.window_start): (r.revenue, r.transactions, r.units) for r in table.read(spark).collect()} == want and want


def test_generator_and_faults(spark):
    events = generator.sales(spark, 1000)
    again = generator.sales(spark, 1000, partitions=3)
    assert events.exceptAll(again).isEmpty()
    clean = validated(generator.with_faults(events, {}), POS, NOW)
    assert clean.where("not is_valid").isEmpty() and clean.count() == 1000
    faulty = validated(generator.with_faults(events, {f: 0.1 for f in generator.FAULTS}), POS, NOW)
    by = {(r.fault, r.rule): r["count"] for r in faulty.groupBy("fault", F.col("rejection.rule_id").alias("rule")).count().collect()}
    assert {k for k in by if k[1]} == {("invalid_value", "POS-003"), ("missing_field", "ENV-003"), ("malformed", "ENV-002")}
    assert by["duplicate", None] % 2 == 0 and 50 < by["malformed", "ENV-002"] < 150


def test_reference_csv(spark, tmp_path):
    f = tmp_path / "stores.csv"
    f.write_text('store_id,store_name,city,state,region,store_format,size_sqm,opened_date,timezone,traffic_weight\nA-01,"One, two",,"",North,HYPER,120,2020-01-02,,1.5\n')
    r = landing.read_stores(spark, str(f)).first()
    assert (r.store_name, r.city, r.size_sqm, r.timezone, r.src_file) == ("One, two", None, 120, None, "stores.csv")
    known = landing.changed_files(spark, str(f), None)
    assert known.count() == 1 and landing.changed_files(spark, str(f), known).isEmpty()
