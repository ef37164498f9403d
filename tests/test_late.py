import datetime

from pyspark.sql import functions as F

from millrace.operators import late

from .conftest import rows

SCHEMA = "record_id bigint, metadata struct<event_timestamp: string, produced_at: string>, payload struct<store_id: string, total_amount: decimal(18,6)>, spark_batch_id bigint, note string"


def sale(i, event, produced, store="S", amount=1, batch=0):
    return (i, (event, produced), (store, amount if amount is None else __import__("decimal").Decimal(amount)), batch, "x")


def test_what_counts(spark):
    data = [
        sale(1, "2026-03-02T10:04:59.999Z", "2026-03-02T16:04:59.999Z"),  # exactly the limit
        sale(2, "2026-03-02T10:04:59.999Z", "2026-03-02T16:05:00.000Z"),  # too late
        sale(3, "2026-03-02T18:05:00+08:00", "2026-03-02T10:05:00Z"),
        sale(4, "n/a", "2026-03-02T10:05:00Z"),
        sale(5, None, None),
        sale(6, "2026-03-02T10:05:00", "2026-03-02T10:05:00Z"),  # no zone
        sale(7, "2026-02-30T10:05:00Z", "2026-03-02T10:05:00Z"),  # no such day
        sale(8, "2026-03-02T10:06:00Z", "2026-03-02T09:00:00Z", amount=None),  # produced earlier, no amount
        sale(9, "2026-03-02T10:06:00Z", "2026-03-02T10:06:00Z", store=None),
    ]
    got = late.timed_sales(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.record_id for r in got.collect()) == [1, 3, 8]
    t = int(datetime.datetime(2026, 3, 2, 10, 0, tzinfo=datetime.timezone.utc).timestamp())
    assert {r.record_id: r.window_start_s - t for r in got.collect()} == {1: 0, 3: 300, 8: 300}


def day(d, m):
    return f"2026-03-{d:02d}T10:{m:02d}:00Z"


def test_increments_do_not_change_the_result_and_touch_only_their_periods(spark, tmp_path):
    data = [sale(i, day(2 + i % 5, i % 60), day(2 + i % 5, i % 60), f"S{i % 3}", i, batch=i // 10) for i in range(60)]
    records = late.timed_sales(spark.createDataFrame(data, SCHEMA))
    whole = rows(late.replay(records, 1, str(tmp_path / "a")).current())
    parts = late.replay(records, 4, str(tmp_path / "b"))
    assert rows(parts.current()) == whole and parts.parts.applied == 2
    again = late.CorrectedWindows(spark, str(tmp_path / "b"))
    one = late.timed_sales(spark.createDataFrame([sale(99, day(3, 0), day(3, 1), batch=99)], SCHEMA)).cache()
    assert again.arrive(7, one) == [20515] and len(rows(again.current())) == len(whole) + 1
    assert again.arrive(7, one) == [] and len(rows(late.CorrectedWindows(spark, str(tmp_path / "b")).current())) == len(whole) + 1


def files_of(df):
    return sorted(f.split("/period=")[1].split("/")[0] for f in df.inputFiles())


def test_a_batch_reads_and_writes_only_what_it_touches(spark, tmp_path):
    w = late.CorrectedWindows(spark, str(tmp_path / "w"))
    batches = [[(1, 2), (2, 3)], [(3, 3), (4, 4)], [(5, 2)]]
    for number, batch in enumerate(batches):
        touched = w.arrive(number, late.timed_sales(spark.createDataFrame([sale(i, day(d, i), day(d, i)) for i, d in batch], SCHEMA)).cache())
        assert touched == sorted(20512 + d for _, d in batch)
        assert set(files_of(w.retained(touched))) == {str(p) for p in touched}
        assert sorted(p.name for p in (tmp_path / "w" / f"v={number}").iterdir() if p.name.startswith("period")) == [f"period={p}" for p in touched]
    assert w.parts.versions == {20514: 2, 20515: 1, 20516: 1}
    # Superseded versions go, but for those of the former manifest.
    assert not (tmp_path / "w" / "v=0" / "period=20515").exists() and (tmp_path / "w" / "v=0" / "period=20514").exists()
    assert rows(w.current().groupBy().sum("transactions")) == [(5,)]


def test_a_dead_batch_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    w = late.CorrectedWindows(spark, str(tmp_path / "w"))
    one, two = (late.timed_sales(spark.createDataFrame([sale(i, day(2, i), day(2, i))], SCHEMA)).cache() for i in (1, 2))
    w.arrive(0, one)
    before = rows(w.current())
    monkeypatch.setattr(late.Parts, "publish", lambda *a: (_ for _ in ()).throw(OSError("died")))
    try:
        w.arrive(1, two)
    except OSError:
        pass
    monkeypatch.undo()
    w = late.CorrectedWindows(spark, str(tmp_path / "w"))
    assert rows(w.current()) == before
    w.arrive(1, two)
    assert w.current().groupBy().sum("transactions").first()[0] == 2


def test_closed_periods_are_kept_and_what_comes_later_is_set_aside(spark, tmp_path):
    w = late.CorrectedWindows(spark, str(tmp_path / "w"), keep_s=86_400)
    w.arrive(0, late.timed_sales(spark.createDataFrame([sale(1, day(2, 1), day(2, 1)), sale(2, day(5, 1), day(5, 1))], SCHEMA)).cache())
    assert w.closed(20514) and not (tmp_path / "w" / "raw" / "period=20514").exists()
    assert w.arrive(1, late.timed_sales(spark.createDataFrame([sale(3, day(2, 1), day(2, 1)), sale(4, day(4, 1), day(4, 1))], SCHEMA)).cache()) == [20516]
    assert [r.record_id for r in w.set_aside().collect()] == [3]
    assert rows(w.current().groupBy().sum("transactions")) == [(3,)]


def test_empty_and_differences(spark):
    none = late.timed_sales(spark.createDataFrame([], SCHEMA))
    assert late.replay(none, 3).current().isEmpty()
    t = datetime.datetime(2026, 3, 2, 10, 0)
    made = spark.createDataFrame([("A", 1772445600, 10, 2), ("B", 1772445600, 0, 0), ("D", 1772445600, 5, 1)], "store_id string, window_start_s bigint, r int, transactions bigint").withColumn("revenue", F.col("r").cast("decimal(38,6)"))
    published = spark.createDataFrame([("A", t, 10, 2), ("C", t, 0, 1), ("D", t, 5, None)], "store_id string, window_start timestamp, r int, transactions bigint").withColumn("revenue", F.col("r").cast("decimal(14,2)"))
    assert [r.store_id for r in late.differences(made, published).orderBy("store_id").collect()] == ["C", "D"]
