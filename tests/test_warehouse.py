import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.functions.clock import rfc3339
from millrace.functions.keys import md5_lower64, scd2_key
from millrace.operators import merge
from millrace.plans import warehouse

from .conftest import rows


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("SKU-1", datetime.datetime(2026, 3, 2, 1, 2, 3, 4))], "id string, t timestamp")
    low = lambda s: int(hashlib.md5(s.encode()).hexdigest()[16:], 16)
    r = df.select(md5_lower64(F.col("id")).alias("a"), scd2_key(F.col("id"), F.col("t")).alias("b")).first()
    assert int(r.a) == low("SKU-1") and int(r.b) == low("SKU-1|2026-03-02 01:02:03.000004000")


def test_rfc3339(spark):
    cases = {"2026-03-02T10:00:00Z": 10, "2026-03-02t10:00:00.123456789z": 10, "2026-03-02T10:00:00+08:00": 2, "2026-03-02T10:00:00-00:30": 10, "2026-03-02 10:00:00Z": None, "2026-03-02T10:00:00": None, "2026-02-29T10:00:00Z": None, "2026-03-02T25:00:00Z": None, "0000-00-00T00:00:00Z": None, "": None, "n/a": None, " 2026-03-02T10:00:00Z": None}
    got = {r.t: r.h for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.hour(rfc3339(F.col("t"))).alias("h")).collect()}
    assert got == cases


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "b"), (3, None), (3, None)], "k int, v string")
    assert rows(merge.insert_only(t, s, ["k"])) == [(3, None)]
    assert rows(merge.upsert(t, spark.createDataFrame([(2, "x")], "k int, v string"), ["k"])) == [(1, "a"), (2, "x")]
    assert rows(merge.changed(t, s, ["k"], ["v"])) == [(3, None)]
    fresh = spark.createDataFrame([(2, "p"), (2, "q"), (1, "no")], "k int, v string")
    assert rows(merge.rebuild(t, fresh, spark.createDataFrame([(2,)], "k int"), ["k"])) == [(1, "a"), (2, "p"), (2, "q")]
    facts = spark.createDataFrame([("x", 5, 0), ("x", 15, 0), ("y", 5, 7)], "id string, at int, sk int")
    dim = spark.createDataFrame([("x", 0, 10, 1), ("x", 10, 20, 2)], "id string, low int, high int, sk int")
    assert rows(merge.rekey(facts, dim, "id", "at", "sk", "low", "high")) == [("x", 15, 2), ("x", 5, 1), ("y", 5, 7)]


def product(spark, data):
    return spark.createDataFrame(data, "event_id string, product_id string, event_ts string, brand string, product_name string").select("event_id", "product_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "brand", "product_name", F.lit("c").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit(Decimal("1.00")).cast("decimal(12,2)").alias("list_price"), F.lit(None).cast("decimal(12,2)").alias("unit_cost"), F.lit(True).alias("is_active"), F.lit("EACH").alias("unit_of_measure"))


def test_version_chain(spark):
    data = [("e2", "p", "2026-03-05 00:00:00", "B", "old"), ("e1", "p", "2026-03-01 00:00:00", "A", "older"), ("e3", "p", "2026-03-07 00:00:00", "B", "newest"), ("e4", "p", "2026-03-06 00:00:00", None, "x"), ("e5", "q", "2026-03-06 00:00:00", "Z", "q")]
    dim = warehouse.dim_product(product(spark, data))
    got = [(r.version_number, r.brand, r.product_name, r.effective_from_utc.day, r.effective_to_utc.year, r.is_current) for r in dim.where("product_id = 'p'").orderBy("version_number").collect()]
    assert got == [(1, "A", "newest", 1, 2026, False), (2, "B", "newest", 5, 2026, False), (3, None, "newest", 6, 2026, False), (4, "B", "newest", 7, 9999, True)]
    shuffled = warehouse.dim_product(product(spark, data[::-1]))
    assert rows(dim.select(*sorted(dim.columns))) == rows(shuffled.select(*sorted(dim.columns)))
    used = spark.createDataFrame([("p",), ("new",), (None,)], "product_id string")
    full = warehouse.with_inferred_products(dim, used)
    one = full.where("product_id = 'new'").first()
    assert one.is_inferred and int(one.product_key) == int(spark.range(1).select(scd2_key(F.lit("new"), F.lit("1900-01-01").cast("timestamp"))).first()[0]) and full.where("product_id in ('-1', '-2')").count() == 2


def test_snapshot_carries_forward(spark):
    def move(i, kind, delta, after, at):
        return (i, "s", "p", kind, delta, after, at)

    data = [move("m1", "RECEIPT", 10, 10, "2026-03-01 01:00:00"), move("m2", "SALE", -3, 7, "2026-03-03 02:00:00"), move("m3", "SALE", -5, 2, "2026-03-03 05:00:00"), move("m4", "ADJUSTMENT", 1, 3, "2026-03-11 05:00:00")]
    moves = spark.createDataFrame(data, "movement_id string, store_id string, product_id string, movement_type string, quantity_delta bigint, quantity_on_hand_after bigint, t string").withColumn("event_ts", F.col("t").cast("timestamp")).withColumn("event_ts_local", F.from_utc_timestamp("event_ts", "Asia/Kuala_Lumpur"))
    stores = warehouse.dim_store(spark.createDataFrame([("s", "S", "c", "st", "r", "f", 1, None, "Asia/Kuala_Lumpur")], "store_id string, store_name string, city string, state string, region string, store_format string, size_sqm bigint, opened_date date, timezone string"))
    products = warehouse.dim_product(product(spark, [("e", "p", "2026-03-02 00:00:00", "A", "n")])).withColumn("unit_cost", F.lit(2).cast("decimal(12,2)"))
    got = {r.snapshot_date.day: (r.closing_on_hand, r.units_received, r.units_sold, r.units_adjusted, round(float(r.avg_daily_units_sold_7d), 4), r.is_below_reorder_point, float(r.closing_value)) for r in warehouse.inventory_snapshots(moves, stores, products, "2026-03-01", "2026-03-12").collect()}
    assert got[1] == (10, 10, 0, 0, 0.0, False, 20.0) and got[2] == (10, 0, 0, 0, 0.0, False, 20.0)
    assert got[3] == (2, 0, 8, 0, 1.1429, True, 4.0) and got[9] == (2, 0, 0, 0, 1.1429, True, 4.0) and got[10][4] == 0.0
    assert got[11] == (3, 0, 0, 1, 0.0, False, 6.0) and len(got) == 12


def test_dim_date(spark):
    d = warehouse.dim_date(spark)
    assert d.count() == 4019 and d.select("date_key").distinct().count() == 4019
    r = d.where("date_key = 20260831").first()
    assert (r.day_name, r.iso_week, r.is_weekend, r.holiday_name) == ("Mon", 36, False, "National Day")
