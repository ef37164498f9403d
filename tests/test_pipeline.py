from pyspark.sql import functions as F

from millrace.plans.pipeline import Pipeline
from millrace.plans.warehouse import SNAPSHOT_FROM, SNAPSHOT_TO, Warehouse, inventory_snapshots

from .conftest import rows

TABLES = ("pos_transactions", "inventory_events", "customer_events", "product_updates")


def thirds(spark, data, k):
    out = {}
    for t in TABLES:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        top = df.agg(F.max("record_id")).first()[0]
        out[t] = df.where((F.col("record_id") > top * k // 3 if k else F.lit(True)) & (F.col("record_id") <= top * (k + 1) // 3))
    if k == 0:
        out["store_reference"] = spark.read.parquet(f"{data}/store_reference.parquet")
    return out


def test_batches_reach_what_one_build_gives(spark, data, tmp_path):
    p = Pipeline(spark, str(tmp_path / "wh"))
    now = "2026-04-21 00:00:00"
    for k in range(3):
        assert p.run(k, thirds(spark, data, k), now)
    assert not p.run(2, thirds(spark, data, 2), now)  # a replay
    assert not p.run(9, {t: df.where("false") for t, df in thirds(spark, data, 0).items()}, now)  # nothing new
    whole = Warehouse(spark, data)
    dims = lambda df, key: rows(df.where("not is_inferred").select(F.col(key).cast("string"), "effective_from_utc", "effective_to_utc", "version_number", "is_current"))
    assert dims(p.latest("dim_product"), "product_key") == dims(whole.dim_product, "product_key")
    assert dims(p.latest("dim_customer"), "customer_key") == dims(whole.dim_customer, "customer_key")
    # Transactions with one event only: what counts as first does not depend on batches.
    once = whole.raw("pos_transactions").groupBy(F.col("payload.transaction_id").alias("transaction_id")).count().where("count = 1").select("transaction_id")
    facts = lambda df: rows(df.join(once, "transaction_id", "left_semi").select("transaction_id", "line_number", "date_key", *[F.col(c).cast("string") for c in ("store_key", "product_key", "customer_key")], "net_amount", "cost_amount"))
    assert facts(p.days("fact_sales")) == facts(whole.fact_sales)
    sales = p.days("fact_sales")
    assert sales.count() == sales.select("sales_line_key").distinct().count() == p.grown("stg_lines").count()
    assert p.grown("duplicates_pos_transactions").count() == p.grown("duplicates_pos_transactions").select("duplicate_event_id").distinct().count() > 0
    stock = lambda df: rows(df.where("date_key >= 20260418").select("date_key", "store_id", "product_id", "closing_on_hand", "units_sold"))
    assert stock(p.days("snapshots").where("date_key <= 20260420")) == stock(whole.snapshots)
    assert p.grown("dq_results").where("checked_at is null").isEmpty()
    # A reader that opens the tables anew sees the committed state; a run that died is not seen.
    p._write("stg_lines", 3, p.grown("stg_lines").limit(1))
    assert Pipeline(spark, str(tmp_path / "wh")).grown("stg_lines").count() == sales.count()


def snapshots_of_one_build(p, first, last):
    return inventory_snapshots(p.days("fact_inventory"), p.latest("dim_store"), p.latest("dim_product"), first, last)


def all_columns(df):
    return rows(df.select("date_key", "snapshot_date", *[F.col(c).cast("string") for c in ("store_key", "product_key")], "store_id", "product_id", "closing_on_hand", "closing_value", "units_received", "units_sold", "units_adjusted", "avg_daily_units_sold_7d", "is_below_reorder_point"))


def test_batches_leave_no_day_without_snapshots(spark, data, tmp_path):
    p = Pipeline(spark, str(tmp_path / "wh"))
    whole = Warehouse(spark, data)
    for k in range(3):
        assert p.run(k, thirds(spark, data, k), "2026-04-21 00:00:00")
    kept = p.days("snapshots").where(f"snapshot_date between '{SNAPSHOT_FROM}' and '{SNAPSHOT_TO}'")
    assert kept.select("date_key").distinct().count() == whole.snapshots.select("date_key").distinct().count() > 40
    assert all_columns(kept) == all_columns(whole.snapshots)


def test_late_movements_products_and_gaps_correct_old_snapshots(spark, data, tmp_path):
    p = Pipeline(spark, str(tmp_path / "wh"))
    raw = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in (*TABLES, "store_reference")}
    moves, top = raw["inventory_events"], raw["inventory_events"].agg(F.max("record_id")).first()[0]
    early, late = F.col("record_id") <= top // 5, F.col("record_id") > top // 2
    first = {t: df.limit(0) for t, df in raw.items()} | {"store_reference": raw["store_reference"], "pos_transactions": raw["pos_transactions"].limit(5), "customer_events": raw["customer_events"].limit(5), "product_updates": raw["product_updates"].where("record_id % 3 = 0")}
    batches = [
        first | {"inventory_events": moves.where(early & (F.col("record_id") % 2 == 0))},
        {"inventory_events": moves.where(late)},  # days without any movement lie between
        {"inventory_events": moves.where(early & (F.col("record_id") % 2 == 1))},  # late
        {"product_updates": raw["product_updates"].where("record_id % 3 <> 0")},  # late versions, no movement
    ]
    for k, batch in enumerate(batches):
        assert p.run(k, batch, "2026-04-21 00:00:00")
        days = p.days("snapshots").agg(F.min("snapshot_date").cast("string"), F.max("snapshot_date").cast("string")).first()
        assert all_columns(p.days("snapshots")) == all_columns(snapshots_of_one_build(p, *days)), k
        moved = p.days("fact_inventory").agg(F.min(F.to_date("event_ts_local")).cast("string"), F.max(F.to_date("event_ts_local")).cast("string")).first()
        assert days[0] <= moved[0] and days[1] == moved[1], k
