"""The incremental warehouse: one run per batch of raw records, atomic over all tables.

Staging tables only grow (a folder per batch). Dimension chains are rebuilt for the affected keys only. Facts are kept
by calendar day; a run rewrites the days that got new lines or whose keys a rebuilt chain changes. Everything a run writes
carries its batch number and becomes visible by one rename, the commit; a run that dies leaves nothing to be seen, and
running a committed batch again does nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import quality
from millrace.operators.merge import insert_only, rebuild
from millrace.plans import warehouse as w
from millrace.sources.landing import Files

SNAPSHOT_DAYS = 3


class Pipeline:
    """The tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.upto = max([-1, *(int(n[6:]) for n, _, _ in self.files.children(f"{self.root}/commit") if n.startswith("batch="))])

    def _batches(self, name: str, upto: int) -> list[int]:
        return sorted(b for b in (int(n[6:]) for n, _, _ in self.files.children(f"{self.root}/{name}") if n.startswith("batch=")) if b <= upto)

    def _write(self, name: str, batch: int, df: DataFrame, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}/batch={batch}")

    def _read(self, name: str, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/batch={batch}")

    def grown(self, name: str, upto: int | None = None) -> DataFrame | None:
        """All rows of a table that only grows."""
        found = self._batches(name, self.upto if upto is None else upto)
        return reduce(lambda a, b: a.unionByName(b), [self._read(name, b) for b in found]) if found else None

    def latest(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The rows of a table that each run writes whole."""
        found = self._batches(name, self.upto if upto is None else upto)
        return self._read(name, found[-1]) if found else None

    def days(self, name: str, upto: int | None = None) -> DataFrame | None:
        """The rows of a table kept by day: of each day those of the last run that wrote it."""
        found = self._batches(name, self.upto if upto is None else upto)
        if not found:
            return None
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._read(name, b).withColumn("_batch", F.lit(b)) for b in found])
        newest = every.groupBy("date_key").agg(F.max("_batch").alias("_batch"))  # one row per day
        return every.join(newest, ["date_key", "_batch"]).drop("_batch")

    def run(self, batch: int, raw: dict[str, DataFrame], now: str) -> bool:
        """Load one batch of raw records (tables by name; a missing one is empty). False if there was nothing to do.

        Batches are loaded in ascending order. Across batches the first staged event of a transaction stands, as a whole
        basket; later events of it are logged as duplicates.
        """
        if batch <= self.upto or all(df.isEmpty() for df in raw.values()):
            return False
        spark = self.spark
        w.pin_semantics(spark)
        if "store_reference" in raw:
            self._write("stg_store_rows", batch, raw["store_reference"])
        stores = w.stage_stores(self.grown("stg_store_rows", batch))
        self._write("stg_stores", batch, stores)
        stores = self._read("stg_stores", batch)
        self._write("dim_store", batch, w.dim_store(stores))

        for name, table, stage in (("stg_products", "product_updates", w.stage_products), ("stg_customers", "customer_events", w.stage_customers)):
            if table in raw:
                fresh, held = stage(raw[table]), self.grown(name)
                self._write(name, batch, fresh if held is None else insert_only(held, fresh, ["event_id"]))
        self._stage_keyed(batch, raw, "pos_transactions", "transaction_id", "stg_lines", w.typed_sales, lambda df: w.stage_lines(df, stores))
        self._stage_keyed(batch, raw, "inventory_events", "movement_id", "stg_movements", w.typed_movements, lambda df: w.stage_movements(df, stores))

        lines, moves = self.grown("stg_lines", batch), self.grown("stg_movements", batch)
        used = [df.select("product_id") for df in (lines, moves) if df is not None]
        products = self._dimension(batch, "dim_product", "stg_products", "product_id", w.dim_product, lambda d: w.with_inferred_products(d, reduce(DataFrame.unionByName, used)))
        customers = self._dimension(batch, "dim_customer", "stg_customers", "customer_id", w.dim_customer, lambda d: w.with_inferred_customers(d, lines))
        dates, dim_stores = w.dim_date(spark), self._read("dim_store", batch)
        self._facts(batch, "fact_sales", "stg_lines", lines, lambda df: w.fact_sales(df, dates, dim_stores, products, customers), {"product_id": "stg_products", "customer_id": "stg_customers"})
        self._facts(batch, "fact_inventory", "stg_movements", moves, lambda df: w.fact_inventory(df, dates, dim_stores, products), {"product_id": "stg_products"})
        self._snapshots(batch, dim_stores, products, self.latest("dim_product"))
        sales = self.days("fact_sales", batch)
        if sales is not None:
            stock = self.days("fact_inventory", batch)
            checks = [quality.sf003(sales, products, customers), quality.sf007(sales, now)] + ([quality.sf004(sales, stock), quality.sf008(stock)] if stock is not None else [])
            self._write("dq_results", batch, quality.run_checks(checks).withColumn("checked_at", F.lit(now).cast("timestamp")))
        spark.range(1).write.mode("overwrite").parquet(f"{self.root}/_commit-{batch}")
        self.files.move(f"{self.root}/_commit-{batch}", f"{self.root}/commit/batch={batch}")
        self.upto = batch
        return True

    def _stage_keyed(self, batch: int, raw: dict[str, DataFrame], table: str, key: str, name: str, typed, stage) -> None:
        if table not in raw:
            return
        rows, held = typed(raw[table]), self.grown(name)
        first = w.first_events(rows, key)
        kept = first.select(key, F.col("event_id").alias("kept_event_id"))
        if held is not None:
            staged = held.groupBy(key).agg(F.min("event_id").alias("_staged"))
            kept = kept.join(staged, key, "left").select(key, F.coalesce("_staged", "kept_event_id").alias("kept_event_id"))
            first = first.join(staged, key, "left_anti")
        again = rows.join(kept, key).where("event_id <> kept_event_id").select(F.lit(table).alias("dataset"), F.col(key).alias("business_key"), "kept_event_id", F.col("event_id").alias("duplicate_event_id"), F.col("event_ts").alias("duplicate_event_ts"))
        logged = self.grown(f"duplicates_{table}")
        self._write(f"duplicates_{table}", batch, again.dropDuplicates(["duplicate_event_id"]) if logged is None else insert_only(logged, again, ["duplicate_event_id"]))
        self._write(name, batch, stage(first))

    def _dimension(self, batch: int, name: str, staged: str, key: str, build, complete) -> DataFrame:
        """Chains of the keys that changed in this batch are rebuilt from all their changes; members are inferred for the rest."""
        before, changes = self.latest(name), self.grown(staged, batch)
        new = self._read(staged, batch).select(key).distinct() if batch in self._batches(staged, batch) else None
        if before is None or new is None:
            real = build(changes) if before is None else before.where(f"not is_inferred and {key} not in ('-1', '-2')")
        else:
            fresh = build(changes.join(new, key, "left_semi"))
            real = rebuild(before.where(f"not is_inferred and {key} not in ('-1', '-2')"), fresh, new, [key])
        self._write(name, batch, complete(real))
        return self._read(name, batch)

    def _facts(self, batch: int, name: str, staged: str, lines: DataFrame | None, build, keys: dict[str, str]) -> None:
        """Facts of the days with new lines, or with lines of a changed key, are built anew; other days stay as they are."""
        if lines is None:
            return
        touched = [self._read(staged, batch).select("business_date")] if batch in self._batches(staged, batch) else []
        for key, changes in keys.items():
            if batch in self._batches(changes, batch):
                changed = self._read(changes, batch).select(key).distinct()
                touched.append(lines.join(changed, key, "left_semi").select("business_date"))
        if touched:
            which = reduce(DataFrame.unionByName, touched).distinct()
            self._write(name, batch, build(lines.join(which, "business_date", "left_semi")), "date_key")

    def _snapshots(self, batch: int, stores: DataFrame, products: DataFrame, before: DataFrame | None) -> None:
        """Snapshots from the earliest day that the batch changes up to that of the newest movement.

        These are the last SNAPSHOT_DAYS days, the days after the newest one written so far, those from the first movement
        of the batch on, and those from the beginning of a changed version of a product on. before: the products before
        the batch.
        """
        stock = self.days("fact_inventory", batch)
        last = stock.agg(F.to_date(F.max("event_ts_local")).alias("d")).first().d if stock is not None else None
        if last is None:
            return
        day, starts = F.to_date("event_ts_local"), [last.fromordinal(last.toordinal() - SNAPSHOT_DAYS + 1)]
        held = self.days("snapshots")  # as committed
        written = held.agg(F.max("snapshot_date").alias("d")).first().d if held is not None else None
        if written is None:
            starts.append(stock.agg(F.min(day).alias("d")).first().d)
        else:
            starts.append(written.fromordinal(written.toordinal() + 1))
            if batch in self._batches("stg_movements", batch):
                starts.append(self._read("stg_movements", batch).agg(F.min(day).alias("d")).first().d)
            if before is not None:
                # Each version ends where the next begins, so the beginnings say all. A day takes the version valid at its
                # end, in local time: the day before that of a beginning in UTC is never concerned, but costs little.
                version = ["product_id", "product_key", "unit_cost", "effective_from_utc"]
                old, new = before.select(version), products.select(version)
                changed = old.exceptAll(new).unionByName(new.exceptAll(old))
                moved = stock.groupBy("product_id").agg(F.min(day).alias("moved"))
                starts.append(changed.join(moved, "product_id").agg(F.min(F.greatest("moved", F.date_sub(F.to_date("effective_from_utc"), 1))).alias("d")).first().d)
        first = min(d for d in starts if d is not None)
        self._write("snapshots", batch, w.inventory_snapshots(stock, stores, products, str(first), str(last)), "date_key")
