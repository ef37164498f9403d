"""Staging, dimensions, facts and snapshots over the landed domain tables.

Each table is built once per session and input and written to the shared folder, as a warehouse load would; analytics
read these tables. All builds are set-based; hot keys are combined map-side or cut into chunks of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.functions.clock import micros, rfc3339
from millrace.functions.keys import NOT_APPLICABLE, UNKNOWN, beginning_of_time, date_key, end_of_time, md5_lower64, scd2_key
from millrace.operators.asof import attach_as_of
from millrace.operators.ordered import with_neighbours, with_position
from millrace.session import pin_semantics, work_path
from millrace.sources.landing import Files

DEFAULT_TZ = "Asia/Kuala_Lumpur"
#: Chunk of event time for building version chains.
CHUNK_US = 30 * 86_400_000_000
#: Days for which inventory snapshots are built by default (inclusive).
SNAPSHOT_FROM, SNAPSHOT_TO = "2026-03-02", "2026-04-20"
PAYMENTS, TIERS = ["CASH", "CARD", "EWALLET"], ["BASIC", "SILVER", "GOLD", "PLATINUM"]

_BUILT: dict[tuple, str] = {}


class Warehouse:
    """The tables of one input folder; each property builds its table at first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_semantics(spark)
        self.spark, self.sf_dir = spark, sf_dir
        # Tables are known by what they were built from: names and times of change of the input's files.
        self._input = tuple(Files(spark, sf_dir).children(sf_dir))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The table, built if it is not there. by: a folder per value, so that filters on it (also those that come from a
        joined dimension) skip files; rows are rebalanced by it, which splits large values and merges small ones."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._input, name)
        if key not in _BUILT:
            path = work_path(self.spark, f"wh-{name}")
            rows = build()
            (rows.hint("rebalance", by).write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(path)
            _BUILT[key] = path
        return self.spark.read.parquet(_BUILT[key])

    # Staging

    @property
    def stg_stores(self) -> DataFrame:
        return self.table("stg_stores", lambda: stage_stores(self.raw("store_reference")))

    @property
    def pos_events(self) -> DataFrame:
        return self.table("pos_events", lambda: first_events(typed_sales(self.raw("pos_transactions")), "transaction_id"))

    @property
    def stg_lines(self) -> DataFrame:
        return self.table("stg_lines", lambda: stage_lines(self.pos_events, self.stg_stores))

    @property
    def stg_movements(self) -> DataFrame:
        return self.table("stg_movements", lambda: stage_movements(first_events(typed_movements(self.raw("inventory_events")), "movement_id"), self.stg_stores))

    @property
    def stg_products(self) -> DataFrame:
        return self.table("stg_products", lambda: stage_products(self.raw("product_updates")))

    @property
    def stg_customers(self) -> DataFrame:
        return self.table("stg_customers", lambda: stage_customers(self.raw("customer_events")))

    # Dimensions

    @property
    def dim_date(self) -> DataFrame:
        return dim_date(self.spark)

    @property
    def dim_store(self) -> DataFrame:
        return self.table("dim_store", lambda: dim_store(self.stg_stores))

    @property
    def dim_product(self) -> DataFrame:
        def build() -> DataFrame:
            used = self.stg_lines.select("product_id").unionByName(self.stg_movements.select("product_id"))
            return with_inferred_products(dim_product(self.stg_products), used)

        return self.table("dim_product", build)

    @property
    def dim_customer(self) -> DataFrame:
        return self.table("dim_customer", lambda: with_inferred_customers(dim_customer(self.stg_customers), self.stg_lines))

    # Facts

    @property
    def fact_sales(self) -> DataFrame:
        return self.table("fact_sales", lambda: fact_sales(self.stg_lines, self.dim_date, self.dim_store, self.dim_product, self.dim_customer), "date_key")

    @property
    def fact_inventory(self) -> DataFrame:
        return self.table("fact_inventory", lambda: fact_inventory(self.stg_movements, self.dim_date, self.dim_store, self.dim_product), "date_key")

    @property
    def snapshots(self) -> DataFrame:
        return self.table("snapshots", lambda: inventory_snapshots(self.fact_inventory, self.dim_store, self.dim_product, SNAPSHOT_FROM, SNAPSHOT_TO), "date_key")


def stage_stores(reference: DataFrame) -> DataFrame:
    """Latest row per store (loaded_at, then src_file); missing timezone is DEFAULT_TZ."""
    cols = ["store_name", "city", "state", "region", "store_format", "size_sqm", "opened_date", "timezone"]
    last = reference.where("store_id is not null").groupBy("store_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "src_file")).alias("s"))
    return last.select("store_id", *[F.col(f"s.{c}").alias(c) for c in cols[:-1]], F.coalesce("s.timezone", F.lit(DEFAULT_TZ)).alias("timezone"))


def typed_sales(raw: DataFrame) -> DataFrame:
    """Sales records fit for staging: event, transaction and store ids, a readable time and lines present."""
    p = lambda c: F.col(f"payload.{c}").alias(c)
    rows = raw.select("record_id", F.col("metadata.event_id").alias("event_id"), rfc3339(F.col("metadata.event_timestamp")).alias("event_ts"), "kafka_topic", "kafka_partition", "kafka_offset", "spark_batch_id", p("transaction_id"), p("store_id"), p("register_id"), p("customer_id"), p("payment_method"), p("currency"), p("line_items"), p("total_amount"))
    return rows.where("event_id is not null and transaction_id is not null and store_id is not null and event_ts is not null and line_items is not null")


def typed_movements(raw: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"payload.{c}").alias(c)
    rows = raw.select("record_id", F.col("metadata.event_id").alias("event_id"), rfc3339(F.col("metadata.event_timestamp")).alias("event_ts"), F.col("metadata.causation_id").alias("causation_id"), "kafka_partition", "spark_batch_id", *map(p, ("movement_id", "store_id", "product_id", "movement_type", "quantity_delta", "quantity_on_hand_after", "reason_code", "reference_id", "unit_cost")))
    return rows.where("event_id is not null and movement_id is not null and store_id is not null and product_id is not null and quantity_delta is not null and event_ts is not null")


def first_events(rows: DataFrame, key: str) -> DataFrame:
    """The first record of each business key by event time, then arrival."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("event_ts", "record_id")).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def business_duplicates(rows: DataFrame, dataset: str, key: str) -> DataFrame:
    """Records of a business key under another event id than the kept one; each event id once."""
    kept = rows.groupBy(key).agg(F.min_by("event_id", F.struct("event_ts", "record_id")).alias("kept_event_id"))
    others = rows.join(kept, key).where("event_id <> kept_event_id")
    once = others.groupBy("event_id").agg(F.min_by(F.struct(F.col(key).alias("k"), "kept_event_id", "event_ts"), "record_id").alias("r"))
    return once.select(F.lit(dataset).alias("dataset"), F.col("r.k").alias("business_key"), F.col("r.kept_event_id").alias("kept_event_id"), F.col("event_id").alias("duplicate_event_id"), F.col("r.event_ts").alias("duplicate_event_ts"))


def _local(df: DataFrame, stores: DataFrame) -> DataFrame:
    """df with its time in the store's zone. The store table is one row per store; Spark decides on broadcasting it by size."""
    return df.join(stores.select("store_id", "timezone"), "store_id", "left").withColumn("event_ts_local", F.from_utc_timestamp("event_ts", F.coalesce("timezone", F.lit(DEFAULT_TZ)))).drop("timezone")


def stage_lines(events: DataFrame, stores: DataFrame) -> DataFrame:
    """Flattened lines of the kept events; lines without product, quantity or price are dropped, a missing discount is 0."""
    lines = events.withColumn("l", F.explode("line_items"))
    method = F.when(F.col("payment_method").isin(PAYMENTS), F.col("payment_method")).otherwise("UNKNOWN")
    typed = lines.select("transaction_id", F.col("l.line_number").alias("line_number"), "event_id", "store_id", "register_id", "customer_id", method.alias("payment_method"), "currency", F.col("l.product_id").alias("product_id"), F.col("l.quantity").alias("quantity"), F.col("l.unit_price").cast("decimal(12,2)").alias("unit_price"), F.coalesce("l.discount_amount", F.lit(0)).cast("decimal(12,2)").alias("discount_amount"), "event_ts", "record_id")
    typed = typed.where("line_number is not null and product_id is not null and quantity is not null and unit_price is not null")
    gross = (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")).cast("decimal(14,2)")
    out = typed.withColumn("gross_amount", gross).withColumn("net_amount", (F.col("gross_amount") - F.col("discount_amount")).cast("decimal(14,2)"))
    return _local(out, stores).withColumn("business_date", F.to_date("event_ts_local")).withColumn("local_hour", F.hour("event_ts_local"))


def stage_movements(events: DataFrame, stores: DataFrame) -> DataFrame:
    out = events.withColumn("unit_cost", F.col("unit_cost").cast("decimal(12,2)"))
    return _local(out, stores).withColumn("business_date", F.to_date("event_ts_local"))


def _once(raw: DataFrame, fields: list) -> DataFrame:
    """Change records with key and readable time, each event id once (first arrival)."""
    rows = raw.select("record_id", F.col("metadata.event_id").alias("event_id"), rfc3339(F.col("metadata.event_timestamp")).alias("event_ts"), *fields).where("event_id is not null and event_ts is not null")
    rest = [c for c in rows.columns if c != "event_id"]
    first = rows.groupBy("event_id").agg(F.min_by(F.struct(*rest), "record_id").alias("r"))
    return first.select("event_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def stage_products(raw: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"payload.{c}").alias(c)
    money = lambda c: F.col(f"payload.{c}").cast("decimal(12,2)").alias(c)
    return _once(raw, [*map(p, ("product_id", "product_name", "brand", "category", "subcategory", "unit_of_measure", "is_active")), money("list_price"), money("unit_cost")]).where("product_id is not null")


def stage_customers(raw: DataFrame) -> DataFrame:
    p = lambda c: F.col(f"payload.{c}").alias(c)
    tier = F.when(F.col("payload.loyalty_tier").isin(TIERS), F.col("payload.loyalty_tier")).otherwise("UNKNOWN").alias("loyalty_tier")
    return _once(raw, [*map(p, ("customer_id", "home_store_id", "city", "state", "birth_year", "email_sha256", "marketing_opt_in")), tier, F.col("payload.signup_date").try_cast("date").alias("signup_date")]).where("customer_id is not null")


def dim_date(spark: SparkSession, first: str = "2020-01-01", last: str = "2030-12-31") -> DataFrame:
    """One row per calendar day, plus -1."""
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as full_date")
    md = F.date_format("full_date", "MM-dd")
    name = F.when(md == "01-01", "New Year's Day").when(md == "05-01", "Labour Day").when(md == "08-31", "National Day").when(md == "09-16", "Malaysia Day").when(md == "12-25", "Christmas Day")
    out = days.select(
        date_key(F.col("full_date")).alias("date_key"), "full_date", (F.weekday("full_date") + 1).alias("day_of_week_iso"), F.date_format("full_date", "EEE").alias("day_name"), F.dayofmonth("full_date").alias("day_of_month"), F.dayofyear("full_date").alias("day_of_year"),
        F.weekofyear("full_date").alias("iso_week"), F.month("full_date").alias("month_number"), F.date_format("full_date", "MMM").alias("month_name"), F.date_format("full_date", "yyyy-MM").alias("year_month"), F.quarter("full_date").alias("quarter"), F.year("full_date").alias("year"),
        (F.weekday("full_date") >= 5).alias("is_weekend"), name.isNotNull().alias("is_public_holiday"), name.alias("holiday_name"),
    )
    unknown = spark.createDataFrame([(-1, "1900-01-01", 1, "Unk", 1, 1, 1, 1, "Unk", "Unknown", 1, 1900, False, False, "Unknown")], "date_key int, d string, day_of_week_iso int, day_name string, day_of_month int, day_of_year int, iso_week int, month_number int, month_name string, year_month string, quarter int, year int, is_weekend boolean, is_public_holiday boolean, holiday_name string")
    return out.unionByName(unknown.withColumn("full_date", F.to_date("d")).drop("d"))


def dim_store(stores: DataFrame) -> DataFrame:
    """Type-1 store dimension with the reserved members."""
    rows = stores.select(md5_lower64(F.col("store_id")).alias("store_key"), "*")
    return rows.unionByName(_reserved(rows, "store_id", "store_key", ["store_name", "region", "store_format"]).select("store_key", "store_id", "store_name", "region", "store_format"), allowMissingColumns=True)


def version_chain(changes: DataFrame, key: str, type2: list[str], type1: list[str]) -> DataFrame:
    """Type-2 versions with the latest type-1 values, in order of (event_ts, event_id).

    A version starts where a type-2 attribute is distinct from that of the row before (null is a value). The first starts
    at the beginning of time; each ends where the next starts. Changes at one instant give an empty interval.
    """
    rows = changes.withColumn("chunk", F.floor(micros(F.col("event_ts")) / CHUNK_US))
    rows = with_neighbours(rows, [key], "chunk", ["event_ts", "event_id"], F.struct(*type2), before="prev")
    starts = rows.where(F.col("prev").isNull() | ~F.col("prev").eqNullSafe(F.struct(*type2))).drop("prev")
    starts = with_neighbours(starts, [key], "chunk", ["event_ts", "event_id"], F.struct(F.col("event_ts").alias("at")), after="next")
    starts = with_position(starts, [key], "chunk", ["event_ts", "event_id"], "version_number")
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*type1), F.struct("event_ts", "event_id")).alias("t1"))
    start = F.when(F.col("version_number") == 1, beginning_of_time()).otherwise(F.col("event_ts"))
    out = starts.drop(*type1).join(latest, key).withColumn("effective_from_utc", start)
    return out.select(key, *[F.col(f"t1.{c}").alias(c) for c in type1], *type2, "effective_from_utc", F.coalesce("next.at", end_of_time()).alias("effective_to_utc"), F.col("next").isNull().alias("is_current"), F.lit(False).alias("is_inferred"), F.col("version_number").cast("int").alias("version_number"), F.col("event_id").alias("source_event_id"))


PRODUCT_T2 = ["brand", "category", "subcategory", "list_price", "unit_cost", "is_active"]
CUSTOMER_T2 = ["loyalty_tier", "home_store_id", "city", "state"]


def dim_product(changes: DataFrame) -> DataFrame:
    out = version_chain(changes, "product_id", PRODUCT_T2, ["product_name", "unit_of_measure"])
    return out.select(scd2_key(F.col("product_id"), F.col("effective_from_utc")).alias("product_key"), "*")


def age_band(birth_year, as_of_year: int):
    """Age band at a given year (never the wall clock)."""
    age = F.lit(as_of_year) - birth_year
    return F.when(birth_year.isNull(), "Unknown").when(age < 25, "18-24").when(age < 35, "25-34").when(age < 45, "35-44").when(age < 55, "45-54").when(age < 65, "55-64").otherwise("65+")


def dim_customer(changes: DataFrame, as_of_year: int = 2026) -> DataFrame:
    out = version_chain(changes, "customer_id", CUSTOMER_T2, ["signup_date", "birth_year", "marketing_opt_in", "email_sha256"])
    out = out.withColumn("age_band", age_band(F.col("birth_year"), as_of_year)).withColumn("has_email", F.col("email_sha256").isNotNull()).drop("birth_year", "email_sha256")
    return out.select(scd2_key(F.col("customer_id"), F.col("effective_from_utc")).alias("customer_key"), "*")


def _inferred(dim: DataFrame, used: DataFrame, key: str, surrogate: str, fixed: dict[str, str]) -> DataFrame:
    """Members for natural keys that facts use and the dimension lacks, under the key their first real version will have."""
    missing = used.where(F.col(key).isNotNull()).select(key).distinct().join(dim.select(key).distinct(), key, "left_anti")
    return missing.select(scd2_key(F.col(key), beginning_of_time()).alias(surrogate), key, *[F.lit(v).alias(c) for c, v in fixed.items()], beginning_of_time().alias("effective_from_utc"), end_of_time().alias("effective_to_utc"), F.lit(True).alias("is_current"), F.lit(True).alias("is_inferred"), F.lit(1).alias("version_number"))


def _reserved(dim: DataFrame, key: str, surrogate: str, named: list[str], second: str = "Not applicable") -> DataFrame:
    """The members -1 (unknown) and -2 (not applicable)."""
    rows = dim.sparkSession.createDataFrame([(UNKNOWN, "Unknown"), (NOT_APPLICABLE, second)], "k int, n string")
    return rows.select(F.col("k").cast("decimal(20,0)").alias(surrogate), F.col("k").cast("string").alias(key), *[F.col("n").alias(c) for c in named], beginning_of_time().alias("effective_from_utc"), end_of_time().alias("effective_to_utc"), F.lit(True).alias("is_current"), F.lit(False).alias("is_inferred"), F.lit(1).alias("version_number"))


def with_inferred_products(dim: DataFrame, used: DataFrame) -> DataFrame:
    inferred = _inferred(dim, used, "product_id", "product_key", {"product_name": "Unknown (inferred)", "brand": "Unknown", "category": "Unknown", "subcategory": "Unknown"})
    return dim.unionByName(inferred, allowMissingColumns=True).unionByName(_reserved(dim, "product_id", "product_key", ["product_name", "brand", "category", "subcategory"]), allowMissingColumns=True)


def with_inferred_customers(dim: DataFrame, used: DataFrame) -> DataFrame:
    inferred = _inferred(dim, used, "customer_id", "customer_key", {"loyalty_tier": "Unknown (inferred)"})
    return dim.unionByName(inferred, allowMissingColumns=True).unionByName(_reserved(dim, "customer_id", "customer_key", ["loyalty_tier"], "Guest (no loyalty account)"), allowMissingColumns=True)


def _as_of(df: DataFrame, dim: DataFrame, key: str, carry: list[str], unique: list[str], probe: DataFrame | None = None) -> DataFrame:
    # A dimension's versions tile time (version_chain), and inferred members are of keys without any.
    timed = lambda x: x.withColumn("_at_us", micros(F.col("event_ts")))
    sides = dim.select(key, micros(F.col("effective_from_utc")).alias("_low_us"), micros(F.col("effective_to_utc")).alias("_high_us"), "version_number", *carry)
    return attach_as_of(timed(df), sides, key, "_at_us", "_low_us", "_high_us", carry, ["_low_us", "version_number"], unique, probe=None if probe is None else timed(probe), tiled=True).drop("_at_us")


def fact_sales(lines: DataFrame, dates: DataFrame, stores: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per transaction line with the keys valid at its time; -1 unknown, -2 guest."""
    unknown = lambda k: F.lit(k).cast("decimal(20,0)")
    out = _as_of(lines, products, "product_id", ["product_key", "unit_cost"], ["transaction_id", "line_number"]).withColumnRenamed("version", "p")
    out = _as_of(out, customers, "customer_id", ["customer_key"], ["transaction_id", "line_number"], lines).withColumnRenamed("version", "c")
    out = out.join(stores.select("store_id", "store_key"), "store_id", "left").join(dates.where("date_key > 0").select("date_key", F.col("full_date").alias("business_date")), "business_date", "left")
    return out.select(
        md5_lower64(F.concat("transaction_id", F.lit("|"), F.col("line_number").cast("string"))).alias("sales_line_key"), F.coalesce("date_key", F.lit(UNKNOWN)).alias("date_key"), F.coalesce("store_key", unknown(UNKNOWN)).alias("store_key"), F.coalesce("p.product_key", unknown(UNKNOWN)).alias("product_key"),
        F.when(F.col("customer_id").isNull(), unknown(NOT_APPLICABLE)).otherwise(F.coalesce("c.customer_key", unknown(UNKNOWN))).alias("customer_key"), "transaction_id", "line_number", "payment_method", "register_id", "store_id", "product_id", "customer_id", "event_ts", "event_ts_local", "local_hour",
        "quantity", "unit_price", "gross_amount", "discount_amount", "net_amount", (F.col("quantity").cast("decimal(10,0)") * F.col("p.unit_cost")).cast("decimal(14,2)").alias("cost_amount"), "event_id",
    )


def fact_inventory(moves: DataFrame, dates: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    unknown = F.lit(UNKNOWN).cast("decimal(20,0)")
    out = _as_of(moves, products, "product_id", ["product_key", "unit_cost"], ["movement_id"])
    out = out.join(stores.select("store_id", "store_key"), "store_id", "left").join(dates.where("date_key > 0").select("date_key", F.col("full_date").alias("business_date")), "business_date", "left")
    value = (F.col("quantity_delta").cast("decimal(10,0)") * F.coalesce("unit_cost", "version.unit_cost")).cast("decimal(14,2)")
    return out.select(md5_lower64(F.col("movement_id")).alias("inventory_movement_key"), F.coalesce("date_key", F.lit(UNKNOWN)).alias("date_key"), F.coalesce("store_key", unknown).alias("store_key"), F.coalesce("version.product_key", unknown).alias("product_key"), "movement_id", "movement_type", "reason_code", "reference_id", "store_id", "product_id", "event_ts", "event_ts_local", "quantity_delta", "quantity_on_hand_after", "unit_cost", value.alias("movement_value"), "event_id")


def inventory_snapshots(moves: DataFrame, stores: DataFrame, products: DataFrame, first: str, last: str) -> DataFrame:
    """Closing stock per store, product and day from the first movement on, carried forward over days without one.

    All days in one set-based pass: movements are combined per day, then each day's closing is repeated up to the next
    day with a movement. The 7-day average divides by 7; below the reorder point means under 3 days of cover.
    """
    day = F.to_date("event_ts_local")
    total = lambda kind, sign: F.sum(F.when(F.col("movement_type") == kind, sign * F.col("quantity_delta")).otherwise(0))
    daily = moves.where(day <= F.lit(last).cast("date")).groupBy("store_id", "product_id", day.alias("day")).agg(F.max_by("quantity_on_hand_after", F.struct("event_ts", "movement_id")).alias("closing"), total("RECEIPT", 1).alias("received"), total("SALE", -1).alias("sold"), total("ADJUSTMENT", 1).alias("adjusted"), F.max(F.struct("event_ts", "movement_id")).alias("at"))
    pair = Window.partitionBy("store_id", "product_id").orderBy("day")
    # The last movement by UTC time holds, though a zone change may put an earlier one on a later local day.
    best = F.max_by("closing", "at").over(pair.rowsBetween(Window.unboundedPreceding, 0))
    spans = daily.select("store_id", "product_id", "day", best.alias("closing"), "received", "sold", "adjusted", F.coalesce(F.date_sub(F.lead("day").over(pair), 1), F.lit(last).cast("date")).alias("until"))
    every = spans.withColumn("d", F.explode(F.sequence("day", "until"))).withColumn("own", F.col("d") == F.col("day"))
    for c in ("received", "sold", "adjusted"):
        every = every.withColumn(c, F.when(F.col("own"), F.col(c)).otherwise(0))
    week = Window.partitionBy("store_id", "product_id").orderBy("d").rowsBetween(-6, 0)
    every = every.withColumn("avg7", (F.sum("sold").over(week).cast("decimal(18,0)") / F.lit(7).cast("decimal(2,0)")).cast("decimal(18,6)")).where(F.col("d") >= F.lit(first).cast("date"))
    eod = F.to_utc_timestamp(F.date_add("d", 1).cast("timestamp"), DEFAULT_TZ)
    every = every.withColumn("eod", eod)
    # The version at the end of the day: from < eod <= to, which is from <= eod - 1 < to in whole microseconds.
    every = every.withColumn("event_ts", F.timestamp_micros(micros(F.col("eod")) - 1))
    dim = products.select("product_id", "product_key", F.col("unit_cost").alias("version_cost"), "effective_from_utc", "effective_to_utc", "version_number")
    out = _as_of(every, dim, "product_id", ["product_key", "version_cost"], ["store_id"]).select("*", "version.*")
    out = out.join(stores.select("store_id", "store_key"), "store_id", "left")
    unknown = F.lit(UNKNOWN).cast("decimal(20,0)")
    return out.select(date_key(F.col("d")).alias("date_key"), F.col("d").alias("snapshot_date"), F.coalesce("store_key", unknown).alias("store_key"), F.coalesce("product_key", unknown).alias("product_key"), "store_id", "product_id", F.col("closing").alias("closing_on_hand"), (F.col("closing").cast("decimal(12,0)") * F.col("version_cost")).cast("decimal(14,2)").alias("closing_value"), F.col("received").alias("units_received"), F.col("sold").alias("units_sold"), F.col("adjusted").alias("units_adjusted"), F.col("avg7").alias("avg_daily_units_sold_7d"), (F.col("closing") < 3 * F.col("avg7")).alias("is_below_reorder_point"))
