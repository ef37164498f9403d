"""Analytics over the star schema: each query as a DataFrame function and as the SQL it must equal.

Periods end at AS_OF (never the wall clock). Ratios are single divisions of exact sums; ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from millrace.functions.keys import NOT_APPLICABLE, qualify_row_number, ratio
from millrace.operators.windows import product_units_1h
from millrace.plans.warehouse import Warehouse

AS_OF, HOUR = "2026-04-21", "2026-04-15 10:00:00"

WAREHOUSE_SQL = """
ev as (select *, case when regexp_full_match(metadata.event_timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})') then try_cast(upper(metadata.event_timestamp) as timestamptz) at time zone 'UTC' end as event_ts from pos_transactions),
stg_stores as (select * exclude (rn), coalesce(timezone, 'Asia/Kuala_Lumpur') as tz from (select *, row_number() over (partition by store_id order by loaded_at desc, src_file desc) as rn from store_reference where store_id is not null) where rn = 1),
typed_sales as (select record_id, metadata.event_id as event_id, event_ts, unnest(payload) from ev where metadata.event_id is not null and payload.transaction_id is not null and payload.store_id is not null and event_ts is not null and payload.line_items is not null),
pos_events as (select * exclude (rn) from (select *, row_number() over (partition by transaction_id order by event_ts, record_id) as rn from typed_sales) where rn = 1),
raw_lines as (select * exclude (line_items), unnest(line_items) as l from pos_events),
stg_lines as (select r.transaction_id, l.line_number as line_number, r.event_id, r.store_id, r.register_id, r.customer_id, case when r.payment_method in ('CASH','CARD','EWALLET') then r.payment_method else 'UNKNOWN' end as payment_method, l.product_id as product_id, l.quantity as quantity,
    cast(l.unit_price as decimal(12,2)) as unit_price, cast(coalesce(l.discount_amount, 0) as decimal(12,2)) as discount_amount, r.event_ts, cast(l.quantity * cast(l.unit_price as decimal(12,2)) as decimal(14,2)) as gross_amount,
    cast(l.quantity * cast(l.unit_price as decimal(12,2)) - cast(coalesce(l.discount_amount, 0) as decimal(12,2)) as decimal(14,2)) as net_amount, (r.event_ts at time zone 'UTC') at time zone coalesce(s.tz, 'Asia/Kuala_Lumpur') as event_ts_local
    from raw_lines r left join stg_stores s on s.store_id = r.store_id where l.line_number is not null and l.product_id is not null and l.quantity is not null and l.unit_price is not null),
iev as (select *, case when regexp_full_match(metadata.event_timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})') then try_cast(upper(metadata.event_timestamp) as timestamptz) at time zone 'UTC' end as event_ts from inventory_events),
typed_moves as (select record_id, metadata.event_id as event_id, event_ts, unnest(payload) from iev where metadata.event_id is not null and payload.movement_id is not null and payload.store_id is not null and payload.product_id is not null and payload.quantity_delta is not null and event_ts is not null),
stg_moves as (select m.* exclude (rn, unit_cost), cast(m.unit_cost as decimal(12,2)) as unit_cost, (m.event_ts at time zone 'UTC') at time zone coalesce(s.tz, 'Asia/Kuala_Lumpur') as event_ts_local from (select *, row_number() over (partition by movement_id order by event_ts, record_id) as rn from typed_moves) m left join stg_stores s on s.store_id = m.store_id where rn = 1),
stg_products as (select * exclude (rn, list_price, unit_cost), cast(list_price as decimal(12,2)) as list_price, cast(unit_cost as decimal(12,2)) as unit_cost from (select record_id, metadata.event_id as event_id, unnest(payload), (metadata.event_timestamp::timestamptz) at time zone 'UTC' as event_ts, row_number() over (partition by metadata.event_id order by record_id) as rn from product_updates where metadata.event_id is not null and payload.product_id is not null) where rn = 1),
stg_customers as (select * exclude (rn, loyalty_tier, signup_date), case when loyalty_tier in ('BASIC','SILVER','GOLD','PLATINUM') then loyalty_tier else 'UNKNOWN' end as loyalty_tier, try_cast(signup_date as date) as signup_date from (select record_id, metadata.event_id as event_id, unnest(payload), (metadata.event_timestamp::timestamptz) at time zone 'UTC' as event_ts, row_number() over (partition by metadata.event_id order by record_id) as rn from customer_events where metadata.event_id is not null and payload.customer_id is not null) where rn = 1),
prod_changes as (select *, struct_pack(a := brand, b := category, c := subcategory, d := list_price, e := unit_cost, f := is_active) as t2 from stg_products),
prod_starts as (select *, row_number() over (partition by product_id order by event_ts, event_id) as version_number from (select *, lag(t2) over w as prev, row_number() over w as n from prod_changes window w as (partition by product_id order by event_ts, event_id)) where n = 1 or prev is distinct from t2),
prod_from as (select *, case when version_number = 1 then timestamp '1900-01-01' else event_ts end as f from prod_starts),
prod_latest as (select product_id, product_name, unit_of_measure from (select *, row_number() over (partition by product_id order by event_ts desc, event_id desc) as rn from prod_changes) where rn = 1),
prod_real as (select p.product_id, t.product_name, t.unit_of_measure, brand, category, subcategory, list_price, unit_cost, is_active, f as effective_from_utc, lead(f) over (partition by p.product_id order by version_number) as nxt, false as is_inferred, version_number from prod_from p join prod_latest t on t.product_id = p.product_id),
dim_product as (select cast(('0x' || right(md5(product_id || '|' || strftime(effective_from_utc, '%Y-%m-%d %H:%M:%S.%f') || '000'), 16))::uhugeint as varchar) as product_key, * exclude (nxt), coalesce(nxt, timestamp '9999-12-31') as effective_to_utc, nxt is null as is_current from (
    select * from prod_real union all select distinct product_id, 'Unknown (inferred)', null, 'Unknown', 'Unknown', 'Unknown', null, null, null, timestamp '1900-01-01', null::timestamp, true, 1 from (select product_id from stg_lines union select product_id from stg_moves) where product_id not in (select product_id from prod_real))),
cust_changes as (select *, struct_pack(a := loyalty_tier, b := home_store_id, c := city, d := state) as t2 from stg_customers),
cust_starts as (select *, row_number() over (partition by customer_id order by event_ts, event_id) as version_number from (select *, lag(t2) over w as prev, row_number() over w as n from cust_changes window w as (partition by customer_id order by event_ts, event_id)) where n = 1 or prev is distinct from t2),
cust_from as (select *, case when version_number = 1 then timestamp '1900-01-01' else event_ts end as f from cust_starts),
cust_latest as (select customer_id, signup_date, birth_year, marketing_opt_in, email_sha256 from (select *, row_number() over (partition by customer_id order by event_ts desc, event_id desc) as rn from cust_changes) where rn = 1),
cust_real as (select c.customer_id, loyalty_tier, home_store_id, city, state, t.signup_date, case when t.birth_year is null then 'Unknown' when 2026 - t.birth_year < 25 then '18-24' when 2026 - t.birth_year < 35 then '25-34' when 2026 - t.birth_year < 45 then '35-44' when 2026 - t.birth_year < 55 then '45-54' when 2026 - t.birth_year < 65 then '55-64' else '65+' end as age_band,
    t.marketing_opt_in, t.email_sha256 is not null as has_email, f as effective_from_utc, lead(f) over (partition by c.customer_id order by version_number) as nxt, false as is_inferred, version_number from cust_from c join cust_latest t on t.customer_id = c.customer_id),
dim_customer as (select cast(('0x' || right(md5(customer_id || '|' || strftime(effective_from_utc, '%Y-%m-%d %H:%M:%S.%f') || '000'), 16))::uhugeint as varchar) as customer_key, * exclude (nxt), coalesce(nxt, timestamp '9999-12-31') as effective_to_utc, nxt is null as is_current from (
    select * from cust_real union all select distinct customer_id, 'Unknown (inferred)', null, null, null, null::date, null, null, null, timestamp '1900-01-01', null::timestamp, true, 1 from stg_lines where customer_id is not null and customer_id not in (select customer_id from cust_real))),
dim_customer_all as (select customer_key, customer_id, loyalty_tier, is_inferred, version_number, effective_from_utc from dim_customer union all values ('-1', '-1', 'Unknown', false, 1, timestamp '1900-01-01'), ('-2', '-2', 'Guest (no loyalty account)', false, 1, timestamp '1900-01-01')),
dim_store as (select cast(('0x' || right(md5(store_id), 16))::uhugeint as varchar) as store_key, store_id, store_name, region, store_format, size_sqm from stg_stores union all values ('-1', '-1', 'Unknown', 'Unknown', 'Unknown', null), ('-2', '-2', 'Not applicable', 'Not applicable', 'Not applicable', null)),
fact_sales as (select cast(('0x' || right(md5(l.transaction_id || '|' || l.line_number), 16))::uhugeint as varchar) as sales_line_key, cast(strftime(event_ts_local, '%Y%m%d') as int) as date_key, coalesce(st.store_key, '-1') as store_key, coalesce(p.product_key, '-1') as product_key,
    case when l.customer_id is null then '-2' else coalesce(c.customer_key, '-1') end as customer_key, l.*, hour(event_ts_local) as local_hour, cast(event_ts_local as date) as full_date, cast(l.quantity * p.unit_cost as decimal(14,2)) as cost_amount
    from stg_lines l left join dim_store st on st.store_id = l.store_id left join dim_product p on p.product_id = l.product_id and l.event_ts >= p.effective_from_utc and l.event_ts < p.effective_to_utc
    left join dim_customer c on c.customer_id = l.customer_id and l.event_ts >= c.effective_from_utc and l.event_ts < c.effective_to_utc),
fact_inventory as (select cast(('0x' || right(md5(movement_id), 16))::uhugeint as varchar) as inventory_movement_key, cast(strftime(event_ts_local, '%Y%m%d') as int) as date_key, coalesce(st.store_key, '-1') as store_key, coalesce(p.product_key, '-1') as product_key, m.*, cast(event_ts_local as date) as full_date,
    cast(m.quantity_delta * coalesce(m.unit_cost, p.unit_cost) as decimal(14,2)) as movement_value from stg_moves m left join dim_store st on st.store_id = m.store_id left join dim_product p on p.product_id = m.product_id and m.event_ts >= p.effective_from_utc and m.event_ts < p.effective_to_utc),
snap_days as (select cast(d as date) as d from generate_series(timestamp '2026-03-02', timestamp '2026-04-20', interval 1 day) t(d)),
snap_pairs as (select store_id, product_id, min(full_date) as since from fact_inventory group by all),
snap_close as (select * exclude (rn) from (select s.d, f.store_id, f.product_id, f.quantity_on_hand_after as closing, row_number() over (partition by s.d, f.store_id, f.product_id order by f.event_ts desc, f.movement_id desc) as rn from snap_days s join fact_inventory f on f.full_date <= s.d) where rn = 1),
snap_move as (select s.d, f.store_id, f.product_id, sum(case when movement_type = 'RECEIPT' and f.full_date = s.d then quantity_delta else 0 end) as received, sum(case when movement_type = 'SALE' and f.full_date = s.d then -quantity_delta else 0 end) as sold, sum(case when movement_type = 'ADJUSTMENT' and f.full_date = s.d then quantity_delta else 0 end) as adjusted,
    sum(case when movement_type = 'SALE' then -quantity_delta else 0 end) as sold7 from snap_days s join fact_inventory f on f.full_date <= s.d and f.full_date > s.d - 7 group by all),
snapshots as (select cast(strftime(c.d, '%Y%m%d') as int) as date_key, c.d as snapshot_date, coalesce(st.store_key, '-1') as store_key, coalesce(p.product_key, '-1') as product_key, c.store_id, c.product_id, c.closing as closing_on_hand, cast(c.closing * p.unit_cost as decimal(14,2)) as closing_value, coalesce(m.received, 0) as units_received, coalesce(m.sold, 0) as units_sold, coalesce(m.adjusted, 0) as units_adjusted,
    round(coalesce(m.sold7, 0)::double / 7, 6) as avg7, c.closing * 7 < 3 * coalesce(m.sold7, 0) as is_below_reorder_point
    from snap_close c left join snap_move m on m.d = c.d and m.store_id = c.store_id and m.product_id = c.product_id left join dim_store st on st.store_id = c.store_id
    left join dim_product p on p.product_id = c.product_id and p.effective_from_utc < (c.d + 1)::timestamp - interval 8 hour and p.effective_to_utc >= (c.d + 1)::timestamp - interval 8 hour)
"""


def sql(select: str) -> str:
    return f"with {WAREHOUSE_SQL} {select}"


def since(days: int, day: Column | str = "full_date") -> Column:
    return (F.col(day) if isinstance(day, str) else day) >= F.date_sub(F.lit(AS_OF).cast("date"), days)


def dated(w: Warehouse, fact: DataFrame) -> DataFrame:
    """fact with its calendar day; the date dimension prunes by date_key."""
    return fact.join(w.dim_date.select("date_key", "full_date", "day_name", "is_weekend", "year_month"), "date_key")


def exact_mean(value: Column) -> Column:
    """Mean of decimals or integers: one division of an exact sum, so it does not depend on the order of rows."""
    return F.sum(value).cast("double") / F.count(value)


def current_products(w: Warehouse) -> DataFrame:
    return w.dim_product.where("is_current")


def position(w: Warehouse) -> DataFrame:
    """Stock at the latest snapshot date; the date comes from a scalar subquery, so it prunes the scan."""
    s = w.snapshots
    s.createOrReplaceTempView("millrace_snapshots")
    latest = s.sparkSession.sql("select * from millrace_snapshots where date_key = (select max(date_key) from millrace_snapshots)")
    return latest.join(w.dim_store.select("store_key", "store_name", "region"), "store_key").join(w.dim_product.select("product_key", "product_name", "category", "subcategory"), "product_key")


def q01_revenue_30d(w: Warehouse) -> DataFrame:
    return dated(w, w.fact_sales).where(since(30)).agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue_myr"), F.count_distinct("transaction_id").alias("transactions"), F.sum("quantity").alias("units_sold"))


def q02_revenue_by_outlet(w: Warehouse) -> DataFrame:
    by = w.fact_sales.groupBy("store_key").agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue_myr")).join(w.dim_store, "store_key")
    total = Window.partitionBy()
    return by.select("store_id", "store_name", "region", "store_format", "revenue_myr", ratio(F.col("revenue_myr"), F.sum("revenue_myr").over(total)).alias("share_of_total"), F.rank().over(Window.orderBy(F.desc_nulls_last("revenue_myr"))).cast("bigint").alias("revenue_rank"))


def q03_top_products(w: Warehouse) -> DataFrame:
    sold = w.fact_sales.groupBy("product_id").agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue_myr"), F.sum("quantity").alias("units_sold"))
    return sold.join(current_products(w).select("product_id", "product_name"), "product_id").orderBy(F.desc("revenue_myr"), "product_id").limit(20).select("product_id", "product_name", "revenue_myr", "units_sold")


def q04_as_was_as_is(w: Warehouse) -> DataFrame:
    by_key = w.fact_sales.groupBy("product_key", "product_id").agg(F.sum("net_amount").alias("r"))
    total = F.sum("r").cast("decimal(24,2)")
    was = by_key.join(w.dim_product.select("product_key", "category", "subcategory"), "product_key").groupBy("category", "subcategory").agg(total.alias("revenue_as_was"))
    now = by_key.join(current_products(w).select("product_id", "category", "subcategory"), "product_id").groupBy("category", "subcategory").agg(total.alias("revenue_as_is"))
    return was.join(now, ["category", "subcategory"], "full").select("category", "subcategory", "revenue_as_was", "revenue_as_is", (F.coalesce("revenue_as_is", F.lit(0)) - F.coalesce("revenue_as_was", F.lit(0))).cast("decimal(24,2)").alias("restatement_delta"))


def q05_hourly_profile(w: Warehouse) -> DataFrame:
    days = F.count_distinct("date_key")
    return dated(w, w.fact_sales).where(since(28)).groupBy("local_hour").agg(ratio(F.sum("net_amount"), days).alias("avg_revenue_per_day_myr"), ratio(F.count_distinct("transaction_id"), days).alias("avg_transactions_per_day"))


def q06_daily_changes(w: Warehouse) -> DataFrame:
    daily = dated(w, w.fact_sales).groupBy("full_date", "day_name", "is_weekend").agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue"), F.count_distinct("transaction_id").alias("transactions"))
    order = Window.orderBy("full_date")  # one row per calendar day
    change = lambda n: F.try_divide(F.col("revenue").cast("double"), F.lag("revenue", n).over(order).cast("double")) - 1
    return daily.select("full_date", "day_name", "is_weekend", "revenue", "transactions", change(1).alias("dod_change"), change(7).alias("wow_change"))


def q07_moving_average(w: Warehouse) -> DataFrame:
    daily = dated(w, w.fact_sales).join(w.dim_store.select("store_key", "region"), "store_key").groupBy("full_date", "region").agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue"))
    week = Window.partitionBy("region").orderBy("full_date").rowsBetween(-6, 0)
    return daily.select("full_date", "region", "revenue", (F.sum("revenue").over(week).cast("double") / F.count("revenue").over(week)).alias("revenue_7d_moving_avg"))


def q08_weekend_uplift(w: Warehouse) -> DataFrame:
    daily = w.fact_sales.groupBy("store_key", "date_key").agg(F.sum("net_amount").alias("daily_revenue"))
    joined = dated(w, daily).join(w.dim_store.select("store_key", "store_format"), "store_key")
    on, off = exact_mean(F.when(F.col("is_weekend"), F.col("daily_revenue"))), exact_mean(F.when(~F.col("is_weekend"), F.col("daily_revenue")))
    return joined.groupBy("store_format").agg((F.try_divide(on, off) - 1).alias("weekend_uplift"))


def q09_baskets_by_store(w: Warehouse) -> DataFrame:
    baskets = w.fact_sales.groupBy("transaction_id", "store_key").agg(F.sum("net_amount").alias("value"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines"))
    by = baskets.groupBy("store_key").agg(F.count(F.lit(1)).alias("transactions"), exact_mean(F.col("value")).alias("avg_basket_value_myr"), F.median(F.col("value").cast("double")).alias("median_basket_value_myr"), exact_mean(F.col("units")).alias("avg_units_per_basket"), exact_mean(F.col("lines")).alias("avg_lines_per_basket"))
    return by.join(w.dim_store.select("store_key", "store_id", "store_name"), "store_key").drop("store_key")


def q10_baskets_by_payment_tier(w: Warehouse) -> DataFrame:
    baskets = w.fact_sales.groupBy("transaction_id", "payment_method", "customer_key").agg(F.sum("net_amount").alias("value"))  # one of each per transaction
    return baskets.join(w.dim_customer.select("customer_key", "loyalty_tier"), "customer_key").groupBy("payment_method", "loyalty_tier").agg(F.count(F.lit(1)).alias("transactions"), exact_mean(F.col("value")).alias("avg_basket_value_myr"))


def q11_top10_per_category(w: Warehouse) -> DataFrame:
    sold = dated(w, w.fact_sales).where(since(30)).groupBy("product_id").agg(F.sum("quantity").alias("units_sold"), F.sum("net_amount").cast("decimal(24,2)").alias("revenue"))
    named = sold.join(current_products(w).select("product_id", "category", "product_name"), "product_id").select("category", "product_id", "product_name", "units_sold", "revenue")
    return qualify_row_number(named, ["category"], [F.desc("units_sold"), F.asc("product_id")], 10)


def q12_underperformers(w: Warehouse) -> DataFrame:
    active = current_products(w).where("is_active and not is_inferred and product_id not in ('-1', '-2')").select("product_id", "product_name", "category", "subcategory")
    sold = dated(w, w.fact_sales).where(since(30)).groupBy("product_id").agg(F.sum("quantity").alias("units"), F.sum("net_amount").alias("revenue"), F.max("event_ts_local").alias("last_sold_at"))
    ranked = active.join(sold, "product_id", "left").withColumn("units_30d", F.coalesce("units", F.lit(0))).withColumn("decile", F.ntile(10).over(Window.partitionBy("category").orderBy("units_30d", "product_id")))
    return ranked.where("decile = 1").select("product_id", "product_name", "category", "subcategory", "units_30d", F.coalesce("revenue", F.lit(0)).cast("decimal(24,2)").alias("revenue_30d"), F.col("last_sold_at").cast("timestamp_ntz").alias("last_sold_at"))


def q13_price_changes(w: Warehouse) -> DataFrame:
    real = w.dim_product.where("not is_inferred and product_id not in ('-1', '-2')")
    prior = real.withColumn("previous_price", F.lag("list_price").over(Window.partitionBy("product_id").orderBy("version_number")))
    changed = prior.where("previous_price is not null and previous_price <> list_price").select("product_key", "product_id", "previous_price", F.col("list_price").alias("new_price"), "effective_from_utc", "effective_to_utc")
    sold = w.fact_sales.groupBy("product_key").agg(F.sum("quantity").alias("units"))
    days = F.datediff(F.least("effective_to_utc", F.lit(AS_OF).cast("timestamp")), "effective_from_utc")
    return changed.join(sold, "product_key", "left").select("product_id", "previous_price", "new_price", F.col("effective_from_utc").cast("timestamp_ntz").alias("changed_at"), ratio(F.col("units"), days).alias("units_per_day_at_new_price"))


def q14_store_performance(w: Warehouse) -> DataFrame:
    sold = dated(w, w.fact_sales).where(since(30)).groupBy("store_key").agg(F.sum("net_amount").cast("decimal(24,2)").alias("revenue"), F.sum((F.col("net_amount") - F.col("cost_amount")).cast("decimal(14,2)")).cast("double").alias("margin"), F.count_distinct("transaction_id").alias("transactions"), F.count_distinct("date_key").alias("days"))
    by = sold.join(w.dim_store, "store_key")
    region = Window.partitionBy("region")
    per_sqm = ratio(F.col("revenue"), F.col("size_sqm"))
    return by.select("store_id", "store_name", "region", "store_format", "revenue", ratio(F.col("revenue"), F.col("days")).alias("revenue_per_day"), per_sqm.alias("revenue_per_sqm"), ratio(F.col("margin"), F.col("revenue")).alias("gross_margin_pct"), ratio(F.col("revenue"), F.col("transactions")).alias("avg_basket_value"), (F.col("revenue").cast("double") / (F.sum("revenue").over(region).cast("double") / F.count("revenue").over(region)) - 1).alias("vs_region_avg"), F.rank().over(Window.partitionBy("store_format").orderBy(per_sqm.desc_nulls_last())).cast("bigint").alias("productivity_rank_in_format"))


def q15_inventory_position(w: Warehouse) -> DataFrame:
    return position(w).groupBy("region", "store_name", "category").agg(F.sum("closing_on_hand").alias("units_on_hand"), F.sum("closing_value").cast("decimal(24,2)").alias("stock_value_at_cost_myr"))


def q16_low_stock(w: Warehouse) -> DataFrame:
    cover = ratio(F.col("closing_on_hand"), F.col("avg_daily_units_sold_7d"))
    low = position(w).where("is_below_reorder_point").select("store_id", "store_name", "product_id", "product_name", "category", "closing_on_hand", F.col("avg_daily_units_sold_7d").cast("double").alias("avg_daily_units_sold_7d"), cover.alias("days_of_cover"))
    return low.orderBy(F.asc_nulls_first("days_of_cover"), F.desc_nulls_last("avg_daily_units_sold_7d"), "store_id", "product_id").limit(100)


def q17_turnover(w: Warehouse) -> DataFrame:
    rows = w.snapshots.where(since(30, "snapshot_date")).join(current_products(w).select("product_id", "category"), "product_id")
    daily = rows.groupBy("category", "date_key").agg(F.sum("closing_on_hand").alias("on_hand"), F.sum("units_sold").alias("sold"))
    by = daily.groupBy("category").agg(F.sum("sold").alias("units_sold"), exact_mean(F.col("on_hand")).alias("avg_on_hand"))
    turn = F.try_divide(F.col("units_sold").cast("double"), F.col("avg_on_hand"))
    return by.select("category", "units_sold", F.col("avg_on_hand").alias("avg_units_on_hand"), turn.alias("turnover_30d"), F.try_divide(F.lit(30.0), turn).alias("days_of_inventory"))


def q18_movements(w: Warehouse) -> DataFrame:
    return dated(w, w.fact_inventory).where(since(30)).groupBy("movement_type", F.coalesce("reason_code", F.lit("n/a")).alias("reason_code")).agg(F.count(F.lit(1)).alias("movements"), F.sum("quantity_delta").alias("net_units"), F.sum("movement_value").cast("decimal(24,2)").alias("net_value_myr"))


def q19_shrinkage(w: Warehouse) -> DataFrame:
    lost = -F.sum(F.when(F.col("reason_code").isin("DAMAGED", "EXPIRED", "SHRINKAGE"), F.col("quantity_delta")).otherwise(0))
    sold = -F.sum(F.when(F.col("movement_type") == "SALE", F.col("quantity_delta")).otherwise(0))
    by = w.fact_inventory.groupBy("store_key").agg(lost.alias("units_lost"), sold.alias("units_sold"))
    return by.join(w.dim_store.select("store_key", "store_id", "store_name"), "store_key").select("store_id", "store_name", "units_lost", "units_sold", ratio(1000 * F.col("units_lost"), F.col("units_sold")).alias("lost_per_1000_sold"))


def q20_revenue_by_tier(w: Warehouse) -> DataFrame:
    sold = w.fact_sales.join(w.dim_customer.select("customer_key", "loyalty_tier"), "customer_key")
    return sold.groupBy("loyalty_tier").agg(F.count_distinct("transaction_id").alias("transactions"), F.sum("net_amount").cast("decimal(24,2)").alias("revenue_myr"), ratio(F.sum("net_amount"), F.count_distinct("transaction_id")).alias("avg_basket_myr"))


def q21_tier_migrations(w: Warehouse) -> DataFrame:
    real = w.dim_customer.where("not is_inferred and customer_id not in ('-1', '-2')")
    moves = real.withColumn("from_tier", F.lag("loyalty_tier").over(Window.partitionBy("customer_id").orderBy("version_number"))).where("from_tier is not null and from_tier <> loyalty_tier")
    return moves.groupBy(F.date_format("effective_from_utc", "yyyy-MM").alias("month"), "from_tier", F.col("loyalty_tier").alias("to_tier")).agg(F.count(F.lit(1)).alias("customers"))


def q22_guest_share(w: Warehouse) -> DataFrame:
    guest = F.col("customer_key") == NOT_APPLICABLE
    by = w.fact_sales.groupBy("store_key").agg(F.sum(F.when(guest, F.col("net_amount")).otherwise(0)).alias("g"), F.sum("net_amount").alias("t")).join(w.dim_store.select("store_key", "region"), "store_key")
    total = by.groupBy("region").agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    return total.select("region", ratio(F.col("g"), F.col("t")).alias("guest_share"), ratio(F.col("t") - F.col("g"), F.col("t")).alias("member_share"))


def q23_margin(w: Warehouse) -> DataFrame:
    by = w.fact_sales.where("cost_amount is not null").groupBy("date_key", "product_key").agg(F.sum("net_amount").alias("r"), F.sum("cost_amount").alias("c"))
    rows = dated(w, by).join(w.dim_product.select("product_key", "category"), "product_key").groupBy("year_month", "category").agg(F.sum("r").cast("decimal(24,2)").alias("revenue"), F.sum("c").cast("decimal(24,2)").alias("cost"))
    margin = (F.col("revenue") - F.col("cost")).cast("decimal(24,2)")
    return rows.withColumn("gross_margin", margin).withColumn("gross_margin_pct", ratio(F.col("gross_margin"), F.col("revenue")))


def q24_inferred_revenue(w: Warehouse) -> DataFrame:
    by = w.fact_sales.groupBy("product_key").agg(F.count(F.lit(1)).alias("n"), F.sum("net_amount").alias("r")).join(w.dim_product.select("product_key", "is_inferred"), "product_key")
    return by.groupBy("is_inferred").agg(F.sum("n").alias("lines"), F.sum("r").cast("decimal(24,2)").alias("revenue"))


def _windows(w: Warehouse) -> DataFrame:
    return w.raw("store_revenue_5m").where("store_id is not null and window_start is not null")


def d01_top_stores_series(w: Warehouse) -> DataFrame:
    day = _windows(w).where((F.col("window_start") >= F.lit("2026-04-15")) & (F.col("window_start") < F.lit("2026-04-16")))
    top = day.groupBy("store_id").agg(F.sum("revenue").alias("r")).orderBy(F.desc_nulls_last("r"), "store_id").limit(8)
    return day.join(F.broadcast(top.select("store_id")), "store_id", "left_semi").select(F.col("window_start").cast("timestamp_ntz").alias("time"), F.col("store_id").alias("metric"), F.col("revenue").alias("value"))  # 8 rows


def d02_store_table(w: Warehouse) -> DataFrame:
    rows = _windows(w).where(F.col("window_start") >= F.lit(HOUR)).groupBy("store_id").agg(F.sum("revenue").cast("decimal(24,2)").alias("revenue_myr"), F.sum("transactions").alias("transactions"))
    return rows.withColumn("avg_basket_myr", ratio(F.col("revenue_myr"), F.col("transactions"), 2))


def d03_top_products_hour(w: Warehouse) -> DataFrame:
    hour = product_units_1h(w.pos_events).where(F.col("window_start") == F.lit(HOUR).cast("timestamp"))
    return hour.orderBy(F.desc("units"), "product_id").limit(15).select("product_id", "units", F.col("revenue").alias("revenue_myr"))


def d04_revenue_series(w: Warehouse) -> DataFrame:
    return _windows(w).groupBy(F.col("window_start").cast("timestamp_ntz").alias("time")).agg(F.sum("revenue").cast("decimal(24,2)").alias("revenue"))


def wh_dim_product(w: Warehouse) -> DataFrame:
    return w.dim_product.where("product_id not in ('-1', '-2')").select(F.col("product_key").cast("string").alias("product_key"), "product_id", "product_name", "brand", "category", "subcategory", "list_price", "unit_cost", "is_active", F.col("effective_from_utc").cast("timestamp_ntz").alias("effective_from_utc"), F.col("effective_to_utc").cast("timestamp_ntz").alias("effective_to_utc"), "is_current", "is_inferred", "version_number")


def wh_dim_customer(w: Warehouse) -> DataFrame:
    return w.dim_customer.where("customer_id not in ('-1', '-2')").select(F.col("customer_key").cast("string").alias("customer_key"), "customer_id", "loyalty_tier", "home_store_id", "city", "state", "signup_date", "age_band", "marketing_opt_in", "has_email", F.col("effective_from_utc").cast("timestamp_ntz").alias("effective_from_utc"), F.col("effective_to_utc").cast("timestamp_ntz").alias("effective_to_utc"), "is_current", "is_inferred", "version_number")


def wh_fact_sales(w: Warehouse) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return w.fact_sales.select(*map(text, ("sales_line_key", "store_key", "product_key", "customer_key")), "date_key", "transaction_id", "line_number", "payment_method", "local_hour", "quantity", "gross_amount", "net_amount", "cost_amount")


def wh_fact_inventory(w: Warehouse) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return w.fact_inventory.select(*map(text, ("inventory_movement_key", "store_key", "product_key")), "date_key", "movement_id", "movement_type", "quantity_delta", "quantity_on_hand_after", "movement_value")


def wh_snapshots(w: Warehouse) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    return w.snapshots.select("date_key", *map(text, ("store_key", "product_key")), "closing_on_hand", "closing_value", "units_received", "units_sold", "units_adjusted", F.col("avg_daily_units_sold_7d").cast("double").alias("avg7"), "is_below_reorder_point")


def wh_vw_sales(w: Warehouse) -> DataFrame:
    """The sales view: facts with the attributes as they were when sold."""
    f = dated(w, w.fact_sales).join(w.dim_store.select("store_key", "store_name", "region", "store_format"), "store_key").join(w.dim_product.select("product_key", "product_name", "brand", "category", "subcategory", F.col("is_inferred").alias("product_is_inferred")), "product_key").join(w.dim_customer.select("customer_key", "loyalty_tier"), "customer_key")
    return f.select("transaction_id", "line_number", "full_date", "store_id", "region", "product_id", "brand", "category", "product_is_inferred", "loyalty_tier", "quantity", "net_amount", (F.col("net_amount") - F.col("cost_amount")).cast("decimal(14,2)").alias("gross_margin"))


def wh_dim_date(w: Warehouse) -> DataFrame:
    return w.dim_date.where("date_key > 0")


_30 = f"full_date >= date '{AS_OF}' - 30"
_POS = "pos as (select s.*, st.store_name, st.region, p.product_name, p.category from snapshots s join dim_store st on st.store_key = s.store_key join dim_product p on p.product_key = s.product_key where date_key = (select max(date_key) from snapshots))"
SQL = {
    "q01_revenue_30d": sql(f"select cast(sum(net_amount) as decimal(24,2)) as revenue_myr, count(distinct transaction_id) as transactions, cast(sum(quantity) as bigint) as units_sold from fact_sales where {_30}"),
    "q02_revenue_by_outlet": sql("select store_id, store_name, region, store_format, revenue_myr, (revenue_myr::double / sum(revenue_myr) over ()) as share_of_total, rank() over (order by revenue_myr desc) as revenue_rank from (select s.store_id, store_name, region, store_format, cast(sum(net_amount) as decimal(24,2)) as revenue_myr from fact_sales f join dim_store s on s.store_key = f.store_key group by all)"),
    "q03_top_products": sql("select f.product_id, any_value(p.product_name) as product_name, cast(sum(net_amount) as decimal(24,2)) as revenue_myr, cast(sum(quantity) as bigint) as units_sold from fact_sales f join dim_product p on p.product_id = f.product_id and p.is_current group by 1 order by 3 desc, 1 limit 20"),
    "q04_as_was_as_is": sql(", was as (select category, subcategory, sum(net_amount) as r from fact_sales f join dim_product p on p.product_key = f.product_key group by all), now as (select category, subcategory, sum(net_amount) as r from fact_sales f join dim_product p on p.product_id = f.product_id and p.is_current group by all) select coalesce(w.category, n.category) as category, coalesce(w.subcategory, n.subcategory) as subcategory, cast(w.r as decimal(24,2)) as revenue_as_was, cast(n.r as decimal(24,2)) as revenue_as_is, cast(coalesce(n.r, 0) - coalesce(w.r, 0) as decimal(24,2)) as restatement_delta from was w full join now n on n.category = w.category and n.subcategory = w.subcategory"),
    "q05_hourly_profile": sql(f"select cast(local_hour as int) as local_hour, (sum(net_amount)::double / count(distinct date_key)) as avg_revenue_per_day_myr, (count(distinct transaction_id)::double / count(distinct date_key)) as avg_transactions_per_day from fact_sales where full_date >= date '{AS_OF}' - 28 group by 1"),
    "q06_daily_changes": sql(", daily as (select full_date, cast(sum(net_amount) as decimal(24,2)) as revenue, count(distinct transaction_id) as transactions from fact_sales group by 1) select full_date, strftime(full_date, '%a') as day_name, isodow(full_date) >= 6 as is_weekend, revenue, transactions, (revenue::double / lag(revenue) over (order by full_date) - 1) as dod_change, (revenue::double / lag(revenue, 7) over (order by full_date) - 1) as wow_change from daily"),
    "q07_moving_average": sql(", daily as (select full_date, region, cast(sum(net_amount) as decimal(24,2)) as revenue from fact_sales f join dim_store s on s.store_key = f.store_key group by all) select *, cast(sum(revenue) over w as double) / count(*) over w as revenue_7d_moving_avg from daily window w as (partition by region order by full_date rows between 6 preceding and current row)"),
    "q08_weekend_uplift": sql("select store_format, ((sum(r) filter (where isodow(full_date) >= 6))::double / count(*) filter (where isodow(full_date) >= 6)) / ((sum(r) filter (where isodow(full_date) < 6))::double / count(*) filter (where isodow(full_date) < 6)) - 1 as weekend_uplift from (select store_key, full_date, sum(net_amount) as r from fact_sales group by all) x join dim_store s on s.store_key = x.store_key group by 1"),
    "q09_baskets_by_store": sql("select store_id, store_name, count(*) as transactions, sum(v)::double / count(*) as avg_basket_value_myr, median(v::double) as median_basket_value_myr, sum(u)::double / count(*) as avg_units_per_basket, sum(n)::double / count(*) as avg_lines_per_basket from (select transaction_id, store_key, sum(net_amount) as v, sum(quantity) as u, count(*) as n from fact_sales group by all) b join dim_store s on s.store_key = b.store_key group by all"),
    "q10_baskets_by_payment_tier": sql("select payment_method, loyalty_tier, count(*) as transactions, sum(v)::double / count(*) as avg_basket_value_myr from (select transaction_id, max(payment_method) as payment_method, max(customer_key) as customer_key, sum(net_amount) as v from fact_sales group by 1) b join dim_customer_all c on c.customer_key = b.customer_key group by all"),
    "q11_top10_per_category": sql(f"select category, f.product_id, product_name, cast(sum(quantity) as bigint) as units_sold, cast(sum(net_amount) as decimal(24,2)) as revenue from fact_sales f join dim_product p on p.product_id = f.product_id and p.is_current where {_30} group by 1, 2, 3 qualify row_number() over (partition by category order by sum(quantity) desc, f.product_id) <= 10"),
    "q12_underperformers": sql(f", s as (select product_id, sum(quantity) as u, sum(net_amount) as r, max(event_ts_local) as last_sold_at from fact_sales where {_30} group by 1) select * exclude (decile) from (select p.product_id, product_name, category, subcategory, cast(coalesce(u, 0) as bigint) as units_30d, cast(coalesce(r, 0) as decimal(24,2)) as revenue_30d, last_sold_at, ntile(10) over (partition by category order by coalesce(u, 0), p.product_id) as decile from dim_product p left join s on s.product_id = p.product_id where is_current and is_active and not is_inferred) where decile = 1"),
    "q13_price_changes": sql(f", v as (select *, lag(list_price) over (partition by product_id order by version_number) as previous_price from dim_product where not is_inferred), s as (select product_key, sum(quantity) as u from fact_sales group by 1) select product_id, previous_price, list_price as new_price, effective_from_utc as changed_at, (u::double / nullif(date_diff('day', effective_from_utc::date, least(effective_to_utc, timestamp '{AS_OF}')::date), 0)) as units_per_day_at_new_price from v left join s on s.product_key = v.product_key where previous_price <> list_price"),
    "q14_store_performance": sql(f", x as (select s.store_id, store_name, region, store_format, size_sqm, cast(sum(net_amount) as decimal(24,2)) as revenue, sum(net_amount - cost_amount)::double as margin, count(distinct transaction_id) as t, count(distinct date_key) as d from fact_sales f join dim_store s on s.store_key = f.store_key where {_30} group by all) select store_id, store_name, region, store_format, revenue, revenue::double / d as revenue_per_day, revenue::double / nullif(size_sqm, 0) as revenue_per_sqm, margin / nullif(revenue::double, 0) as gross_margin_pct, revenue::double / t as avg_basket_value, revenue::double / (cast(sum(revenue) over (partition by region) as double) / count(*) over (partition by region)) - 1 as vs_region_avg, rank() over (partition by store_format order by revenue::double / nullif(size_sqm, 0) desc nulls last) as productivity_rank_in_format from x"),
    "q15_inventory_position": sql(f", {_POS} select region, store_name, category, cast(sum(closing_on_hand) as bigint) as units_on_hand, cast(sum(closing_value) as decimal(24,2)) as stock_value_at_cost_myr from pos group by all"),
    "q16_low_stock": sql(f", {_POS} select store_id, store_name, product_id, product_name, category, closing_on_hand, avg7 as avg_daily_units_sold_7d, (closing_on_hand::double / nullif(avg7, 0)) as days_of_cover from pos where is_below_reorder_point order by days_of_cover nulls first, avg7 desc, store_id, product_id limit 100"),
    "q17_turnover": sql(f", d as (select category, date_key, sum(closing_on_hand) as h, sum(units_sold) as s from snapshots sn join dim_product p on p.product_id = sn.product_id and p.is_current where snapshot_date >= date '{AS_OF}' - 30 group by all) select category, cast(sum(s) as bigint) as units_sold, sum(h)::double / count(*) as avg_units_on_hand, sum(s)::double / (sum(h)::double / count(*)) as turnover_30d, 30.0::double / nullif(sum(s)::double / nullif(sum(h)::double / count(*), 0), 0) as days_of_inventory from d group by 1"),
    "q18_movements": sql(f"select movement_type, coalesce(reason_code, 'n/a') as reason_code, count(*) as movements, cast(sum(quantity_delta) as bigint) as net_units, cast(sum(movement_value) as decimal(24,2)) as net_value_myr from fact_inventory where {_30} group by all"),
    "q19_shrinkage": sql(", x as (select s.store_id, store_name, cast(-sum(case when reason_code in ('DAMAGED','EXPIRED','SHRINKAGE') then quantity_delta else 0 end) as bigint) as units_lost, cast(-sum(case when movement_type = 'SALE' then quantity_delta else 0 end) as bigint) as units_sold from fact_inventory f join dim_store s on s.store_key = f.store_key group by all) select *, (1000 * units_lost::double / nullif(units_sold, 0)) as lost_per_1000_sold from x"),
    "q20_revenue_by_tier": sql("select loyalty_tier, count(distinct transaction_id) as transactions, cast(sum(net_amount) as decimal(24,2)) as revenue_myr, (sum(net_amount)::double / count(distinct transaction_id)) as avg_basket_myr from fact_sales f join dim_customer_all c on c.customer_key = f.customer_key group by 1"),
    "q21_tier_migrations": sql(", t as (select effective_from_utc as f, loyalty_tier as to_tier, lag(loyalty_tier) over (partition by customer_id order by version_number) as from_tier from dim_customer where not is_inferred) select strftime(f, '%Y-%m') as month, from_tier, to_tier, count(*) as customers from t where from_tier <> to_tier group by all"),
    "q22_guest_share": sql("select region, (g::double / t) as guest_share, ((t - g)::double / t) as member_share from (select region, sum(case when customer_key = '-2' then net_amount else 0 end) as g, sum(net_amount) as t from fact_sales f join dim_store s on s.store_key = f.store_key group by 1)"),
    "q23_margin": sql("select strftime(full_date, '%Y-%m') as year_month, category, cast(sum(net_amount) as decimal(24,2)) as revenue, cast(sum(cost_amount) as decimal(24,2)) as cost, cast(sum(net_amount - cost_amount) as decimal(24,2)) as gross_margin, (sum(net_amount - cost_amount)::double / sum(net_amount)::double) as gross_margin_pct from fact_sales f join dim_product p on p.product_key = f.product_key where cost_amount is not null group by all"),
    "q24_inferred_revenue": sql("select is_inferred, count(*) as lines, cast(sum(net_amount) as decimal(24,2)) as revenue from fact_sales f join dim_product p on p.product_key = f.product_key group by 1"),
    "d01_top_stores_series": "with d as (select * from store_revenue_5m where window_start >= timestamp '2026-04-15' and window_start < timestamp '2026-04-16') select window_start as time, store_id as metric, revenue as value from d where store_id in (select store_id from d group by 1 order by sum(revenue) desc, 1 limit 8)",
    "d02_store_table": f"select store_id, cast(sum(revenue) as decimal(24,2)) as revenue_myr, cast(sum(transactions) as bigint) as transactions, case when sum(transactions) <> 0 then ((cast(sum(revenue) * 200 as hugeint) + cast(sum(transactions) as hugeint)) // (2 * cast(sum(transactions) as hugeint)))::double / 100 end as avg_basket_myr from store_revenue_5m where window_start >= timestamp '{HOUR}' group by 1",
    "d03_top_products_hour": sql(f"select l.product_id as product_id, cast(sum(l.quantity) as bigint) as units, cast(sum(l.quantity * l.unit_price - coalesce(l.discount_amount, 0)) as decimal(14,2)) as revenue_myr from raw_lines where event_ts >= timestamp '{HOUR}' and event_ts < timestamp '{HOUR}' + interval 1 hour and l.product_id is not null group by 1 order by 2 desc, 1 limit 15"),
    "d04_revenue_series": "select window_start as time, cast(sum(revenue) as decimal(24,2)) as revenue from store_revenue_5m group by 1",
    "wh_dim_product": sql("select product_key, product_id, product_name, brand, category, subcategory, list_price, unit_cost, is_active, effective_from_utc, effective_to_utc, is_current, is_inferred, cast(version_number as int) as version_number from dim_product"),
    "wh_dim_customer": sql("select customer_key, customer_id, loyalty_tier, home_store_id, city, state, signup_date, age_band, marketing_opt_in, has_email, effective_from_utc, effective_to_utc, is_current, is_inferred, cast(version_number as int) as version_number from dim_customer"),
    "wh_fact_sales": sql("select sales_line_key, store_key, product_key, customer_key, date_key, transaction_id, line_number, payment_method, cast(local_hour as int) as local_hour, quantity, gross_amount, net_amount, cost_amount from fact_sales"),
    "wh_fact_inventory": sql("select inventory_movement_key, store_key, product_key, date_key, movement_id, movement_type, quantity_delta, quantity_on_hand_after, movement_value from fact_inventory"),
    "wh_snapshots": sql("select date_key, store_key, product_key, closing_on_hand, closing_value, cast(units_received as bigint) as units_received, cast(units_sold as bigint) as units_sold, cast(units_adjusted as bigint) as units_adjusted, avg7, is_below_reorder_point from snapshots"),
    "wh_vw_sales": sql("select f.transaction_id, f.line_number, full_date, f.store_id, region, f.product_id, p.brand, p.category, p.is_inferred as product_is_inferred, loyalty_tier, quantity, net_amount, cast(net_amount - cost_amount as decimal(14,2)) as gross_margin from fact_sales f join dim_store s on s.store_key = f.store_key join dim_product p on p.product_key = f.product_key join dim_customer_all c on c.customer_key = f.customer_key"),
    "wh_dim_date": "select cast(strftime(d, '%Y%m%d') as int) as date_key, d as full_date, cast(isodow(d) as int) as day_of_week_iso, strftime(d, '%a') as day_name, cast(day(d) as int) as day_of_month, cast(dayofyear(d) as int) as day_of_year, cast(weekofyear(d) as int) as iso_week, cast(month(d) as int) as month_number, strftime(d, '%b') as month_name, strftime(d, '%Y-%m') as year_month, cast(quarter(d) as int) as quarter, cast(year(d) as int) as year, isodow(d) >= 6 as is_weekend, strftime(d, '%m-%d') in ('01-01','05-01','08-31','09-16','12-25') as is_public_holiday, case strftime(d, '%m-%d') when '01-01' then 'New Year''s Day' when '05-01' then 'Labour Day' when '08-31' then 'National Day' when '09-16' then 'Malaysia Day' when '12-25' then 'Christmas Day' end as holiday_name from (select cast(d as date) as d from generate_series(timestamp '2020-01-01', timestamp '2030-12-31', interval 1 day) t(d))",
}
FUNCTIONS: list[Callable[[Warehouse], DataFrame]] = [globals()[name] for name in SQL]


def _query(f: Callable[[Warehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Warehouse(spark, sf_dir))


QUERIES = {f.__name__: _query(f) for f in FUNCTIONS}
