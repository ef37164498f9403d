"""The queries p1, p8, p9 and p10, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import packing, residue, together, tokenizer
from millrace.plans.general import surplus_sales, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "pos_transactions")
    items = sales.select("record_id", F.transform("payload.line_items", lambda x: x["product_id"]).alias("items"))
    kept = items.where("items is not null").join(surplus_sales(sales), "record_id", "left_anti")
    return together.association(together.baskets(kept, F.col("items")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together.associated(_pairs(spark, sf_dir), least=5, share=500, ratio=3).select("product_id_a", "product_id_b")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of products bought together, with its counts and lift."""
    pairs = _pairs(spark, sf_dir)
    return pairs.withColumn("lift", together.lift(pairs))


def p1_store_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that the same stores sell: a basket is all a store sold, hundreds of products, so pairs are made by blocks."""
    sales = table(spark, sf_dir, "pos_transactions")
    kept = sales.join(surplus_sales(sales), "record_id", "left_anti").where("payload.store_id is not null")
    sold = kept.select(F.col("payload.store_id").alias("store_id"), F.explode(F.transform("payload.line_items", lambda x: x["product_id"])).alias("item")).where("item is not null").distinct()
    stores = sold.groupBy("store_id").agg(F.collect_set("item").alias("items"))  # at most the catalogue each
    pairs = together.association(together.baskets(stores, F.col("items")))
    return pairs.withColumn("lift", together.lift(pairs))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {r.spec_id: r.capacity_tokens for r in table(spark, sf_dir, "container_specs").where("spec_id is not null and capacity_tokens > 0").collect()}  # the specification: 3 rows, fixed
    return packing.pack(tokenizer.count_tokens(table(spark, sf_dir, "documents")), specs)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_store_pairs, p8_ids, p9_containers, p10_found)}

_BASKETS = """(select record_id, list_distinct(list_filter(list_transform(payload.line_items, lambda x: x.product_id), lambda x: x is not null)) as items from pos_transactions where record_id not in (
    select record_id from (select record_id, metadata.event_id is not null and record_id > min(record_id) over (partition by metadata.event_id) as e,
        payload.transaction_id is not null and record_id > min(record_id) over (partition by payload.transaction_id) as b from pos_transactions) where e or b))"""
_PAIRS = f"""with baskets as (select record_id, items from {_BASKETS} where len(items) > 0), lines as (select record_id, unnest(items) as p from baskets),
    n as (select count(*) as n from baskets), c as (select p, count(*) as k from lines group by p),
    pairs as (select x.p as a, y.p as b, count(*) as n_ab from lines x join lines y on x.record_id = y.record_id and x.p < y.p group by all)"""
_SHOPS = "lines as (select distinct payload.store_id as record_id, x.product_id as p from (select payload, unnest(payload.line_items) as x from kept) where x.product_id is not null and payload.store_id is not null), n as (select count(distinct record_id) as n from lines)"
_KEPT = """kept as (select * from pos_transactions where record_id not in (
    select record_id from (select record_id, metadata.event_id is not null and record_id > min(record_id) over (partition by metadata.event_id) as e,
        payload.transaction_id is not null and record_id > min(record_id) over (partition by payload.transaction_id) as b from pos_transactions) where e or b))"""
_COUNTED = "c as (select p, count(*) as k from lines group by p), pairs as (select x.p as a, y.p as b, count(*) as n_ab from lines x join lines y on x.record_id = y.record_id and x.p < y.p group by all)"
SQL = {
    "p1_store_pairs": f"with {_KEPT}, {_SHOPS}, {_COUNTED} select a as product_id_a, b as product_id_b, n_ab, ca.k as n_a, cb.k as n_b, n, n_ab::double * n / (ca.k::double * cb.k) as lift from pairs join c ca on a = ca.p join c cb on b = cb.p, n",
    "p1_found": f"{_PAIRS} select a as product_id_a, b as product_id_b from pairs join c ca on a = ca.p join c cb on b = cb.p, n where n_ab >= 5 and n_ab * 500 >= n and n_ab::hugeint * n >= 3::hugeint * ca.k * cb.k",
    "p1_pairs": f"{_PAIRS} select a as product_id_a, b as product_id_b, n_ab, ca.k as n_a, cb.k as n_b, n, n_ab::double * n / (ca.k::double * cb.k) as lift from pairs join c ca on a = ca.p join c cb on b = cb.p, n",
}
