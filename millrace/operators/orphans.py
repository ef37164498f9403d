"""References to records that do not exist, hold only later or are withdrawn.

Parent and child keys are united in long form, tagged, combined per parent table and key (map-side, so hot keys are one
row per task); groups without parent flag, or whose children reach outside the parent's life, give spans of time in
which a reference is bad. Child rows are then matched with these spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.clock import micros, rfc3339
from millrace.operators.ordered import with_neighbours
from millrace.session import broadcastable, cut

PRODUCTS, CUSTOMERS, STORES = "product_updates", "customer_events", "store_reference"
#: Bounds of time, in microseconds.
BEGIN, END = -(1 << 62), 1 << 62
#: Parts per key in which children are joined with spans that are not broadcast.
SALTS = 16
DAY_US = 86_400_000_000


def customer_key(text: Column) -> Column:
    """Trimmed capitals; null for a guest (null or blank)."""
    key = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def references(sales: DataFrame) -> DataFrame:
    """Long form of the children: record_id, ref_table, ref_id, t (microseconds); each reference once per record.

    Records without a readable event_timestamp are not checked. Null ids are no reference; a blank product or store id is one.
    """
    t = micros(rfc3339(F.col("metadata.event_timestamp")))
    products = F.array_distinct(F.filter(F.transform("payload.line_items", lambda x: x["product_id"]), lambda x: x.isNotNull()))
    ref = lambda table, ident: F.struct(F.lit(table).alias("ref_table"), ident.alias("ref_id"))
    every = F.concat(F.transform(F.coalesce(products, F.array().cast("array<string>")), lambda p: ref(PRODUCTS, p)), F.array(ref(CUSTOMERS, customer_key(F.col("payload.customer_id"))), ref(STORES, F.col("payload.store_id"))))
    rows = sales.select("record_id", t.alias("t"), every.alias("refs")).where("t is not null")
    return rows.select("record_id", "t", F.explode("refs").alias("r")).select("record_id", "r.ref_table", "r.ref_id", "t").where("ref_id is not null")


def parents(products: DataFrame, customers: DataFrame, stores: DataFrame) -> DataFrame:
    """Tagged parent keys: ref_table, ref_id, first (when it is first known). Unreadable event times say nothing."""
    ts = micros(rfc3339(F.col("metadata.event_timestamp")))
    tag = lambda df, table, ident, first: df.select(F.lit(table).alias("ref_table"), ident.alias("ref_id"), first.alias("first")).where("ref_id is not null and first is not null")
    return tag(products, PRODUCTS, F.col("payload.product_id"), ts).unionByName(tag(customers, CUSTOMERS, customer_key(F.col("payload.customer_id")), ts)).unionByName(tag(stores, STORES, F.col("store_id"), F.lit(BEGIN).cast("bigint")))


def withdrawn(products: DataFrame) -> DataFrame:
    """Spans [low, high) in which the latest record of a product (ties: greater record_id) says is_active = false."""
    ts = micros(rfc3339(F.col("metadata.event_timestamp")))
    rows = products.select(F.col("payload.product_id").alias("ref_id"), ts.alias("t"), "record_id", F.coalesce("payload.is_active", F.lit(True)).alias("live")).where("ref_id is not null and t is not null")
    rows = rows.withColumn("chunk", F.floor(F.col("t") / DAY_US))
    rows = with_neighbours(rows, ["ref_id"], "chunk", ["t", "record_id"], F.struct("t"), after="next")
    return rows.where("not live").select(F.lit(PRODUCTS).alias("ref_table"), "ref_id", F.col("t").alias("low"), F.coalesce("next.t", F.lit(END)).cast("bigint").alias("high")).where("low < high")


def bad_spans(refs: DataFrame, known: DataFrame, gone: DataFrame) -> DataFrame:
    """Disjoint spans [low, high) per ref_table and ref_id in which a reference made by some child is bad."""
    child = refs.groupBy("ref_table", "ref_id").agg(F.min("t").alias("child_first"), F.max("t").alias("child_last")).withColumn("first", F.lit(None).cast("bigint"))
    parent = known.groupBy("ref_table", "ref_id").agg(F.min("first").alias("first")).select("ref_table", "ref_id", F.lit(None).cast("bigint").alias("child_first"), F.lit(None).cast("bigint").alias("child_last"), "first")
    both = child.unionByName(parent).groupBy("ref_table", "ref_id").agg(F.max("child_first").alias("child_first"), F.max("child_last").alias("child_last"), F.max("first").alias("first"))
    early = both.where("child_first is not null and (first is null or child_first < first)").select("ref_table", "ref_id", F.lit(BEGIN).cast("bigint").alias("low"), F.coalesce("first", F.lit(END)).cast("bigint").alias("high"))
    return early.unionByName(gone)


def orphans(refs: DataFrame, known: DataFrame, gone: DataFrame) -> DataFrame:
    """The children with a bad reference: record_id, ref_table, ref_id, t.

    Spans of one key are disjoint, so each child comes out at most once per reference. With few spans (checked) they are
    broadcast and child rows are not shuffled; otherwise each key is joined in SALTS parts, so a hot key is split.
    """
    spans = cut(bad_spans(refs, known, gone))
    inside = (F.col("t") >= F.col("low")) & (F.col("t") < F.col("high"))
    if broadcastable(spans):
        found = refs.join(F.broadcast(spans), ["ref_table", "ref_id"]).where(inside)
    else:
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = refs.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(salted, ["ref_table", "ref_id", "salt"]).where(inside)
    return found.select("record_id", "ref_table", "ref_id", "t")


def orphan_report(found: DataFrame) -> DataFrame:
    """ref_table, period (UTC day), references, distinct_ids."""
    day = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd")
    per_key = found.groupBy("ref_table", day.alias("period"), "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "period").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_ids"))
