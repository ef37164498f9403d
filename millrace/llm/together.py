"""Items that appear together: exact pair counts over baskets of any size, and their association.

A basket of up to CHUNK distinct items gives its pairs where it is read. A larger one is cut into chunks of CHUNK items;
every pair of chunks (also a chunk with itself) becomes a row of its own, and these rows are spread over the tasks by
basket and chunk numbers (equal baskets do not meet), so one basket with n items costs n / CHUNK shuffled copies of itself
and its pairs are made in parallel. All pairs are combined map-side before they are shuffled; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import broadcastable, cut, written

#: Largest basket that is paired in one piece.
CHUNK = 256


def baskets(records: DataFrame, items: Column) -> DataFrame:
    """One column, items: distinct, not null, sorted. Records without any item (or null items) are no baskets."""
    return records.select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items")).where("size(items) > 0")


def pair_rows(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b with a < b, once per basket and pair. found should be written: a basket is known by its place in it."""
    small = found.where(F.size("items") <= chunk)
    ordinary = small.select("items", F.posexplode("items").alias("p", "a")).select("a", F.explode(F.slice("items", F.col("p") + 2, F.greatest(F.size("items") - F.col("p") - 1, F.lit(0)))).alias("b"))
    large = found.where(F.size("items") > chunk)
    count = F.ceil(F.size("items") / chunk).cast("int")
    cut_up = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(F.col("items"), k * chunk + 1, F.lit(chunk)))
    pieces = large.select(F.monotonically_increasing_id().alias("basket"), cut_up.alias("pieces"))
    products = pieces.select("basket", "pieces", F.posexplode("pieces").alias("i", "left")).select("basket", "i", "left", F.posexplode(F.slice("pieces", F.col("i") + 1, F.size("pieces") - F.col("i"))).alias("j", "right"))
    blocked = products.repartition("basket", "i", "j").select("right", F.explode("left").alias("a")).select("a", F.explode("right").alias("b")).where("a < b")
    return ordinary.unionByName(blocked)


def association(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """product_id_a, product_id_b, n_ab, n_a, n_b, n (baskets): every pair that shares a basket.

    found: column items as of baskets(). A basket counts once per pair, however often it repeats an item; equal baskets
    each count. No baskets: no rows.
    """
    found = written(found, "baskets")
    # Null stands for the basket itself, so one pass gives each item's count and the number of baskets.
    counts = cut(found.select(F.explode(F.concat("items", F.array(F.lit(None).cast("string")))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    total = counts.where("item is null").select("n").first()
    n = total.n if total else 0
    items = counts.where("item is not null")
    small = broadcastable(items)
    side = lambda c: (F.broadcast if small else (lambda d: d))(items.select(F.col("item").alias(f"product_id_{c}"), F.col("n").alias(f"n_{c}")))
    pairs = pair_rows(found, chunk).groupBy(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b")).agg(F.count(F.lit(1)).alias("n_ab"))
    out = pairs.join(side("a"), "product_id_a").join(side("b"), "product_id_b").withColumn("n", F.lit(n).cast("bigint"))
    return out.select("product_id_a", "product_id_b", "n_ab", "n_a", "n_b", "n")


def lift(pairs: DataFrame) -> Column:
    """How much more often than chance: n_ab * n / (n_a * n_b)."""
    return F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))


def associated(pairs: DataFrame, least: int, share: int, ratio: int) -> DataFrame:
    """Pairs with n_ab >= least, n_ab * share >= n and n_ab * n >= ratio * n_a * n_b, in exact arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where((F.col("n_ab") >= least) & (wide("n_ab") * share >= wide("n")) & (wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(ratio).cast("decimal(3,0)")))
