import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from millrace.llm import together


def brute(baskets):
    baskets = [sorted({x for x in b if x is not None}) for b in baskets if b is not None]
    baskets = [b for b in baskets if b]
    items = Counter(x for b in baskets for x in b)
    pairs = Counter(p for b in baskets for p in combinations(b, 2))
    return {(a, b, k, items[a], items[b], len(baskets)) for (a, b), k in pairs.items()}


def got(spark, baskets, chunk=together.CHUNK):
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n int")
    return {tuple(r) for r in together.association(together.baskets(df, F.col("items")), chunk).collect()}


def test_equals_brute_force_for_any_chunk(spark):
    rng = random.Random(1)
    baskets = [[rng.choice(["a", "b", "C", "", "é", None, *map(str, range(20))]) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))] for _ in range(120)] + [None, [None], ["a", "a"]]
    want = brute(baskets)
    for chunk in (1, 2, 5, 256):
        assert got(spark, baskets, chunk) == want, chunk


def test_hot_item_and_huge_basket(spark):
    baskets = [["hot", f"i{k % 7}"] for k in range(900)] + [[f"x{k}" for k in range(700)]]
    out = got(spark, baskets, 64)
    assert len(out) == 7 + 700 * 699 // 2 and out == brute(baskets)


def test_empty(spark):
    assert got(spark, []) == set() and got(spark, [["a"], []]) == set()


def test_thresholds_are_exact(spark):
    df = spark.createDataFrame([("a", "b", 5, 5, 5, 2500), ("a", "c", 5, 5, 5, 2501), ("a", "d", 4, 4, 4, 100), ("a", "e", 6, 10, 10, 50), ("a", "f", 6, 10, 10, 49), ("a", "g", 3_000_000_001, 10**10, 10**10, 10**11)], "product_id_a string, product_id_b string, n_ab bigint, n_a bigint, n_b bigint, n bigint")
    kept = {r.product_id_b for r in together.associated(df, 5, 500, 3).collect()}
    assert kept == {"b", "e", "g"}


def test_shuffled_item_counts(spark, monkeypatch):
    baskets = [["a", "b"], ["a", "b", "c"]]
    monkeypatch.setattr("millrace.session.BROADCAST_BYTES", -1)
    assert got(spark, baskets) == brute(baskets)
