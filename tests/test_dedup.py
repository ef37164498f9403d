import random

import numpy as np
import pyarrow as pa

from millrace.operators import dedup

from .conftest import rows

SCHEMA = "record_id bigint, a string, b string, extra int"


def brute(data):
    out = set()
    for which in (1, 2):
        first = {}
        for r in sorted(data):
            if r[which] is not None:
                if r[which] in first:
                    out.add(r[0])
                first.setdefault(r[which], r[0])
    return out


def test_surplus_equals_brute_force(spark):
    rng = random.Random(1)
    ids = [None, "", "x", "X", "x ", "é", "0" * 7, "0" * 8, "0" * 9, "0" * 16, "0" * 17, "\0", "\0\0", "0f8fad5b-d9cb-469f-a165-70867728950e", "0F8FAD5B-D9CB-469F-A165-70867728950E", "0f8fad5bd9cb469fa16570867728950e", "long" * 50, "long" * 50 + "\0"]
    data = [(i, rng.choice(ids), rng.choice(ids) if rng.random() < 0.5 else f"k{rng.randrange(40)}", i) for i in range(300)]
    got = {r[0] for r in dedup.surplus(spark.createDataFrame(data, SCHEMA), "record_id", ["a", "b"]).collect()}
    assert got == brute(data)


def test_hot_identifier_keeps_one(spark):
    df = spark.range(10_000).selectExpr("id as record_id", "case when id % 3 = 0 then 'hot' end as a", "cast(null as string) as b")
    got = dedup.surplus(df, "record_id", ["a", "b"])
    assert got.count() == 3333 and got.where("record_id = 0").isEmpty()


def test_keep_first_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "p", None, 5), (2, "p", "q", 6), (3, None, None, 7)], SCHEMA)
    kept = dedup.keep_first(df, "record_id", ["a", "b"])
    assert kept.columns == df.columns and rows(kept) == [(1, "p", None, 5), (3, None, None, 7)]
    assert dedup.surplus(df.where("false"), "record_id", ["a", "b"]).isEmpty()


def test_admit_over_batches(spark):
    one = spark.createDataFrame([(1, "p", "t1", 0), (2, "p", "t2", 0), (3, "q", None, 0)], SCHEMA)
    two = spark.createDataFrame([(4, "q", "t9", 0), (5, "r", "t2", 0), (6, "s", "t5", 0), (7, "s", None, 0)], SCHEMA)
    kept, seen = dedup.admit(one, None, "record_id", ["a", "b"])
    assert [r.record_id for r in kept.orderBy("record_id").collect()] == [1, 3]
    kept, seen = dedup.admit(two, seen, "record_id", ["a", "b"])
    assert [r.record_id for r in kept.collect()] == [6]
    assert seen.count() == seen.distinct().count() == 8


IDS = [f"{i:x}" for i in range(3000)] + [f"{'a' * 15}{i}" for i in range(3000)] + [f"{i:032x}" for i in range(3000)] + [f"{'b' * 31}{i}" for i in range(300)] + [f"{i:08x}-0000-4000-8000-{i:012x}" for i in range(300)]


def test_packing_is_exact():
    words, width, tails = dedup.pack(pa.array(IDS))
    assert len({(*map(int, w), int(n), t) for w, n, t in zip(words, width, tails)}) == len(set(IDS))
    again = dedup.pack(pa.array(["x", *IDS], pa.string())[1:])
    assert (again[0] == words).all() and (again[1] == width).all() and (again[2] == tails).all()
    assert len(dedup.pack(pa.array([], pa.string()))[1]) == 0 and dedup.pack(pa.array(["", ""]))[1].tolist() == [0, 0]


def table_rows(ids):
    words, width, tails = dedup.pack(pa.array(ids))
    return np.column_stack([words, dedup._with_kind(0, width)]), tails


def test_table_refuses_all_but_the_smallest_order():
    rng = random.Random(3)
    ids, orders = [rng.choice(IDS[:200] + IDS[-20:] + IDS[9100:9120]) for _ in range(4000)], list(range(4000))
    rng.shuffle(orders)
    table, refused = dedup.QuotientTable(), []
    for at in range(0, 4000, 170):
        key, tails = table_rows(ids[at : at + 170])
        refused += table.insert(key, tails, np.array(orders[at : at + 170])).tolist()
    first = {}
    for i, o in zip(ids, orders):
        first[i] = min(o, first.get(i, o))
    assert sorted(refused) == sorted(set(orders) - set(first.values())) and table.size == len(first)
    assert sorted(table.entries()[2].tolist()) == sorted(first.values())


def test_equal_quotients_do_not_match():
    key = np.zeros((6, 5), np.uint64)
    key[:, 1] = [1, 2, 3, 1, 2, 4]
    table = dedup.QuotientTable()
    assert sorted(table.insert(key, None, np.arange(6)).tolist()) == [3, 4] and table.size == 4


def test_small_tables_give_the_same(spark, monkeypatch):
    """Tables are emptied and dropped many times: memory is bounded, the result is not changed."""
    monkeypatch.setattr(dedup, "TABLE_ROWS", 50)
    df = spark.range(4000).selectExpr("id as record_id", "cast(id % 1300 as string) as a", "concat('k', cast(id % 1700 as string)) as b").repartition(5)
    got = {r[0] for r in dedup.surplus(df, "record_id", ["a", "b"]).collect()}
    assert got == {i for i in range(4000) if i >= 1300}
