import random

from pyspark.sql import functions as F

from millrace.operators import asof


def brute(events, versions):
    out = {}
    for e in events:
        hits = [v for v in versions if v[0] is not None and v[0] == e[1] and e[2] is not None and v[1] is not None and v[2] is not None and v[1] <= e[2] < v[2]]
        out[e[0]] = max(hits, key=lambda v: (v[1], v[3]))[3] if hits else None
    return out


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    unit = 1 << 20
    for leaf_bits in (4, 18, 32):
        events = [(i, rng.choice(["a", "b", "c", None, "hot", "hot", "hot"]), rng.choice([None, *[rng.randrange(-5 * unit, 40 * unit) for _ in range(9)]])) for i in range(400)]
        versions = []
        for k in range(120):
            low = rng.randrange(-50 * unit, 45 * unit)
            versions.append((rng.choice(["a", "b", "hot", "d", None]), rng.choice([low, low, None]), low + rng.choice([-5, 0, 1, 7, unit, 9 * unit, 900 * unit]), k))
        versions += [("c", -(1 << 60), 1 << 60, 500), ("a", events[0][2] or 0, (events[0][2] or 0) + 1, 501)]
        e = spark.createDataFrame(events, "id int, entity string, at bigint").withColumn("version_no", F.lit("clash"))
        v = spark.createDataFrame(versions, "entity string, low bigint, high bigint, version_no int").withColumn("at", F.lit(0))
        if leaf_bits == 18:  # nothing is broadcast
            monkeypatch.setattr(asof, "BROADCAST_NODES", -1)
        got = asof.attach_as_of(e, v, "entity", "at", "low", "high", ["version_no"], ["low", "version_no"], ["id"], leaf_bits)
        assert got.columns == ["id", "entity", "at", "version_no", "version"]
        assert {r.id: r.version.version_no if r.version else None for r in got.collect()} == brute(events, versions), leaf_bits


def test_empty_sides(spark):
    e = spark.createDataFrame([(1, "a", 5)], "id int, entity string, at bigint")
    v = spark.createDataFrame([("a", 0, 9, 1)], "entity string, low bigint, high bigint, n int")
    call = lambda a, b: asof.attach_as_of(a, b, "entity", "at", "low", "high", ["n"], ["low"], ["id"])
    assert call(e, v).first().version.n == 1
    assert call(e, v.where("false")).first().version is None
    assert call(e.where("false"), v).isEmpty()


def test_nodes_cover_exactly(spark):
    v = spark.createDataFrame([(a, b) for a in range(17) for b in range(17)], "a bigint, b bigint")
    nodes = asof.dyadic_nodes(v, F.col("a"), F.col("b"), 0, 0, 5).collect()
    cover = {}
    for r in nodes:
        for x in range(r.node << r.level, (r.node + 1) << r.level):
            assert (r.a, r.b, x) not in cover
            cover[r.a, r.b, x] = 1
    assert set(cover) == {(a, b, x) for a in range(17) for b in range(17) for x in range(a, b) if x < 16}
    most = {}
    for r in nodes:
        most[r.a, r.b] = most.get((r.a, r.b), 0) + 1
    assert max(most.values()) <= 8


def test_every_row_comes_out(spark):
    e = spark.createDataFrame([(1, "a", 5, "x"), (1, "a", 5, "y"), (1, "a", 5, "y"), (1, "a", 7, "z"), (1, None, 5, "w"), (None, "a", 5, "v")], "id int, entity string, at bigint, note string")
    v = spark.createDataFrame([("a", 0, 6, 1)], "entity string, low bigint, high bigint, n int")
    got = sorted((r.note, r.version.n if r.version else None) for r in asof.attach_as_of(e, v, "entity", "at", "low", "high", ["n"], ["low"], ["id"]).collect())
    assert got == [("v", 1), ("w", None), ("x", 1), ("y", 1), ("y", 1), ("z", None)]


def test_overlaps_are_cut_by_precedence(spark):
    v = spark.createDataFrame([("a", 0, 100, 1), ("a", 10, 20, 2), ("a", 15, 30, 0), ("a", 10, 20, 3), ("b", 0, 5, 1), ("b", 5, 9, 2)], "_e string, _low bigint, _high bigint, n int")
    got = sorted((r._e, r._low, r._high, r._v.n) for r in asof.disjoint(v.select("_e", "_low", "_high", F.struct("_low", "n").alias("_v")), 2).collect())
    assert got == [("a", 0, 10, 1), ("a", 10, 15, 3), ("a", 15, 20, 0), ("a", 20, 30, 0), ("a", 30, 100, 1), ("b", 0, 5, 1), ("b", 5, 9, 2)]


def test_nothing_is_shuffled_where_nodes_fit(spark):
    e = spark.range(100).selectExpr("id", "'a' as entity", "id as at")
    v = spark.createDataFrame([("a", 0, 50, 1), ("a", 50, 80, 2)], "entity string, low bigint, high bigint, n int")
    plan = asof.attach_as_of(e, v, "entity", "at", "low", "high", ["n"], ["low"], ["id"], 2)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan.split("== Physical Plan ==")[1] and "BroadcastHashJoin" in plan
