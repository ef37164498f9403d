import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import history
from millrace.operators.sweep import changes

SCHEMA = "source_table string, entity_id string, valid_from bigint, seq bigint, attrs struct<a: string, b: string>"


def row(r):
    return (r.entity_id, r.valid_from, r.valid_to, r.recorded_at, r.superseded_at)


def test_ledger_splits_and_supersedes(spark, tmp_path):
    ledger = history.Ledger(spark, str(tmp_path / "l"))
    first = [("p", "x", 10, 1, ("1", "k")), ("p", "x", 30, 2, ("3", "k")), ("p", "y", 5, 3, (None, None))]
    ledger.apply(0, spark.createDataFrame(first, SCHEMA), 100)
    late = [("p", "x", 20, 4, ("2", "k")), ("p", None, 1, 5, ("z", "z")), ("p", "x", None, 6, ("z", "z"))]
    touched = ledger.apply(1, spark.createDataFrame(late, SCHEMA), 200)
    want = {("x", 10, 30, 100, 200), ("x", 10, 20, 200, None), ("x", 20, 30, 200, None), ("x", 30, -1, 100, None), ("y", 5, -1, 100, None)}
    assert set(map(row, ledger.rows().collect())) == want and ledger.rows().count() == 5
    # What was believed before the late update is still there.
    assert {(r.valid_from, r.valid_to) for r in ledger.believed(100).where("entity_id = 'x'").collect()} == {(10, 30), (30, -1)}
    # The same batch again, and the same updates in another batch, change nothing.
    assert ledger.apply(1, spark.createDataFrame(late, SCHEMA), 300) == []
    ledger.apply(2, spark.createDataFrame(late + first, SCHEMA), 300)
    assert set(map(row, history.Ledger(spark, str(tmp_path / "l")).rows().collect())) == want and ledger.rows().count() == 5
    # Only the bucket of x was rewritten by the second batch.
    assert len(touched) == 1 and [p.name for p in (tmp_path / "l" / "open" / "v=1").iterdir() if p.name.startswith("bucket")] in ([], [f"bucket={touched[0]}"])


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    ledger = history.Ledger(spark, str(tmp_path / "l"))
    ledger.apply(0, spark.createDataFrame([("p", f"e{k}", 10, k, ("1", "k")) for k in range(200)], SCHEMA), 1)
    assert len(ledger.parts.versions) == history.BUCKETS
    touched = ledger.apply(1, spark.createDataFrame([("p", "e7", 20, 900, ("2", "k"))], SCHEMA), 2)
    assert {b for b, v in ledger.parts.versions.items() if v == 1} == set(touched) and len(touched) == 1
    assert {f.split("bucket=")[1].split("/")[0] for f in ledger.parts.read(ledger._open, touched).inputFiles()} == {str(touched[0])}
    assert spark.read.parquet(str(tmp_path / "l" / "closed" / "batch=1")).count() == 1


def brute(data):
    """The ledger row by row, batch by batch, as rows (entity, from, seq, to, recorded, superseded)."""
    out, last = {}, max(d[5] for d in data)
    for batch in range(last + 1):
        known = [d for d in data if d[5] <= batch]
        for e in {d[1] for d in known}:
            own = sorted((d for d in known if d[1] == e), key=lambda d: (d[2], d[3]))
            for a, b in zip(own, [*own[1:], None]):
                out.setdefault((e, a[2], a[3], b[2] if b else -1), []).append(batch)
    return sorted((*k, v[0], v[-1] + 1 if v[-1] < last else None) for k, v in out.items())


def test_versions_and_ledger_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    data = [("p", rng.choice(["hot", "hot", "hot", "e1", "e2", "e3"]), rng.randrange(0, 150), i, (rng.choice(["u", "v", None]), rng.choice(["1", None])), rng.randrange(3)) for i in range(300)]
    ledger = history.Ledger(spark, str(tmp_path / "l"))
    for k in range(3):
        ledger.apply(k, spark.createDataFrame([d[:5] for d in data if d[5] == k], SCHEMA).repartition(3), k)
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(((r.entity_id, r.valid_from, r.seq, r.valid_to, r.recorded_at, r.superseded_at) for r in ledger.rows().collect()), key=key)
    assert got == sorted(brute(data), key=key)
    want = []
    for e in sorted({d[1] for d in data}):
        own = sorted((d for d in data if d[1] == e), key=lambda d: (d[2], d[3]))
        starts = [d for k, d in enumerate(own) if k == 0 or own[k - 1][4] != d[4]]
        want += [(e, n + 1, d[2], starts[n + 1][2] if n + 1 < len(starts) else -1) for n, d in enumerate(starts)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a hot entity over several partitions
    try:
        v = history.versions(ledger.believed())
        assert v.rdd.getNumPartitions() > 1
        assert sorted(map(tuple, v.select("entity_id", "version_no", "valid_from", "valid_to").collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Believed rows tile valid time: each ends where the next begins.
    for e in {d[1] for d in data}:
        own = sorted((r.valid_from, r.seq, r.valid_to) for r in ledger.believed().where(F.col("entity_id") == e).collect())
        assert all(a[2] == b[0] for a, b in zip(own, own[1:])) and own[-1][2] == -1


def test_normal_changes_and_empty(spark, tmp_path):
    got = spark.createDataFrame([(" Gold\t",), ("GOLD",), ("",), (None,)], "t string").select(history.normal(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == ["gold", "gold", "", None]
    assert changes(pa.array(["a", "a", None, None, "b"])).tolist() == [True, False, True, False, True] and changes(pa.array([], pa.string())).tolist() == []
    ledger = history.Ledger(spark, str(tmp_path / "l"))
    assert ledger.apply(0, spark.createDataFrame([], SCHEMA), 0) == []
    assert history.versions(ledger.believed()).isEmpty() and ledger.rows().isEmpty()
