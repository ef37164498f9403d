import random
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from millrace.llm.packing import pack, plan, spans


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
def test_plan_packs_everything_within_capacity(histogram, capacity):
    packs = plan(histogram, capacity)
    used = Counter()
    for count, pattern, room in packs:
        size = 0
        while pattern:
            used[pattern.length] += count * pattern.times
            size += pattern.length * pattern.times
            pattern = pattern.below
        assert size + room == capacity and room >= 0
    assert used == Counter(histogram)
    own, containers = spans(packs, 1)
    total = sum(k * n for k, n in histogram.items())
    assert containers * capacity >= total and containers <= 2 * -(-total // capacity) + 1
    reach = defaultdict(list)
    for _, length, low, high, _, _ in own:
        reach[length].append((low, high))
    for length, n in histogram.items():
        parts = sorted(reach[length])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def check(spark, sizes, specs, slices=4):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container_id string")
    rows = pack(df, specs, slices).collect()
    for spec, capacity in specs.items():
        own = [r for r in rows if r.spec_id == spec]
        fill, pieces = Counter(), defaultdict(list)
        for r in own:
            fill[r.container_id] += r.piece_tokens
            pieces[r.doc_id].append((r.piece_no, r.start_token, r.piece_tokens))
        assert set(pieces) == set(range(len(sizes))) and all(v <= capacity for v in fill.values())
        for i, n in enumerate(sizes):
            got, at = sorted(pieces[i]), 0
            assert len(got) == (1 if (n or 0) <= capacity else -(-n // capacity))
            for k, (no, start, size) in enumerate(got):
                assert (no, start) == (k + 1, at)
                at += size
            assert at == (n or 0)
        if own:
            assert set(fill) == set(range(max(fill) + 1)) or not sum(fill.values())
        yield len(fill), -(-sum(n or 0 for n in sizes) // capacity)


def test_assignment(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, None, 1, 7, 7, 7, 7, rng.randrange(1, 64), rng.randrange(1, 64), 64, 65, 128, 1000]) for _ in range(400)]
    for containers, bound in check(spark, sizes, {1: 64, 2: 256}):
        assert containers <= bound * 1.03 + 1


def test_small_cases(spark):
    assert [c for c, _ in check(spark, [0, None, 0], {1: 8})] == [1]
    assert [c for c, _ in check(spark, [8, 16, 24], {1: 8})] == [6]
    assert [c for c, _ in check(spark, [5] * 1000, {1: 8}, 64)] == [1000]
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), {1: 8}).isEmpty()


def test_repeated_ids_are_packed_each(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 5)], "doc_id bigint, n_tokens bigint")
    got = pack(df, {3: 10}).collect()
    assert len(got) == 3 and len({r.container_id for r in got}) == 2
