import json
import random

from hypothesis import given, settings, strategies as st

from millrace.operators import nested
from millrace.operators.nested import Index, flat_lines


def extract_lines(bodies):
    """The rows as tuples."""
    return [tuple(r.values()) for r in nested.extract_lines(bodies).to_pylist()]


def opened(x):
    while isinstance(x, str):
        try:
            y = json.loads(x)
        except ValueError:
            return x
        if not isinstance(y, (dict, list, str)):
            return x
        x = y
    return x


def text(x):
    return x if isinstance(x, str) else json.dumps(x)


def brute(raw, body):
    out = set()
    try:
        top = json.loads(body)
    except ValueError:
        return out

    def envelope(e):
        e = opened(e)
        if isinstance(e, list):
            for x in e:
                envelope(x)
        elif isinstance(e, dict) and isinstance(p := opened(e.get("payload")), dict):
            lines = opened(p.get("line_items"))
            for k, line in enumerate([lines] if isinstance(lines, dict) else lines if isinstance(lines, list) else [], 1):
                line = opened(line)
                if isinstance(line, dict) and all(line.get(c) is not None for c in ("product_id", "quantity", "unit_price")):
                    t = p.get("transaction_id")
                    out.add((raw, None if t is None else text(t), k, text(line["product_id"])))

    envelope(top)
    return out


LINE = {"product_id": "SKU-1", "quantity": 2, "unit_price": 1.5, "promotions": [{"shares": [{"product_id": "no"}]}]}
BODIES = [
    json.dumps({"payload": {"transaction_id": "T", "line_items": [LINE, None, {"product_id": "x", "quantity": None, "unit_price": 1}, dict(LINE, product_id=7, quantity="2")]}, "metadata": {"a": [1, {}]}}),
    json.dumps([{"payload": {"line_items": LINE}}, {"payload": json.dumps({"transaction_id": None, "line_items": json.dumps([LINE, json.dumps(LINE)])})}]),
    json.dumps(json.dumps({"payload": {"transaction_id": 'q"\\u00e9\\', "line_items": [LINE]}})),
    '{"payload": {"line_items": [{"product_id": "a", "quantity": 1, "unit_price": 1}], "line_items": []}}',
    '{"payload": {"line_items": [{"product_id": "a\\u00e9\\"", "quantity": 1, "unit_price": false}]}}',
    '{"pay\\u006coad": {"line_items": [{"product_id": "esc", "quantity": 0, "unit_price": 0}]}}',
    '{"payload": {"line_items": [{"product_id": "a", "quantity": 1, "unit_price": 1}]}',
    "", " ", "null", "[]", "{}", '"', "\\", '{"payload": []}', '{"payload": {"line_items": "not json"}}', '{"payload": {"line_items": [[{"product_id": 1, "quantity": 1, "unit_price": 1}]]}}',
]


def test_bodies_equal_the_parser():
    for k, body in enumerate(BODIES):
        assert {x[:4] for x in extract_lines([(k, body)])} == brute(k, body), body
    every = {x[:4] for x in extract_lines(list(enumerate(BODIES)))}
    assert every == set().union(*(brute(k, b) for k, b in enumerate(BODIES)))


def test_broken_bodies_are_told_from_good_ones():
    rng = random.Random(2)
    texts = list(BODIES)
    for _ in range(3000):
        s = rng.choice(BODIES)
        for _ in range(rng.choice([1, 1, 2])):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + rng.choice('"{}[],:\\\n1x ') + s[at + rng.randrange(2) :]
        texts.append(s)
    ok = Index([t.encode() for t in texts]).ok
    for t, good in zip(texts, ok):
        try:
            json.loads(t)
            want = True
        except ValueError as e:
            want = "Extra data" in str(e) and bool(good)  # several bodies in a row are read
        assert bool(good) == want, t


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["payload", "line_items", "product_id", "quantity", "unit_price", "transaction_id", "z"]), x, max_size=5), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(JSON, st.sampled_from([None, 1]))
def test_any_json(value, indent):
    body = json.dumps(value, indent=indent)
    assert {x[:4] for x in extract_lines([(1, body)])} == brute(1, body)


def test_in_spark(spark):
    df = spark.createDataFrame([(1, BODIES[0], "x"), (2, None, "y"), (3, "{", "z"), (4, BODIES[1] + " " * 3_000_000, "w")], "raw_id bigint, event_json string, other string")
    got = {(r.raw_id, r.transaction_id, r.line_pos, r.product_id) for r in flat_lines(df).collect()}
    assert got == brute(1, BODIES[0]) | brute(4, BODIES[1])
    assert flat_lines(df.where("false")).isEmpty()


def test_time_is_linear_in_the_bodies():
    """Objects as quantities are cut out as they are written, without a search for their ends."""
    import time

    body = '{"payload":{"transaction_id":"t","line_items":[{"product_id":"p","quantity":{"n":[1,{"u":2}]},"unit_price":[3]}]}}'
    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        got = nested.extract_lines([(k, body) for k in range(n)])
        took.append(time.perf_counter() - began)
        assert got.num_rows == n and got["quantity"][0].as_py() == '{"n":[1,{"u":2}]}' and got["unit_price"][0].as_py() == "[3]"
    assert took[1] < 8 * 4 * max(took[0], 0.01)
