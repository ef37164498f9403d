from millrace.operators import orphans

from .conftest import rows

SALE = "record_id bigint, metadata struct<event_timestamp: string>, payload struct<store_id: string, customer_id: string, line_items: array<struct<product_id: string>>>"
PRODUCT = "record_id bigint, metadata struct<event_timestamp: string>, payload struct<product_id: string, is_active: boolean>"
CUSTOMER = "record_id bigint, metadata struct<event_timestamp: string>, payload struct<customer_id: string>"


def at(h):
    return (f"2026-03-02T{h:02d}:00:00Z",)


def found(spark, sales, products, customers, stores):
    p = spark.createDataFrame(products, PRODUCT)
    known = orphans.parents(p, spark.createDataFrame(customers, CUSTOMER), spark.createDataFrame(stores, "store_id string, note int"))
    refs = orphans.references(spark.createDataFrame(sales, SALE))
    return orphans.orphans(refs, known, orphans.withdrawn(p))


CASE = (
    [
        (1, at(5), ("S", " cust-1 ", [("P",), ("P",), None, (None,)])),
        (2, at(1), ("S", "CUST-1", [("P",)])),  # both only later
        (3, at(9), ("Z", None, [("Q",), ("",)])),  # unknown store, unknown and blank product, guest
        (4, at(7), ("S", "  ", [("P",)])),  # withdrawn at 6
        (5, at(8), (None, "nobody", None)),
        (6, ("no time",), ("Z", "nobody", [("Q",)])),
        (7, at(6), ("S", "CUST-1", [("P",)])),  # at the very moment of withdrawal
    ],
    [(1, at(2), ("P", None)), (2, at(6), ("P", False)), (3, at(8), ("P", True)), (4, ("x",), ("Q", True)), (5, at(6), ("P", False))],
    [(1, at(4), ("Cust-1",)), (2, at(3), ("CUST-1 ",)), (3, at(3), (None,))],
    [("S", 1), ("S", 2), (None, 3)],
)


def test_orphans(spark):
    got = rows(found(spark, *CASE).drop("t"))
    assert got == sorted([(2, "product_updates", "P"), (2, "customer_events", "CUST-1"), (3, "store_reference", "Z"), (3, "product_updates", "Q"), (3, "product_updates", ""), (4, "product_updates", "P"), (5, "customer_events", "NOBODY"), (7, "product_updates", "P")], key=repr)


def test_shuffled_way_gives_the_same(spark, monkeypatch):
    want = rows(found(spark, *CASE))
    monkeypatch.setattr("millrace.session.BROADCAST_BYTES", -1)
    assert rows(found(spark, *CASE)) == want


def test_report_and_empty(spark):
    report = rows(orphans.orphan_report(found(spark, *CASE)))
    assert ("product_updates", "2026-03-02", 5, 3) in report
    assert found(spark, [], *CASE[1:]).isEmpty()
    assert {r[0] for r in rows(found(spark, CASE[0], [], [], []).select("ref_table"))} == {"product_updates", "customer_events", "store_reference"}
