import pytest

from millrace.plans import analytics, general, general_sql, ingest, upserts

from .oracle import assert_equal, connect

QUERIES = analytics.QUERIES | ingest.QUERIES | upserts.QUERIES | general.QUERIES
SQL = analytics.SQL | ingest.SQL | upserts.SQL | general_sql.SQL


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert_equal(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_every_record_rule_is_made_to_fire():
    from millrace.operators.rules import rules_for
    from millrace.contracts import DATASETS

    rejects = {r.rule_id for d in DATASETS.values() for r in rules_for(d) if r.severity == "REJECT"}
    assert rejects == {x for ways in upserts.EXPECTED.values() for x in ways if x}
