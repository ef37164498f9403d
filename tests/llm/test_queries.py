import pytest

from millrace.llm.queries import QUERIES, SQL

from ..oracle import assert_equal, connect


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_equal(df, connect(data), SQL[name])
    else:
        assert not df.isEmpty()
