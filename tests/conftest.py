import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import build_session

    base = tmp_path_factory.mktemp("shared")
    s = build_session("local[4]", "tests", 4, {"spark.checkpoint.dir": str(base), "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(base / "wh"), "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
