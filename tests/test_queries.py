"""Every registered query against its SQL, and the shape of its plan."""

import contextlib
import io

import pytest

import __spark_entry__ as driver
from compare import connect, differences

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    assert "CartesianProduct" not in out.getvalue()
    assert "BroadcastNestedLoopJoin" not in out.getvalue()
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0
