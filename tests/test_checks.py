"""Every registered query equals its SQL, and no plan holds a cross join."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()
# Those of the training-data package, where it is present, have tests of their own.
OWN_TESTS = set(entry_points.llm.queries()) if entry_points.llm else set()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) - OWN_TESTS == set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OWN_TESTS))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(con, SQL[name], df) is None
    else:
        assert df.count() > 0
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
