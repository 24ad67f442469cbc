"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import pytest
from check_oracle import compare, duck
from conftest import SMALL

from sigloft.catalog import ORACLES, QUERIES, load_all

load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    status, _ = compare(df, con, ORACLES[name])
    assert status == "ok"


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns[0] == "ticker"
    assert set(driver.oracle_sql()) <= set(driver.queries())
