"""Every query with SQL gives the rows of that SQL on the small tables; the others give rows."""

from pathlib import Path

import pytest
from compare import compare, duck

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    run, sql = driver.queries()[name], driver.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF_DIR).count() > 0
    else:
        assert compare(spark, con, run, sql, SF_DIR) is None


def test_every_oracle_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_is_the_history(spark):
    df = driver.entry(spark)
    assert {"user_id", "_aktualne_od", "_aktualne_do"} <= set(df.columns)
