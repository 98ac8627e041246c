"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from checks.compare import database, difference
from checks.oracles import oracle_sql
from checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_equal_to_sql(spark, con, name):
    assert difference(driver.queries()[name](spark, SF_DIR), con.execute(SQL[name])) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 10


def test_expected_rows_of_the_first_slice(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    rows = {r.decil: r for r in driver.queries()["r4_fuel_spend"](spark, sf_dir).collect()}
    expected = {1: 6548024.1013, 2: 5639957.7892, 3: 6361496.7053, 10: 5823445.084}
    assert {k: rows[k].media_gasto for k in expected} == expected
