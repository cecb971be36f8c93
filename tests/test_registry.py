"""Every registered query against its SQL, on the smallest driver tables."""

import os

import pytest
from compare import compare, database

import __spark_entry__ as driver
from kycmill.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

QUERIES, ORACLE = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    difference, rows, _, _ = compare(spark, con, QUERIES[name], ORACLE[name], FOLDER)
    assert difference is None
    assert rows > 0 or name == "unique_conflicts"


def test_entry(spark):
    assert driver.entry(spark).limit(1).count() == 1
