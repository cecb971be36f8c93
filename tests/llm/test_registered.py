"""Registered queries of the subpackage against their SQL."""

import os

import pytest
from compare import compare, database

from kycmill.llm.oracle import ORACLE_SQL
from kycmill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    difference, rows, _, _ = compare(spark, con, QUERIES[name], ORACLE_SQL[name], FOLDER)
    assert difference is None
    assert rows > 0
