"""Registered queries against their SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tendero.workload import ORACLES, QUERIES
from tests.check_oracles import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture
def con():
    with duck(SF) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
