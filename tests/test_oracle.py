"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from sitemetrics.plans.all import ORACLES, QUERIES
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    problems, _ = differences(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name])
    assert problems == []


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["site_id", "name", "city", "capacity", "status", "current_occupancy", "today_revenue"]
    assert df.count() == 25
