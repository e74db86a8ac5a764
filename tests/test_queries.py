"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from flowloom.plans.oracles import ORACLES
from flowloom.plans.queries import REGISTRY
from tests.oracle import compare, connect

SQL = contract.oracle_sql()
QUERIES = {name: run for name, run in contract.queries().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(REGISTRY) == set(ORACLES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(con, SQL[name], QUERIES[name](spark, sf_dir)) > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 290
