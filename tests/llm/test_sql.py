"""Queries of the subpackage against their SQL."""

import pytest

from flowloom.llm.oracles import ORACLES
from flowloom.llm.queries import REGISTRY
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    assert compare(connect(sf_dir), ORACLES[name], REGISTRY[name](spark, sf_dir)) > 0
