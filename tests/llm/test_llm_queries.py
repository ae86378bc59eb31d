"""The registered queries against their SQL on the smallest driver tables."""

import pytest
from compare import BASE, connect, difference

from runledger.llm.queries import ORACLES, QUERIES

SF = f"{BASE}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None
