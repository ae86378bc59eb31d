"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from compare import BASE, connect, difference

from runledger.plans.catalog import ORACLES, QUERIES

SF = f"{BASE}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(result, con, ORACLES[name]) is None
    else:
        result.count()
