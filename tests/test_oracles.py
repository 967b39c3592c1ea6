"""Every query with a SQL twin gives the twin's rows."""

import pytest

from graphloom.plans import ORACLES, REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(REGISTRY[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLES)))
def test_query_runs(name, spark, data):
    assert REGISTRY[name](spark, data).limit(5).collect() is not None
