"""Every query of the subpackage with a SQL twin gives the twin's rows; the others run."""

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(name, spark, data):
    assert QUERIES[name](spark, data).limit(5).collect() is not None
