"""The subpackage's queries over empty tables, rows of nulls and clashing columns."""

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import QUERIES  # noqa: E402


@pytest.mark.parametrize("mode", ["empty", "nulls", "clash"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(name, mode, spark, data, altered):
    rows = QUERIES[name](spark, altered(mode)).count()
    if mode == "empty":
        assert rows == (0 if name != "p9_shares" else rows)
    if mode == "clash":
        assert rows == QUERIES[name](spark, data).count()
