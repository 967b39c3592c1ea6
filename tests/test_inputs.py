"""Queries over empty tables, rows of nulls and clashing columns do not fail."""

import pytest

from graphloom.plans import REGISTRY

DATA_OPERATORS = sorted(q for q in REGISTRY if q[0] == "p" and q[1].isdigit())
# one value per scalar aggregate stays on empty tables; everything else has no rows
ONE_ROW = {"ping", "validation_report", "graph_node_counts", "graph_rel_counts", "rel_type_catalog", "direct_edge_count", "coverage_scores", "relation_coverage", "faithfulness_ratio", "relation_faithfulness", "plausibility_score", "eval_overall_rate", "full_report", "report_flags"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"rel_type_allow_deny"}))
def test_empty_tables(name, spark, altered):
    rows = REGISTRY[name](spark, altered("empty")).count()
    assert rows <= (4 if name in ONE_ROW or name.endswith(("ratio", "rate", "stats", "density", "types", "node", "count", "rollup", "category")) else 0)


@pytest.mark.parametrize("mode", ["nulls", "clash"])
@pytest.mark.parametrize("name", DATA_OPERATORS)
def test_odd_tables(name, mode, spark, data, altered):
    rows = REGISTRY[name](spark, altered(mode)).count()
    if mode == "clash":
        assert rows == REGISTRY[name](spark, data).count()
