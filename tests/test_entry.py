"""The driver's contract."""

import __spark_entry__ as entry


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_optional_package():
    import subprocess
    import sys

    code = "import sys; import graphloom.plans, graphloom.pipeline, graphloom.cli, graphloom.sources, graphloom.sinks, graphloom.streaming.flows; print(any(m.startswith('graphloom.llm') for m in sys.modules))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "False"
