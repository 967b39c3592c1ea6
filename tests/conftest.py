"""One local session for all tests, and the comparison of queries with their SQL twins."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from graphloom.session import local_session  # noqa: E402

DATA = Path(os.environ.get("GRAPHLOOM_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, data):
    """Check that a query and its SQL give the same rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")

    def check(query, sql: str) -> None:
        df = query(spark, data)
        columns = sorted(df.columns)
        mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
        cursor = con.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        theirs = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
        assert mine == theirs

    return check


CLASHING = ["hash", "key", "value", "n", "rank", "doc", "word", "part", "count", "role", "ts", "at", "state", "fixes", "heads", "class", "canon", "grp", "rec", "suffix", "c", "tokens", "copies", "weight", "band", "topic", "length", "piece", "_salt", "_w", "typed", "attribute"]
IDS = {"vec_id", "doc_id", "chunk_key", "line_id", "node_row_id", "rel_id", "graph_doc_id", "item_id", "ref_id", "event_id"}


@pytest.fixture(scope="session")
def altered(spark, data, tmp_path_factory):
    """Folders of the test tables without rows, with rows of nulls, with every row twice, or with clashing extra columns."""
    from pyspark.sql import functions as F

    made: dict[str, str] = {}

    def folder(mode: str) -> str:
        if mode not in made:
            made[mode] = str(tmp_path_factory.mktemp(mode))
            for f in os.listdir(data):
                df = spark.read.parquet(f"{data}/{f}")
                if mode == "empty":
                    df = df.limit(0)
                elif mode == "nulls":
                    blank = df.limit(20).select(*[((-F.col(c) - 1) if c in IDS else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
                    df = df.unionByName(blank)
                elif mode == "twice":
                    df = df.unionByName(df)
                elif mode == "clash":
                    df = df.withColumns({x: F.lit("zz") for x in CLASHING if x not in df.columns})
                df.coalesce(1).write.parquet(f"{made[mode]}/{f}")
        return made[mode]

    return folder
