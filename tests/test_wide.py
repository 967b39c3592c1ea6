"""Attribute-value rows into wide tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import wide

DECLARED = {"node": {"page_number": "int", "confidence": "double", "is_novel": "boolean", "published_on": "date", "alias": "string"}}
SCHEMA = "item_id bigint, owner_kind string, owner_id bigint, meta_key string, meta_value string, recorded_at timestamp_ntz, part string, hash string"


def items(spark, rows):
    full = [(i, "node", o, k, v, t, "x", "y") for i, (o, k, v, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def day(n):
    return datetime(2024, 1, n)


@pytest.mark.parametrize(
    "kind,text,expected",
    [
        ("int", " 35 ", 35), ("int", "+7", 7), ("int", "72872.0", 72872), ("int", "8,536", 8536), ("int", "4.5", None), ("int", "O3B", None), ("int", "4/6", None), ("int", "12–14", None), ("int", "~3?x", None), ("int", "", None),
        ("int", "9" * 40, None), ("double", "0,24", 0.24), ("double", "31.1%", 0.311), ("double", "1.014e+00", 1.014), ("double", "0.9.1", None), ("double", "1..2", None), ("double", "<<1", None),
        ("boolean", "T", True), ("boolean", "No", False), ("boolean", "T/F", None), ("boolean", "2", None), ("date", "2024/04/20", date(2024, 4, 20)), ("date", "20210701", date(2021, 7, 1)),
        ("date", "2024-01-18T02:15:00Z", date(2024, 1, 18)), ("date", "Mar 7, 2020", date(2020, 3, 7)), ("date", "13 Aug 2025", date(2025, 8, 13)), ("date", "2023-??-20", None), ("date", "2023-02-30", None),
        ("date", "Jun 2023 or later", None), ("string", "\t ", None), ("string", "n/a", "n/a"), ("string", None, None), ("int", None, None),
    ],
)
def test_typed_value(spark, kind, text, expected):
    df = spark.createDataFrame([(text,)], "v string").select(wide.typed_value(F.col("v"), kind).alias("t"))
    got = df.first().t
    assert got == (pytest.approx(expected) if isinstance(expected, float) else expected)


@pytest.mark.parametrize(
    "key,expected",
    [("Page Number", "page_number"), ("pageNumber:", "page_number"), ("pgae_number", "page_number"), ("page_numbr", "page_number"), ("pag_numbr", None), ("color", None), ("tmp", None), (None, None), ("", None), ("alis", "alias")],
)
def test_resolve_key(spark, key, expected):
    df = spark.createDataFrame([(key,)], "k string").select(wide.resolve_key(F.col("k"), list(DECLARED["node"])).alias("r"))
    assert df.first().r == expected


def test_latest_readable_value_wins_and_repeats_only_count(spark):
    df = items(spark, [(1, "page_number", "3", day(1)), (1, "Page Number", "4", day(3)), (1, "page_number", "?", day(9)), (1, "page_number", "3", day(1)), (1, "page_number", "9", None)])
    row = wide.wide_table(df, DECLARED, "node").first()
    assert (row.page_number, row.page_number__items) == (4, 5)
    ties = items(spark, [(1, "page_number", "3", day(1)), (1, "page_number", "4", day(1))])
    assert wide.wide_table(ties, DECLARED, "node").first().page_number == 4


def test_states_nulls_and_owners_without_items(spark):
    df = items(spark, [(1, "alias", "x", day(1)), (1, "confidence", "high", day(1)), (2, None, "5", day(1)), (None, "alias", "x", day(1)), (3, "legacy", "5", None)])
    got = {tuple(r) for r in wide.cell_states(wide.widen(df, DECLARED), DECLARED).collect()}
    assert got == {("node", 1, "alias", "filled"), ("node", 1, "confidence", "unreadable")}
    owners = spark.createDataFrame([("node", 7)], "owner_kind string, owner_id bigint")
    rows = {r.owner_id: r for r in wide.wide_table(df, DECLARED, "node", owners).collect()}
    assert rows[7].listed and rows[7].alias is None and set(rows) == {1, 2, 3, 7}


def test_empty_table_and_discovery(spark):
    assert wide.widen(items(spark, []), DECLARED).count() == 0
    found = {r.meta_key: (r.attribute, r["items"], r.reads_int) for r in wide.discover(items(spark, [(1, "Page Number", "4", day(1)), (2, "Page Number", "x", day(1)), (3, "odd", "1", None)]), DECLARED).collect()}
    assert found == {"Page Number": ("page_number", 2, 1), "odd": (None, 1, 1)}
