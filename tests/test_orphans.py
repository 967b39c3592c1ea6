"""Orphan references: defined results, hot ids and a randomised comparison with brute force."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st

from graphloom.operators import orphans

REF = "key string, at timestamp_ntz, row_id bigint, ts string, state_x int"
TARGET = "key string, start timestamp_ntz, end timestamp_ntz, until string"
T0 = datetime(2024, 1, 1)


def t(h):
    return None if h is None else T0 + timedelta(hours=h)


def run(spark, refs, targets):
    a = spark.createDataFrame([(k, t(h), i, "x", 1) for i, (k, h) in enumerate(refs)], REF)
    b = spark.createDataFrame([(k, t(s), t(e), "u") for k, s, e in targets], TARGET)
    return {r.row_id: r.state for r in orphans.reference_states(a, b, slice_days=1).collect()}


def brute(refs, targets):
    out = {}
    for i, (k, h) in enumerate(refs):
        mine = [(-1e9 if s is None else s, 1e9 if e is None else e) for key, s, e in targets if key == k]
        if k is None:
            continue
        if not mine:
            out[i] = "missing"
        elif h is None or any(s <= h < e for s, e in mine):
            continue
        else:
            out[i] = "late" if any(s > h and s < e for s, e in mine) else "deleted"
    return out


def test_states(spark):
    targets = [("a", 0, 10), ("a", 20, None), ("b", 5, 5), ("c", None, 3), ("a", 0, 10)]
    refs = [("a", 0), ("a", 9), ("a", 10), ("a", 15), ("a", 25), ("a", -1), ("b", 6), ("b", 1), ("c", 1), ("c", 3), ("d", 1), (None, 1), ("d", None), ("a", None), ("a", 15)]
    assert run(spark, refs, targets) == brute(refs, targets)
    assert run(spark, refs, targets)[2] == "late" and run(spark, refs, targets)[6] == "deleted"


def test_empty_sides(spark):
    assert run(spark, [], [("a", 0, 1)]) == {}
    assert run(spark, [("a", 1)], []) == {0: "missing"}


hours = st.one_of(st.none(), st.integers(-80, 80))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), hours), min_size=1, max_size=12), st.lists(st.tuples(st.sampled_from("abc"), hours, hours), max_size=12))
def test_against_brute_force(spark, refs, targets):
    assert run(spark, refs, targets) == brute(refs, targets)


def test_a_hot_id_spreads_over_slices(spark):
    targets = [("hot", i, i + 1) for i in range(0, 2000, 2)]
    refs = [("hot", i) for i in range(2000)]
    got = run(spark, refs, targets)
    assert got == brute(refs, targets)


def test_runs_merge_touching_intervals(spark):
    b = spark.createDataFrame([("a", t(0), t(2), ""), ("a", t(2), t(4), ""), ("a", t(1), t(3), ""), ("a", t(6), None, "")], TARGET)
    rows = orphans.validity_runs(b).orderBy("run_start").collect()
    assert [r["rows"] for r in rows] == [3, 1]


def test_a_hot_slice_spreads_over_groups(spark, monkeypatch):
    monkeypatch.setattr(orphans, "ROWS_A_GROUP", 50)
    monkeypatch.setattr(orphans, "LISTED", 40)
    targets = [("hot", i / 60, i / 60 + 0.01) for i in range(0, 900, 3)] + [("cold", 2, 3)]
    refs = [("hot", i / 90) for i in range(1300)] + [("cold", i) for i in range(12)] + [(f"k{i}", 1) for i in range(600)]
    assert run(spark, refs, targets) == brute(refs, targets)
