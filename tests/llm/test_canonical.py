"""Mapping of typed values onto a canonical list."""

import pytest

pytest.importorskip("graphloom.llm")
from graphloom.llm import canonical as can  # noqa: E402

REF = [
    (1, "id", "Spectral Nomadic Calibration", "SNC"), (2, "id", "Elastic Memory", "ElaMem"), (3, "id", "Causal Residual Compression", None), (4, "id", "Dilated Quantized Embedding", None),
    (5, "id", "Spectral Memory", None), (6, "id", None, None), (101, "type", "Concept", None), (102, "type", "Task", None), (103, "type", "Person", None),
]
REF_SCHEMA = "ref_id bigint, field string, name string, short_form string, value string, key string"


def mapped(spark, values, field="id"):
    ref = spark.createDataFrame([(*r, "v", "k") for r in REF], REF_SCHEMA)
    rows = spark.createDataFrame([(i, field, v, "t", 1) for i, v in enumerate(values)], "row_id bigint, field string, value string, token string, count bigint")
    return {values[r.row_id]: r.ref_id for r in can.map_rows(rows, "row_id", ref).collect()}


@pytest.mark.parametrize(
    "value,ref",
    [
        ("SPECTRAL NOMADIC CALIBRATION", 1), ("sPECTRAL nOMADIC cALIBRATION", 1), ("Spectral Nomaic Calibration", 1), ("Calibration, Spectral Nomadic", 1), ("Spectral/Nomadic/Calibration", 1), ("SpectralNomadicCalibration", 1),
        ("“Spectral Nomadic Calibration”", 1), ("the Spectral Nomadic Calibration", 1), ("Spectral Nomadic Calibration module", 1), ("Spectral Nomadic Calibration [12]", 1), ("Spectral Nomadic Calibration (ours)", 1),
        ("SNC", 1), ("snc", 1), ("SNC (spectral nomadic calibration)", 1), ("Spectral Nomadic Calibration (SNC)", 1), ("CRC (causal residual compression)", 3), ("Causal Residual Compr.", 3), ("Caus. Residual Compression", 3),
        ("ElaMem", 2), ("Elastic  Memorys", 2), ("Elastci Mmeory", 2), ("spectral memory", 5), ("Spectral Nomadic", -1), ("Spectral Elastic Memory", -1), ("Nomadic Spectral Calibration", -1), ("Elastic Calibration", -1),
        ("Fize Vibekodo", -1), ("Kepugave: Spectral Memory for Elastic Memory", -1), ("CRC", -1), ("Elastic Memory v2", -1), ("the", -1), ("???", -1), ("x" * 5000, -1), ("Spectral Memory " * 2000, -1),
    ],
)
def test_values(spark, value, ref):
    vocabulary = {}
    entries = can.Entries(sorted((r, n, s) for r, f, n, s in REF if f == "id" and n))
    for token in can.tokens_of(value):
        stem = token.rstrip(".")
        if token.endswith("."):
            vocabulary[token] = [(w, 0) for w in entries.idf if w.startswith(stem) and len(stem) >= 3]
        else:
            found = [(w, can.swap_distance(token, w, 3)) for w in entries.idf]
            least = min((e for _, e in found), default=9)
            vocabulary[token] = [(w, e) for w, e in found if e == least and e <= can.edit_bound(len(token))]
    assert entries.match(can.tokens_of(value), vocabulary)[0] == ref


def test_rows_cases_and_repeats(spark):
    values = ["Elastic Memory", "elastic memory", None, "", "  ", "Elastic Memry", "Other Thing"]
    assert mapped(spark, values) == {"elastic memory": 2, "Elastic Memry": 2, "Other Thing": -1}
    assert mapped(spark, ["Conecpt", "Tak", "Concepts", "Concept node", "type: Task", "Hardware", "Concept", "<Person>", "Entity:Concept"], "type") == {
        "Conecpt": 101, "Tak": 102, "Concepts": 101, "Concept node": 101, "type: Task": 102, "Hardware": -1, "<Person>": 103, "Entity:Concept": 101
    }


def test_hot_value_and_empty_table(spark):
    ref = spark.createDataFrame([(*r, "v", "k") for r in REF], REF_SCHEMA)
    rows = spark.createDataFrame([(i, "id", "elastic memory" if i % 3 else f"v {i}") for i in range(900)], "row_id bigint, field string, value string")
    got = can.map_rows(rows, "row_id", ref)
    assert got.count() == 900 and got.where("ref_id = 2").count() == 600
    assert can.map_rows(rows.limit(0), "row_id", ref).count() == 0
    assert can.map_rows(rows, "row_id", ref.limit(0)).where("ref_id <> -1").count() == 0


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "badc", 2), ("a", "xyz", 3), ("", "ab", 2)])
def test_distance(a, b, d):
    assert can.swap_distance(a, b, 3) == d and can.swap_distance(b, a, 3) == d


def test_repairs_are_all_words_within_the_bound(spark):
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(2, 10))) for _ in range(150)} | {"factored", "anchored"})
    tokens = sorted({"".join(rng.choices("abcd", k=rng.randint(2, 11))) for _ in range(80)} | {"factored", "anchroed"})
    made = can.repair_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(r.token, x.word, x.edits) for r in made.collect() for x in r.repairs}
    want = {(t, w, d) for t in tokens for w in words if (d := can.swap_distance(t, w, can.edit_bound(len(t)))) <= can.edit_bound(len(t)) and (t not in words or t == w)}
    assert got == want


def test_the_better_entry_wins_though_a_nearer_word_leads_elsewhere():
    entries = can.Entries([(1, "Linear Reader", None), (2, "Linked Leader", None)])
    found = {"linear": [("linear", 0)], "leaderr": [("leader", 1), ("reader", 2)]}
    assert entries.match(["linear", "leaderr"], found)[0] == 1


def test_long_values_may_have_a_short_form_too():
    entries = can.Entries([(1, "One Two Three Four Five Six Seven Eight", "OTT"), (2, "One Two", None)])
    tokens = can.tokens_of("OTT (one two three four five six seven eight)")
    assert entries.match(tokens, {t: [(t, 0)] for t in tokens if t in entries.idf})[0] == 1


def test_reference_lists_in_blocks_give_the_same(spark, monkeypatch):
    values = ["SNC", "Elastic  Memorys", "spectral memory", "Spectral Elastic Memory", "Caus. Residual Compression", "Other"]
    whole = mapped(spark, values)
    monkeypatch.setattr(can, "BLOCK", 2)
    assert mapped(spark, values) == whole
