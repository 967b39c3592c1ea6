"""Term frequencies and format duplicates against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import format_duplicates as dup, frequency as freq  # noqa: E402

ROWS = "field string, term string, doc bigint, ngram string, n int"


def rows(spark, data):
    return spark.createDataFrame([(f, t, d, "x", 0) for f, t, d in data], ROWS)


def brute(data, max_n, split):
    occurrences, records = Counter(), {}
    for f, t, d in data:
        if t is None:
            continue
        words = split(t)
        for i in range(len(words)):
            for n in range(1, max_n + 1):
                if i + n <= len(words):
                    key = (f, " ".join(words[i : i + n]), n)
                    occurrences[key] += 1
                    records.setdefault(key, set())
                    if d is not None:
                        records[key].add(d)
    return {(*k, c, len(records[k])) for k, c in occurrences.items()}


def test_whole_values(spark):
    data = [("a", "x", 1), ("a", "x", 1), ("a", "x", 2), ("a", None, 3), ("a", "", 4), ("a", "x", None), ("b", "x", 1), ("a", "x y", 1), ("a", "X", 9)] + [("a", "hot", i % 40) for i in range(400)]
    got = {tuple(r) for r in freq.ngram_frequencies(rows(spark, data), F.col("field"), F.col("term"), F.col("doc")).collect()}
    assert got == brute(data, 1, lambda t: [t])


def test_terms_are_counted_as_written(spark):
    terms = ["AUTHORED_BY", "authored - by", "a\x01b", "ab", "\ue000x", "\ue002616263", " ", "a  b", "a b", "\ta\n", "é", "e\u0301", "😀"]
    data = [("a", t, i % 3) for i in range(9) for t in terms]
    got = {tuple(r) for r in freq.term_frequencies(rows(spark, data), F.col("field"), F.col("term"), F.col("doc")).collect()}
    assert got == brute(data, 1, lambda t: [t])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngrams_across_partitions(spark, seed):
    rng = random.Random(seed)
    data = [("f", " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), rng.choice([1, 2, 3, None, *range(4, 9)])) for _ in range(120)]
    data += [("f", "a b a b", 1)] * 60
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = {tuple(r) for r in freq.ngram_frequencies(rows(spark, data).repartition(5), F.col("field"), F.col("term"), F.col("doc"), 3, words).collect()}
    assert got == brute(data, 3, str.split)


def test_all_ngrams_without_a_bound(spark):
    data = [("f", "precedes partial normalizer between", 1), ("f", "precedes partial normalizer between", 2), ("f", "a b a b a b a b", 1), ("f", "", 3), ("f", "partial normalizer between", 2)]
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = {tuple(r) for r in freq.ngram_frequencies(rows(spark, data).repartition(3), F.col("field"), F.col("term"), F.col("doc"), tokenize=words).collect()}
    assert got == brute(data, 8, str.split)


def test_marks_and_empty_table(spark):
    data = [("a", "rare", 1), ("a", "some", 1), ("a", "some", 2), ("a", "some", 3)] + [("a", "common", i) for i in range(5)]
    total = spark.range(12)
    got = {r.ngram: r["mark"] for r in freq.mark(freq.ngram_frequencies(rows(spark, data), F.col("field"), F.col("term"), F.col("doc")), total).collect()}
    assert got == {"rare": "rare", "some": None, "common": "common"}
    assert freq.ngram_frequencies(rows(spark, []), F.col("field"), F.col("term"), F.col("doc")).count() == 0


LINES = "line_id bigint, line string, class string, canon string"


def lines(spark, texts):
    return spark.createDataFrame([(10 * i, t, "x", "y") for i, t in enumerate(texts)], LINES)


BASE = {"nodes": [{"id": "Dilated Deduction", "type": "Concept", "metadata": []}, {"id": "b", "type": None}], "n": 1.50}


def test_copies_and_what_is_none(spark):
    reordered = {"n": 1.5, "nodes": [{"type": "concept", "metadata": [], "id": "“DILATED-deduction”\t"}, {"type": None, "id": "b."}]}
    texts = [
        json.dumps(BASE), "  " + json.dumps(reordered, ensure_ascii=False), json.dumps(json.dumps(reordered)), json.dumps(BASE, indent=1),
        json.dumps({**BASE, "nodes": BASE["nodes"][::-1]}),  # array order matters
        json.dumps({**BASE, "nodes": [{**BASE["nodes"][0], "metadata": None}, BASE["nodes"][1]]}),  # null is not empty
        json.dumps({**BASE, "nodes": [{"id": "Dilated Deduction", "type": "Concept"}, BASE["nodes"][1]]}),  # absent is not empty
        json.dumps({"nodes": BASE["nodes"]}), "", None, "[1]", "null", "{broken", "[1]", "{broken", json.dumps("{broken"),
    ]
    got = {(r.first_line_id, r.line_id, r.copies) for r in dup.copies(lines(spark, texts)).collect()}
    assert got == {(0, 10, 4), (0, 20, 4), (0, 30, 4)}
    kept = {r.line_id: r.copies for r in dup.collapse(lines(spark, texts)).collect()}
    assert kept == {0: 4, 40: 1, 50: 1, 60: 1, 70: 1}


def test_lines_the_jvm_cannot_parse_are_settled_too(spark):
    odd = '{"a": "x", "a": "y"}'
    got = {(r.first_line_id, r.line_id) for r in dup.copies(lines(spark, [odd, odd.replace("x", "X"), '{"b": 1}'])).collect()}
    assert got == {(0, 10)}


def test_a_hot_group(spark):
    texts = [json.dumps({"id": f"Same  Thing{'.' * (i % 7)}"}) for i in range(900)] + [json.dumps({"id": f"other {i}"}) for i in range(300)]
    out = dup.copies(lines(spark, texts)).collect()
    assert len(out) == 899 and {r.first_line_id for r in out} == {0}


def test_empty_table(spark):
    assert dup.copies(lines(spark, [])).count() == 0 and dup.collapse(lines(spark, [])).count() == 0


def test_long_texts(spark):
    big = json.dumps({"id": "word " * 200_000})
    got = dup.copies(lines(spark, [big, big.upper().replace('"ID"', '"id"'), json.dumps({"id": "x"})])).collect()
    assert [(r.first_line_id, r.line_id) for r in got] == [(0, 10)]


def test_symbols_marks_and_emoji_are_content(spark):
    pairs = [("C++", "C"), ("+1", "-1"), ("$5", "€5"), ("a<b", "a>b"), ("कि", "की"), ("😀", "😢")]
    texts = [json.dumps({"id": x}, ensure_ascii=False) for pair in pairs for x in pair]
    assert dup.copies(lines(spark, texts)).count() == 0 and dup.collapse(lines(spark, texts)).count() == 12


def test_case_is_folded_after_the_punctuation(spark):
    texts = [json.dumps({"id": "ΛΟΓΟΣ Α"}, ensure_ascii=False), json.dumps({"ID": "λογοσα"}), json.dumps({"id": "ΛΟΓΟΣΑ."}), '{"n": 1e2}', '{"n": 100.0}', '{"N": 1E2}']
    got = {(r.first_line_id, r.line_id) for r in dup.copies(lines(spark, texts)).collect()}
    assert got == {(0, 10), (0, 20), (30, 50)}


def test_deep_records_are_copies_too(spark):
    deep = "[" * 30_000 + '"Deep"' + "]" * 30_000
    texts = ['{"a": ' + deep + ', "b": 1}', '{"B":1,"a":' + deep.lower() + "}", '{"a": ' + "[" * 900 + "]" * 900 + "}", '{"A" :' + "[ " * 900 + "]" * 900 + "}"]
    got = {(r.first_line_id, r.line_id) for r in dup.copies(lines(spark, texts)).collect()}
    assert got == {(0, 10), (20, 30)}


def test_steps_never_part_what_the_last_key_joins():
    rng = random.Random(3)
    parts = ["Straße", "STRASSE", "ﬁn", "İ", "K", "x\ny", "a\u0001b", "q\\n", "-", "1", "é", "“z”", "\u2003", "C++", "\ud800"]
    by_key = {}
    for _ in range(4000):
        value = {rng.choice("abAB"): [rng.choice(parts), rng.choice([1, 1.5, None, True, "1", "15"])], rng.choice("cC_"): "".join(rng.choices(parts, k=2))}
        parsed = dup.parse_line(json.dumps(value, ensure_ascii=rng.random() < 0.5))
        content = dup._content(parsed)
        by_key.setdefault(dup.canonical(parsed), set()).add((len(content), dup._histogram(content)))
    assert all(len(v) == 1 for v in by_key.values()) and len(by_key) > 500
