"""Patterns, extraction, answers, judges, records and streams of upserts."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom import pipeline, sinks, sources, storage
from graphloom.functions import records, tokens
from graphloom.models import judges, stub
from graphloom.operators import chunking, extraction, graph_metrics, patterns
from graphloom.plans import answers
from graphloom.streaming import flows

EDGES = "src_type string, src string, rel string, dst_type string, dst string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("P", "Ann", "WROTE", "B", "Book"), ("P", "Bob", "WROTE", "B", "Book"), ("B", "Book", "CITES", "B", "Other"), ("P", "Ann", "KNOWS", "P", "Bob"), ("P", "Bob", None, "P", "Bob"), (None, "x", "CITES", None, "y")]
    return spark.createDataFrame(rows, EDGES)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_patterns(edges):
    P, S, E = patterns.Pattern, patterns.Step, patterns.End
    paths = lambda p: {tuple(r) for r in patterns.compiled(p, edges).collect()}
    assert paths(P(E(type="P"), (S(E(type="B"), ("WROTE",)),))) == {("Ann", "WROTE", "Book"), ("Bob", "WROTE", "Book")}
    assert paths(P(E(id="Ann"), (S(rels=("WROTE",)), S(E(ends_with="ER"))))) == {("Ann", "WROTE", "Book", "CITES", "Other")}
    assert paths(P(E(id="Book"), (S(E(contains="an"), directed=False),))) == {("Book", "WROTE", "Ann")}
    assert len(paths(P(E(), (S(),), limit=2))) == 2
    wrong = P(E(type="P"), (S(E(type="B"), ("NOPE",)),))
    safe = patterns.sound(wrong, {"WROTE"})
    assert safe.steps[0].rels == () and safe.dropped == ("NOPE",)
    assert {r.retried for r in patterns.retried(wrong, edges, {"WROTE"}).collect()} == {True}
    with pytest.raises(ValueError):
        patterns.compiled(P(), edges)


def test_extraction_sets_the_source_itself(spark):
    chunks = spark.createDataFrame([("f_chunks_2k_1", "Sparse Graph Memory meets Dense Token Reader."), ("f_chunks_2k_2", "nothing here"), ("f_chunks_2k_3", None), (None, "Sparse Graph Memory")], "id string, content string")
    docs = extraction.chunk_documents(chunks).collect()
    assert [d.doc for d in docs] == ["f_chunks_2k.jsonl::f_chunks_2k_1"] and docs[0].source.source_id == docs[0].doc
    assert [(r.source, r.type, r.target) for r in docs[0].relationships] == [("Sparse Graph Memory", "MENTIONS", "Dense Token Reader")]
    batch = spark.createDataFrame([("f", "c1", "Sparse Graph Memory")], "file string, first_chunk string, text string")
    made = extraction.batch_documents(batch)
    assert made.first().source.source_id == "f::batch::c1"
    assert [tuple(r) for r in extraction.provenance(made).collect()] == [("f::batch::c1", "EXTRACTED", "Concept", "Sparse Graph Memory")]


def test_answers_and_cases(spark, edges):
    nodes = edges.select(F.col("src_type").alias("type"), F.col("src").alias("id")).unionByName(edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("id"))).distinct()
    mentions = spark.createDataFrame([("f.jsonl::c", "chunk", "P", "Ann"), ("f.jsonl::c", "chunk", "B", "Book")], "doc string, source_type string, type string, id string")
    tables = pipeline.GraphTables(nodes, edges, mentions, nodes)
    vectors = spark.createDataFrame([(1, "Book of graphs"), (2, "bread")], "vec_id bigint, content string").withColumn("embedding", stub.embedding(F.col("content")))
    row = pipeline.hybrid_answer(tables, vectors, "Which Book by Other authors is cited?").first()
    assert row.answer.startswith("Answer to: ") and {"vector", "entity", "direct", "neighbour", "subgraph", "path"} <= set(row.kinds)
    wanted = patterns.Pattern(patterns.End(type="P"), (patterns.Step(patterns.End(type="B"), ("WROTE",)),))
    assert {r.kind for r in pipeline.evidence_cascade(tables, "Book", wanted).collect()} == {"pattern"}
    asked = spark.createDataFrame([(1, "graphs", "b"), (2, "bread", "a")], "question_id bigint, question string, category string")
    cases = pipeline.test_cases(vectors, asked, F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")).collect()
    assert {(c.query, c.rag_error, c.timestamp) for c in cases} == {("graphs", None, "2024-01-02T00:00:00Z"), ("bread", None, "2024-01-02T00:00:00Z")}
    failing = pipeline.test_cases(vectors, asked, answer=lambda q, c: F.lit(None).cast("string"))
    assert {c.rag_error for c in failing.collect()} == {"Error: no answer"}
    assert pipeline.merged_report([graph_metrics.report(nodes, edges, mentions, nodes, edges.select(F.struct(F.col("src").alias("id")).alias("source"), F.struct(F.col("dst").alias("id")).alias("target")), ["orphan_ratio"]), spark.sql("select 1 as k")]).first().k == 1


def test_answer_reads_the_relationships_once(spark, data):
    found = answers.hybrid_answer(spark, data)
    assert not any("graph_relationships" in f for f in found.inputFiles())  # each kind of evidence reads the edges that were written
    assert {"vector", "entity", "neighbour", "subgraph"} <= set(found.first().kinds)


def test_chunks_behind_shared_documents(spark, edges):
    mentions = spark.createDataFrame([("f.jsonl::c1", "chunk", "B", "Book"), ("f.jsonl::c1", "chunk", "B", "Other"), ("f.jsonl::c2", "chunk", "P", "Ann")], "doc string, source_type string, type string, id string")
    tables = pipeline.GraphTables(edges.select(F.col("dst_type").alias("type"), F.col("dst").alias("id")).distinct(), edges, mentions, edges)
    chunk = "id string, content string, metadata struct<source: string>, chunk_index int, chunk_key bigint"
    chunks = spark.createDataFrame([("c1", "there", ("f",), 0, 1), ("c1", "elsewhere", ("g",), 0, 2), ("c2", "other", ("f",), 1, 3), (None, "none", ("f",), 2, 4)], chunk)
    told = pipeline.evidence_cascade(tables, "Book Other", chunk_table=chunks).collect()
    assert [r.evidence for r in told if r.kind in ("comention", "chunk")] == ["f.jsonl::c1", "there"]


def test_judges_have_their_own_thresholds(spark, tmp_path):
    cases = spark.createDataFrame([(1, "a", "what is a graph", "a graph is a set", "According to [1], a graph is a set."), (2, "a", "x", "", None)], "test_idx int, category string, query string, context string, final_answer string")
    rows = judges.judge(cases)
    got = {(r.test_idx, r.metric): r for r in rows.collect()}
    assert len(got) == 16 and got[1, "SourceAttribution"].success and got[1, "SourceAttribution"].threshold == 0.3 and got[1, "Tone"].threshold == 0.6
    assert got[2, "Clarity"].error is False or got[2, "Clarity"].score is not None or got[2, "Clarity"].error
    sinks.write_evaluation(rows, str(tmp_path / "e"), "now")
    back = spark.read.json(str(tmp_path / "e" / "detailed_results"))
    assert back.count() == 2 and "metrics" in back.columns and spark.read.json(str(tmp_path / "e" / "summary")).count() == 8


def test_records(spark):
    meta = {"path": "p.png", "page": 3, "section": None, "image_relevance": None, "image_type": "figure", "semantic_role": None, "caption": 'a "b"', "depicted_concepts": ["x"], "confidence": "low"}
    df = spark.createDataFrame([(meta, {"z": "1", "a": "2"})], "m struct<path:string,page:int,section:string,image_relevance:string,image_type:string,semantic_role:string,caption:string,depicted_concepts:array<string>,confidence:string>, e map<string,string>")
    text = df.select(records.snippet(F.col("m"), F.col("e")).alias("t")).first().t
    assert list(json.loads(text)) == [*records.SNIPPET_FIELDS, "a", "z"] and json.loads(text)["caption"] == 'a "b"' and text.startswith('{\n  "path": "p.png",')
    assert records.chosen(["a", "b"], [2, 9, 1, 0]) == ["b", "a"]
    for line, want in (('  "page": "12 of 3",', ("page", "123")), ('"path": "a\\"b",', ("path", 'a"b')), ("caption: 'plain'", ("caption", "plain")), ('"depicted_concepts": ["a"],', ("depicted_concepts", '["a"]'))):
        k, v = records.snippet_value(F.lit(line))
        assert tuple(spark.range(1).select(k.alias("k"), v.alias("v")).first()) == want, line
    assert one(spark, records.listed(F.array(F.lit("it's"), F.lit("b")))) == "['it\\'s', 'b']"
    assert one(spark, records.is_image_source(F.lit(None).cast("string"))) is False
    assert len(one(spark, records.run_id())) == 36 and one(spark, records.latency_ms(F.lit(1.2349))) == 1234


def test_chunks_are_cut_by_tokens(spark):
    body = "supercalifragilistic " * 900
    docs = spark.createDataFrame([(1, "d", body), (2, "e", "x" * 9000), (3, "f", None)], "doc_id bigint, stem string, text string")
    rows = chunking.token_chunks(docs, "doc_id", "text", "stem", granularities=[(500, 50, "_s")]).collect()
    assert max(tokens.count_tokens(r.content) for r in rows) <= 510 and {r.doc_id for r in rows} == {1, 2}
    assert len([r for r in rows if r.doc_id == 2]) > 1


def test_lines_are_numbered_within_their_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(["", json.dumps({"content": "one"}), "{bad", json.dumps({"id": "k", "content": "two"})]) + "\r\n")
    (tmp_path / "b.jsonl").write_text(json.dumps({"content": "three"}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        assert sorted((r.chunk_id, r.content) for r in sources.chunk_lines(spark, str(tmp_path)).collect()) == [("a_2", "one"), ("b_1", "three"), ("k", "two")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_registry_file_is_one_sorted_array(spark, tmp_path):
    for ids in (["b", "a", "a", None, 'q"'], []):
        path = str(tmp_path / f"r{len(ids)}")
        sinks.write_registry(spark.createDataFrame([(i,) for i in ids], "id string"), path)
        text = "\n".join(r.value for r in spark.read.text(path).collect())
        assert json.loads(text) == sorted({i for i in ids if i})


def test_the_latest_row_stays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, at int, v string"
    for name, rows in (("a", [("x", 1, "old"), ("y", 5, "kept")]), ("b", [("x", 3, "new"), ("y", 2, "late")])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("k", "at", "v"), r))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        flows.keep_latest(stream, ["k"], "at", str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "t" / "batch=1")).collect()} == {("x", 3, "new"), ("y", 5, "kept")}


def test_scratch_tables_are_deleted(spark):
    with storage.scratch():
        before = len(storage._written)
        assert storage.materialize(spark.range(3), "x").count() == 3
        path = storage._written[-1][1]
    assert len(storage._written) == before - 0 and not flows._exists(spark, path)


def test_nodes_with_their_own_source(spark, edges):
    from graphloom.operators import cascades

    chunks = spark.createDataFrame([("c_1",), ("c_2",), ("",)], "id string")
    mentions = spark.createDataFrame([("f.jsonl::c_1", "chunk", "P", "Ann")], "doc string, source_type string, type string, id string")
    own = spark.createDataFrame([("Ann", "P", "f.jsonl::c_2"), ("Bob", "P", "c_2"), ("Bob", "P", "c_1")], "id string, type string, source_id string")
    got = {tuple(r) for r in cascades.entities_for_chunks(chunks, mentions, own).collect()}
    assert got == {("c_1", "Ann", "P", 1), ("c_2", "Ann", "P", 3), ("c_2", "Bob", "P", 3)}
    rels = {tuple(r) for r in cascades.relations_for_chunks(chunks, mentions, edges, own).collect()}
    assert ("c_2", "Bob", "WROTE", "Book", 3) in rels and ("c_1", "Bob", "WROTE", "Book", 3) in rels
    held = cascades.contained_pointers(spark.createDataFrame([("_1",), ("x",), (None,)], "chunk_id string"), spark.createDataFrame([("a_10",), ("a_2",), (None,)], "doc string"), block=1)
    assert {tuple(r) for r in held.collect()} == {("_1", "a_10")}


def test_long_texts_are_retrieved_in_time(spark):
    began = time.monotonic()
    texts = spark.range(200).select((F.col("id") + 1).alias("vec_id"), F.concat(F.lit("node "), F.repeat(F.lit("some words of a long text "), 1000), F.when(F.col("id") == 7, F.repeat(F.lit("zebra "), 5000)).otherwise("")).alias("content"))
    asked = spark.createDataFrame([(1, "zebra")], "question_id bigint, question string")
    hits = pipeline.retrieve(texts.withColumn("embedding", stub.embedding(F.col("content"))), asked, 1).collect()
    assert [h.vec_id for h in hits] == [8] and time.monotonic() - began < 90


def test_a_report_gives_back_what_it_wrote(spark):
    before = len(storage._written)
    row = storage.one_row(spark, lambda: storage.materialize(spark.range(1).selectExpr("id", "cast(null as double) as x"), "x"))
    assert len(storage._written) == before and [tuple(r) for r in row.collect()] == [(0, None)]
