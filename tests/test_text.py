"""Text, image, chunking, vector, search, evaluation, source, sink and stream operators on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import pipeline, sinks, sources
from graphloom.functions import text as fn, vector as vx
from graphloom.models import stub
from graphloom.operators import chunking, evaluation, images, lines, search, skew, vectors
from graphloom.streaming import flows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("line,ok", [("## Title", True), ("# Title", False), ("### **Bold**", True), ("**3.1** **Stacks**", True), ("**Abstract**", True), ("**Other**", False), ("text", False), (None, None)])
def test_header(spark, line, ok):
    assert one(spark, line, fn.is_header) == ok


@pytest.mark.parametrize("line,dropped", [("12", True), (" xiv ", True), ("New York Chicago", True), ("----------", True), ("*", True), ("ok", False), ("", False), ("This page intentionally left blank", True)])
def test_dropped_lines(spark, line, dropped):
    assert one(spark, line, fn.dropped_line) == dropped


def test_names_and_ids(spark):
    assert one(spark, "x/a.b.pdf-2-0.PNG", lambda c: fn.image_id(c, F.lit("m"))) == "img_a.b_2_0"
    assert one(spark, "x/odd-7-1.png", lambda c: fn.image_id(c, F.lit("m"))) == "img_m_7_0"
    assert one(spark, "x/none.png", lambda c: fn.image_id(c, F.lit("m"))) == "img_m_0_0"
    assert one(spark, "a.JPG", fn.media_type) == "image/jpeg" and one(spark, "a", fn.media_type) == "image/png"
    assert one(spark, "", fn.sentences) == [""] and one(spark, "A. B! C", fn.sentences) == ["A.", "B!", "C"]
    assert one(spark, " \n ", fn.context_parts) == [" \n "] and one(spark, "a\n\n \n\nb", fn.context_parts) == ["a", "b"]


def test_prompt_expands_in_order(spark):
    df = spark.createDataFrame([("{chunk} | {entities}", "has {entities}", ["x", "y"]), ("{entities}", "c", [])], "t string, c string, k array<string>")
    got = [r.p for r in df.select(fn.fill_prompt(F.col("t"), F.col("c"), F.col("k")).alias("p")).collect()]
    assert got == ["has x, y | x, y", "None"]


MD = "## A\n12\n![x](p/q.pdf-3-0.png) tail ![y](z.png)\n## B\n![](w.png)"


def test_image_refs_and_ids(spark):
    docs = spark.createDataFrame([(1, MD, "m", "s"), (2, None, "m", "s"), (3, "", "m", "s")], "doc_id bigint, text string, stem string, section string")
    rows = images.image_refs(docs, "doc_id", "text").orderBy("line_no", "pos").collect()
    assert [(r.image_path, r.page_number, r.section_header, r.line_no) for r in rows] == [("p/q.pdf-3-0.png", 3, "A", 3), ("z.png", 12, "A", 3), ("w.png", 12, "B", 5)]
    done = {r.doc_id: r.text for r in images.assign_ids(docs, "doc_id", "text", F.col("stem")).collect()}
    assert "img_q_3_0" in done[1] and "img_m_0_0" in done[1] and "![" not in done[1] and done[3] == "" and 2 not in done


def test_blocks_keep_the_last_of_an_id_and_skip_bad_ones(spark):
    text = '```json\n"img_a": {"path": "p", "page": 1, "caption": "c", "depicted_concepts": ["x", " ", "x "],}\n```\n```JSON\nbroken\n```\n```json\n"img_a": {"path": "r", "caption": "d", "section": "S", "depicted_concepts": ["y"]}, "other": {"path": "o"}\n```'
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = images.block_images(docs, "doc_id", "text").collect()
    assert [(r.image_id, r.meta.path, r.meta.caption) for r in found] == [("img_a", "r", "d")]
    graph = images.image_graph(images.block_images(docs, "doc_id", "text"), F.lit("doc"))
    assert {(r.rel, r.dst) for r in graph.collect()} == {("PART_OF", "doc"), ("LOCATED_IN", "doc::section::S"), ("DEPICTS", "y")}


def test_fence_that_never_ends(spark):
    docs = spark.createDataFrame([(1, "a\n```json\nb\n```\nc\n```\nd")], "k bigint, text string")
    rows = lines.in_fence(lines.lines(docs, "k", "text"), "k").orderBy("line_no").collect()
    assert [r.fenced for r in rows] == [False, True, True, True, False, True, True]


def test_recursive_split_bounds_and_overlap():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(20))
    pieces = chunking.recursive_split(text, 50, 10)
    assert all(len(p.split()) <= 50 for p in pieces) and set(" ".join(pieces).split()) == set(text.split())
    assert chunking.recursive_split("", 5, 1) == [] and chunking.recursive_split("word", 5, 1) == ["word"]
    long = chunking.recursive_split("x" * 1000, 100, 10, len)
    assert all(len(p) <= 100 for p in long)


def test_batches_follow_the_log_of_ten_chunks(spark):
    sizes = [1300, 1300, 1300, 1300, 1350, 1350, 1350, 1350, 1400, 1400]
    rows = spark.createDataFrame([("f", i, "x" * (4 * s)) for i, s in enumerate(sizes)] + [("f", 10, ""), ("f", 11, None), ("g", 0, "y" * 40_000), ("g", 1, "z")], "file string, chunk_index int, content string")
    got = chunking.adaptive_batches(rows, "file", "chunk_index", "content").orderBy("file", "chunk_index").collect()
    assert [r.batch for r in got if r.file == "f"] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r.batch for r in got if r.file == "g"] == [0, 1]


def test_vectors_zero_null_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    got = vectors.knn(q, v, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 1, 0.0), (3, 2, 0.0), (5, 5, 1.0), (5, 1, 0.0)]
    assert vectors.knn(q.limit(0), v, 2).count() == 0 and vectors.knn(q, v.limit(0), 2).count() == 0
    row = v.select(vx.cosine(F.col("embedding"), F.col("embedding")).alias("c"), vx.l2_distance(F.col("embedding"), F.col("embedding")).alias("d")).where("c is not null").first()
    assert (row.c, row.d) == (1.0, 0.0)


def test_approximate_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    m = centres[rng.integers(0, 20, 600)] + 0.25 * rng.normal(size=(600, 16))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.knn(q, v, 5).collect()}
    near = {(r.query_id, r.vec_id) for r in vectors.lsh_neighbours(v, q, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_approximate_neighbours_of_the_table_reach_the_recall(spark, data):
    from graphloom.plans import REGISTRY

    exact, near = ({(r.query_id, r.vec_id) for r in REGISTRY[name](spark, data).collect()} for name in ("cosine_topk", "lsh_topk"))
    assert len(exact & near) / len(exact) >= 0.93


def test_bm25_counts_over_all_documents(spark):
    d = spark.createDataFrame([(1, "graph graph node"), (2, "graph"), (3, None), (4, "other")], "id bigint, text string")
    got = search.bm25(d, "id", "text", "Graph node").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score > got[1].score
    assert search.bm25(d.limit(0), "id", "text", "graph").count() == 0


def test_evaluation_edges(spark):
    rows = spark.createDataFrame(
        [(1, "a", "m", 0.9, None, 0.5, 1.0, False, False), (1, "a", "n", None, None, 0.5, 1.0, True, False), (2, "a", "m", 0.1, None, 0.5, 1.0, False, False), (3, None, "n", None, None, 0.5, None, False, True)],
        "test_idx int, category string, metric string, score double, success boolean, threshold double, secs double, error boolean, skipped boolean",
    )
    j = evaluation.judged(rows)
    assert {r.test_idx: r.overall_passed for r in evaluation.overall(j).collect()} == {1: False, 2: False, 3: True}
    s = {r.metric: r for r in evaluation.metric_summary(j).collect()}
    assert (s["m"].pass_rate, s["n"].pass_rate, s["n"].errors, s["n"].min_score) == (50.0, 0.0, 1, None)
    wide = {r.test_idx: r for r in evaluation.wide(j, ["m", "n"]).collect()}
    assert (wide[1].m_score, wide[1].n_error, wide[3].n_skipped, wide[3].m_status) == ("0.9000", "Yes", "Yes", "N/A")
    assert evaluation.overall_rate(j.limit(0)).first().rate == 0.0
    assert {r.category for r in evaluation.category_rollup(j, ["m", "n"]).collect()} == {"a", None}


def test_salted_join_and_ranks_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 50)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", 2.0) for i in range(600)] + [(999, None, 1.0)], "id bigint, key string, w double")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    hot = skew.hot_keys(right, "key")
    assert hot == [("hot", 3)]
    assert skew.salted_join(left, right, "key", hot, F.col("id")).count() == 600
    ranked = skew.bucketed_rank(left, ["key"], "id", rows_a_bucket=50).collect()
    by_key = {}
    for r in ranked:
        by_key.setdefault(r.key, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by_key.values())


def test_files_round_trip(spark, tmp_path):
    good = {"id": None, "content": "text", "metadata": {"source": "m.md"}, "chunk_index": 0, "token_size_config": 2000}
    (tmp_path / "a_2k.jsonl").write_text(json.dumps(good) + "\n\n{bad\n" + json.dumps(good | {"id": "x", "content": ""}) + "\n" + json.dumps(good | {"id": "y"}) + "\n")
    rows = sources.chunk_lines(spark, str(tmp_path / "a_2k.jsonl")).orderBy("line_no").collect()
    assert [r.chunk_id for r in rows] == ["a_2k_1", "y"]
    graph = {"nodes": [{"id": "a", "type": "T", "metadata": [{"key": "k", "value": "1"}, {"key": "k", "value": "2"}]}, {"id": "b", "type": "T", "metadata": []}], "relationships": [{"source": {"id": "a", "type": "T"}, "target": {"id": "b", "type": "T"}, "type": "R"}]}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "g.jsonl").write_text(json.dumps(graph) + "\n{broken\n")
    docs = sources.graph_lines(spark, str(tmp_path / "g"))
    assert [(r.source.source_id, r.source.source_type) for r in docs.collect()] == [("unknown", "chunk")]
    tables = pipeline.ingest(docs)
    assert (tables.nodes.count(), tables.edges.count(), tables.mentions.count()) == (2, 1, 2)
    assert tables.properties.first()["values"] == ["1", "2"]
    sinks.write_graph_tables(tables.nodes, tables.edges, tables.mentions, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).count() == 1
    sinks.write_registry(tables.nodes, str(tmp_path / "reg"))
    assert sorted(r.id for r in sources.registry(spark, str(tmp_path / "reg")).collect()) == ["a", "b"]
    assert sources.registry(spark, str(tmp_path / "missing")).count() == 0
    assert sources.key_value(str(tmp_path / "none.json"), "k", 3) == 3
    (tmp_path / "q.csv").write_text('Category,Question\nA,"say ""hi"", now"\nB,two\n')
    assert [r.Question for r in sources.questions(spark, str(tmp_path / "q.csv")).orderBy("row_no").collect()] == ['say "hi", now', "two"]
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "p_1.jpg").write_bytes(b"abc")
    (tmp_path / "img" / "note.txt").write_text("x")
    assert [(r.name, r.media_type, r.base64) for r in sources.image_files_by_prefix(spark, str(tmp_path / "img"), "p_").collect()] == [("p_1.jpg", "image/jpeg", "YWJj")]
    pdf = sources.to_markdown(sources.binary_files(spark, str(tmp_path / "img")), lambda path, content: "![a](b) ![c](d)" if path.endswith("jpg") else 1 / 0)
    assert {(r.ok, r.images) for r in pdf.collect()} == {(True, 2), (False, 0)}


def test_cases_and_sheets(spark, tmp_path):
    names = [f.name for f in sources.files.schema.SIMPLE_CASE.fields]
    cases = spark.createDataFrame([("q1 long", "A", "c1\n\nc2", "answer q1", *[None] * 7), ("", "A", "c", "x", *[None] * 7)], sources.files.schema.SIMPLE_CASE)
    assert names[0] == "query" and sinks.write_cases(cases, str(tmp_path / "c"), hybrid=False)
    back = sources.test_cases(spark, str(tmp_path / "c"), hybrid=False)
    assert back.count() == 2
    usable = evaluation.usable_cases(back).collect()
    assert [r.context_parts for r in usable] == [["c1", "c2"]]
    rows = pipeline.evaluate(back, {"m": 0.5})
    assert [r.success for r in rows.collect()] == [True]
    assert set(sinks.evaluation_sheets(rows, ["m"], str(tmp_path / "s"))) == {"Summary", "Detailed", "Breakdown", "Category"}
    assert not sinks.write_cases(cases.limit(0), str(tmp_path / "none"), hybrid=False)


def test_streams_keep_the_registry_and_windows(spark, tmp_path):
    line = lambda *ids: json.dumps({"nodes": [{"id": i, "type": "T"} for i in ids], "relationships": [], "source": None})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(line("x", "y", " "))
    for extra in (None, line("y", "z")):
        if extra:
            (tmp_path / "in" / "b.json").write_text(extra)
        flows.keep_registry(flows.read_graph_lines(spark, str(tmp_path / "in")), str(tmp_path / "reg"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "reg")).collect()) == ["x", "y", "z"]
    traces = spark.createDataFrame([("2024-01-01 00:01:00", (10,)), ("2024-01-01 00:09:00", (30,))], "timestamp_utc string, latency_ms struct<total:int>")
    assert flows.trace_latency(traces).first().mean_ms == 20.0
    items = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    assert flows.latest_properties(items, ["k", "v"], "k").count() == 2


def test_providers_and_retrieval(spark):
    assert one(spark, None, stub.entities) == [] and one(spark, "a and b? c", stub.subqueries) == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "graph nodes link words"), (2, "bread and butter")], "vec_id bigint, text string").withColumn("embedding", stub.embedding(F.col("text")))
    q = spark.createDataFrame([(1, "graph nodes")], "question_id bigint, question string")
    assert pipeline.retrieve(docs, q, 1).first().vec_id == 1
    words = spark.createDataFrame([("T", "Sparse Attention"), ("T", "Dense Memory")], "type string, id string")
    assert pipeline.resolve(words, "What is sparse attention?").first().id == "Sparse Attention"
    md = spark.createDataFrame([(1, "one two three", "m")], "doc_id bigint, text string, stem string")
    assert pipeline.chunk_and_embed(md).first().id == "m_chunks_2k_0"


def test_command_line_lists_queries(capsys):
    from graphloom import cli

    assert cli.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out


def test_evidence_and_nested_extraction(spark):
    nested = '{"a": ["x.jsonl::1", {"b": "y.jsonl::2"}, "x.jsonl::1", "plain"], "k": 3, "z": {"k": 5}}'
    assert one(spark, (["x.jsonl::1", "p", "y.jsonl::2", "x.jsonl::1"],), lambda c: fn.nested_strings(c, ".jsonl::"), "struct<a:array<string>>") == ["x.jsonl::1", "y.jsonl::2"]
    assert one(spark, nested, lambda c: fn.nested_int(c, "k")) == 5 and one(spark, "{}", lambda c: fn.nested_int(c, "k")) is None
    assert one(spark, "Images:\n- a | p\n- b | q\n- a | r\n", fn.evidence_ids) == ["a", "b"]
    assert one(spark, "answer", lambda c: fn.with_block(c, "Images:", F.lit("- a"))) == "answer\n\nImages:\n- a"
    assert one(spark, "has Images: x", lambda c: fn.with_block(c, "Images:", F.lit("- a"))) == "has Images: x"
    assert one(spark, "answer", lambda c: fn.with_block(c, "Images:", F.lit(""))) == "answer"
    assert one(spark, "top\nSources:\n- a\n- b\n\nrest", lambda c: fn.without_section(c, "Sources:")) == "top\nrest"
    df = spark.createDataFrame([("paper_3", "paper"), ("f::paper_3", "paper"), ("other", "paper")], "s string, t string")
    assert [r.r for r in df.select(fn.without_prefix(F.col("s"), F.col("t")).alias("r")).collect()] == ["3", "f::paper_3", "other"]
    key, value = fn.snippet_field(F.col("v"))
    rows = spark.createDataFrame([('  "path": "a b.png",',), ('  "page": 12',), ("}",)], "v string").select(key.alias("k"), value.alias("x")).collect()
    assert [(r.k, r.x) for r in rows] == [("path", "a b.png"), ("page", "12"), (None, None)]


def test_a_hub_does_not_fill_one_task(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 50)
    edges = spark.range(8000).select(F.concat(F.lit("n"), (F.col("id") % 700).cast("string")).alias("src"), F.when(F.col("id") % 10 == 0, F.lit("hub")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("dst"))
    ids = edges.select(F.col("dst")).distinct()
    before, adaptive = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.hub_join(edges, ids, "dst", ["src"])
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 8000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_chunks_of_the_same_id_in_two_files(spark):
    from graphloom.operators import cascades

    c = spark.createDataFrame([("1", "one", ("a.md",), 0, 1), ("1", "two", ("b.md",), 0, 2)], "id string, content string, metadata struct<source:string>, chunk_index int, chunk_key bigint")
    p = spark.createDataFrame([("a.jsonl::1",), ("b.jsonl::1",), ("c.jsonl::1",)], "doc string")
    got = {(r.doc, r.status, r.content) for r in cascades.chunk_by_pointer(p, c).collect()}
    assert got == {("a.jsonl::1", "OK", "one"), ("b.jsonl::1", "OK", "two"), ("c.jsonl::1", "NOT_FOUND_IN_FILE", None)}


def test_embeddings_read_a_text_once(spark):
    rows = spark.createDataFrame([(1, "b a a"), (2, ""), (3, None), (4, "!?"), (5, "Graph nodes link words " * 2000)], "k int, t string").select("k", stub.embedding(F.col("t")).alias("e"), stub.embedding(F.col("t"), 3).alias("narrow"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    got = {r.k: r for r in rows.collect()}
    assert got[3].e is None and got[2].e == got[4].e == [0.0] * 64 and len(got[5].narrow) == 3
    hashed = spark.createDataFrame([("a",), ("b",)], "w string").select(F.pmod(F.xxhash64("w"), F.lit(64)).alias("i"), (F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0).alias("plus")).collect()
    want = [0.0] * 64
    for r, n in zip(hashed, (2, 1)):
        want[r.i] += n if r.plus else -n
    length = sum(x * x for x in want) ** 0.5
    assert got[1].e == [x / length for x in want]
