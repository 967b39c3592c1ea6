"""Graph operators on small fixtures: ties, self-loops, nulls, empty graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cascades, graph_build as build, graph_match as match, graph_metrics as metrics

EDGE = "src_type string, src string, rel string, dst_type string, dst string, extra string"
NODE = "type string, id string, a string, b string"


def edges(spark, pairs):
    return spark.createDataFrame([("C", a, r, "C", b, "x") for a, r, b in pairs], EDGE)


def nodes(spark, ids):
    return spark.createDataFrame([("C", i, "x", "y") for i in ids], NODE)


def test_self_loops_count_once_and_are_their_own_reverse(spark):
    e = edges(spark, [("a", "R", "a"), ("a", "R", "b"), ("b", "R", "a"), ("b", "S", "c")])
    assert {(r.id, r.degree) for r in metrics.degrees(e).collect()} == {("a", 3), ("b", 3), ("c", 1)}
    assert metrics.reciprocal(e).count() == 3


def test_empty_graph_reports_zeros(spark):
    e, n = edges(spark, []), nodes(spark, [])
    raw_n = spark.createDataFrame([], "id string, type string")
    raw_e = spark.createDataFrame([], "source struct<id:string,type:string>, target struct<id:string,type:string>, type string")
    m = spark.createDataFrame([], "doc string, source_type string, type string, id string")
    r = metrics.report(n, e, m, raw_n, raw_e).first()
    assert (r.nodes, r.rels, r.orphan_ratio, r.relationship_density, r.component_ratio, r.max_degree, r.avg_entities_per_document) == (0, 0, 0.0, 0.0, 0.0, None, None)
    assert match.strongest_pair(e).count() == 0 and match.direct_edges(e, match.strongest_pair(e)).count() == 0
    assert match.connected_components(n, e).count() == 0


def test_blank_ids_make_no_nodes_and_last_type_wins(spark):
    raw = spark.createDataFrame([(1, "a", "X"), (2, "a", "Y"), (3, " ", "X"), (4, None, "X"), (2, "a", "Y")], "pos int, id string, type string")
    assert {(r.type, r.id) for r in build.nodes(raw).collect()} == {("X", "a"), ("Y", "a")}
    assert [(r.id, r.type, r.first_at) for r in build.nodes_last_wins(raw, ["pos"]).collect()] == [("a", "Y", 1)]


def test_merge_needs_both_endpoints(spark):
    e = edges(spark, [("a", "R", "b"), ("a", "R", "z")])
    assert build.edges_with_endpoints(e, nodes(spark, ["a", "b"])).count() == 1


def brute_components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(28)] + [(ids[i], ids[i + 1]) for i in range(8)]
    got = {r.id: r.component for r in match.connected_components(nodes(spark, ids), edges(spark, [(a, "R", b) for a, b in pairs])).collect()}
    assert got == brute_components(ids, pairs)


def test_shortest_path_is_the_smallest(spark):
    e = edges(spark, [("s", "R", "m2"), ("m1", "R", "s"), ("m2", "R", "t"), ("m1", "R", "t"), ("t", "R", "u"), ("s", "R", "s")])
    assert match.shortest_path(e, "s", "t").first().path == ["s", "m1", "t"]
    assert match.shortest_path(e, "s", "u").first().hops == 3
    assert match.shortest_path(e, "s", "nowhere").count() == 0
    assert match.shortest_path(e, "s", "s").first().path == ["s"]


def test_shortest_path_writes_its_links_once(spark, monkeypatch):
    written, write = [], match.materialize
    monkeypatch.setattr(match, "materialize", lambda df, label, *rest: written.append(label) or write(df, label, *rest))
    e = edges(spark, [("s", "R", "m"), ("m", "R", "t"), ("m", "Q", "s"), (None, "R", "t"), ("t", "R", "t")])
    assert match.shortest_path(e, "s", "t").first().path == ["s", "m", "t"]
    assert written.count("links") == 1


def test_allow_list_and_patterns(spark):
    assert match.allowed_types(["A", "B", "C"], ["C", "A"]) == (["A", "C"], ["B"])
    e = edges(spark, [("a", "R", "b"), ("b", "R", "a"), ("a", "S", "a")])
    assert match.match(e, "C", ["R"], "C").count() == 2
    assert match.match(e, "C", None, "C", directed=False).count() == 3


def test_top_concepts_falls_back_to_any_type(spark):
    rows = spark.createDataFrame([("a", "Model", 1), ("b", "Concept", 2), ("c", "Concept", 3)], "id string, type string, rank int")
    assert [r.id for r in match.top_concepts(rows).collect()] == ["b", "c"]
    few = rows.where("id <> 'c'")
    assert [r.id for r in match.top_concepts(few).collect()] == ["a", "b"]


CHUNK = "chunk_key bigint, id string, content string, metadata struct<source:string>, chunk_index int"


def test_cascade_takes_the_first_rule_per_chunk(spark):
    m = spark.createDataFrame(
        [("f_1.jsonl::f_1_1", "chunk", "C", "x"), ("f_1.jsonl::f_1_10", "chunk", "C", "y"), ("g.jsonl::old_7", "chunk", "C", "z"), ("g::batch::unknown", "chunk", None, "w")], "doc string, source_type string, type string, id string"
    )
    c = spark.createDataFrame([(1, "f_1_1", "t", ("f",), 0), (2, "g_7", "t", ("g",), 0), (3, None, "t", ("g",), 1), (4, "", None, None, None)], CHUNK)
    got = {(r.chunk_id, r.id, r.rule) for r in cascades.entities_for_chunks(c, m).collect()}
    assert got == {("f_1_1", "x", 1), ("g_7", "z", 2)}
    e = edges(spark, [("x", "R", "x"), ("x", "R", "y")])
    assert [(r.src, r.dst) for r in cascades.relations_for_chunks(c, m, e).collect()] == [("x", "x")]
    source = {(r.src, r.dst): (r.doc, r.rule) for r in cascades.relation_source(edges(spark, [("x", "R", "y"), ("q", "R", "y"), ("q", None, "q")]), m).collect()}
    assert source == {("x", "y"): ("f_1.jsonl::f_1_1", 2), ("q", "y"): ("f_1.jsonl::f_1_10", 3), ("q", "q"): (None, None)}


def test_coverage_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "chunk_id string, item string")
    some = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", None)], "chunk_id string, item string")
    assert cascades.coverage(none, some).first().coverage == 0.0
    assert cascades.coverage(some, spark.createDataFrame([("c", "a")], "chunk_id string, item string")).first().coverage == 0.25


def test_chunk_by_pointer_flags_what_is_missing(spark):
    c = spark.createDataFrame([(1, "a_1", "one", ("f",), 0), (2, "a_1", "two", ("f",), 0)], CHUNK)
    p = spark.createDataFrame([("f.jsonl::a_1",), ("f.jsonl::zz",), ("f.md::images",), (None,)], "doc string")
    assert {(r.chunk_id, r.status, r.content) for r in cascades.chunk_by_pointer(p, c).collect()} == {("a_1", "OK", "one"), ("zz", "NOT_FOUND_IN_FILE", None)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("k", "1"), ("m", "2")], "key string, value string")
    new = spark.createDataFrame([("k", "9"), ("n", "3")], "key string, value string")
    once = build.upsert(old, new, ["key"])
    assert {tuple(r) for r in once.collect()} == {("k", "9"), ("m", "2"), ("n", "3")}
    assert {tuple(r) for r in build.upsert(once, new, ["key"]).collect()} == {tuple(r) for r in once.collect()}


MENTIONS = "doc string, source_type string, type string, id string"


def written_rows(spark) -> int:
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def dense(spark):
    """Pointers of eight ids each, ids of many pointers, edges among all of them: few pointers hold a given edge."""
    docs = {f"f_{i}.jsonl::f_{i}_{i % 7}": {f"x{(i * 37 + j * j * (i % 11 + 1)) % 100}" for j in range(8)} for i in range(400)}
    docs["unknown"] = {f"x{j}" for j in range(90)}
    m = spark.createDataFrame([(d, "chunk", "C", x) for d, xs in docs.items() for x in xs] + [("z.md::images", "chunk", "C", "x99")], MENTIONS)
    docs["z.md::images"] = {"x99"}
    rows = [(f"x{a}", r, f"x{b}") for a in range(100) for b in range(100) for r in (["R", None] if (a + b) % 9 == 0 else ["R"])] + [("x1", "R", "gone"), ("gone", None, "lost")]
    return docs, m, rows, edges(spark, rows)


def first_pointers(docs, rows):
    holds = {}
    for d in sorted(docs):
        for x in docs[d]:
            holds.setdefault(x, []).append(d)
    out = set()
    for s, r, t in rows:
        both = [d for d in holds.get(s, []) if t in docs[d]]
        found = next(((x[0], n) for n, x in enumerate((both, holds.get(s, []), holds.get(t, [])), 1) if x), (None, None))
        out.add((s, r, t, *found))
    return out


def test_relation_source_shuffles_what_pointers_hold(spark, dense):
    docs, m, rows, e = dense
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written_rows(spark)
        got = [tuple(r) for r in cascades.relation_source(e, m).collect()]
        assert written_rows(spark) - before < 150_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows) and set(got) == first_pointers(docs, rows)


def test_relation_source_of_large_pointers_and_equal_numbers(spark, dense, monkeypatch):
    docs, m, rows, e = dense
    plain, seeds = cascades._numbers, []

    def numbers(column, seed):
        seeds.append(seed)
        other = plain(column, seed)
        return F.struct(F.pmod(other["k"], F.lit(50)).alias("k"), other["o"].alias("o")) if seed == 0 else other

    monkeypatch.setattr(cascades, "LARGEST", 7)
    monkeypatch.setattr(cascades, "_numbers", numbers)
    assert {tuple(r) for r in cascades.relation_source(e, m).collect()} == first_pointers(docs, rows) and max(seeds) == 1


@pytest.mark.parametrize("largest, most", [(500, 88_000), (7, 231_000)])
def test_redirected_source_is_told_by_its_number(spark, dense, monkeypatch, largest, most):
    docs, m, rows, e = dense
    shown = {f"a_{i}.md::images": {f"x{(i * 7 + j) % 100}" for j in range(3)} for i in range(40)} | {"b.md": {"lost"}}
    held = {**docs, **shown}
    more = m.unionByName(spark.createDataFrame([(d, "image", "C", x) for d, xs in shown.items() for x in xs], MENTIONS))
    image = lambda d: d is not None and (d.endswith("::images") or ".md" in d)
    real = {}
    for d in sorted(held, reverse=True):
        real.update({} if image(d) else dict.fromkeys(held[d], d))
    want = {(s, r, t, real.get(t, d) if image(d) else d, n) for s, r, t, d, n in first_pointers(held, rows)}
    assert {x[4] for x in want if image(x[3])} == {2, 3} and want != first_pointers(held, rows)
    monkeypatch.setattr(cascades, "LARGEST", largest)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written_rows(spark)
        got = [tuple(r) for r in cascades.relation_source(e.unionByName(e), more, redirect_images=True).collect()]
        shuffled = written_rows(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled < most and len(got) == len(rows) and set(got) == want


def chunk_relations(docs, rows, chunks):
    return {(c, s, r, t) for c in chunks for d in docs if c in (d, d.rpartition("::")[2]) for s, r, t in rows if s in docs[d] and t in docs[d]}


def test_relations_of_chunks_shuffle_what_pointers_hold(spark, dense, monkeypatch):
    docs, m, rows, e = dense
    more = m.unionByName(m.where("doc like 'f_1_.jsonl%'").select(F.regexp_replace("doc", r"\.jsonl::", "::batch::").alias("doc"), "source_type", "type", "id"))  # second pointers of the same chunks
    held = {**docs, **{d.replace(".jsonl::", "::batch::"): x for d, x in docs.items() if d.startswith("f_1") and d[4:10] == ".jsonl"}}
    ids = [f"f_{i}_{i % 7}" for i in range(400)]
    chunks = spark.createDataFrame([(i, c, "t", ("f",), 0) for i, c in enumerate([*ids, "unknown", None, ""])], CHUNK)
    want = chunk_relations(held, rows, [*ids, "unknown"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written_rows(spark)
        got = [(r.chunk_id, r.src, r.rel, r.dst) for r in cascades.relations_for_chunks(chunks, more, e).collect()]
        shuffled = written_rows(spark) - before
        monkeypatch.setattr(cascades, "LARGEST", 7)
        again = [(r.chunk_id, r.src, r.rel, r.dst) for r in cascades.relations_for_chunks(chunks, more, e).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled < 120_000 and len(got) == len(again) == len(want) and set(got) == set(again) == want


def test_linked_pairs_start_at_what_is_asked(spark, dense):
    docs, m, rows, e = dense
    key = lambda a, b: F.concat_ws("|", F.lower(F.trim(a)), F.lower(F.trim(b)))
    ids = [f"f_{i}_{i % 7}" for i in range(400)]
    chunks = spark.createDataFrame([(i, c, "t", ("f",), 0) for i, c in enumerate(ids)], CHUNK)
    asked = spark.createDataFrame([(c, f"x{a}|x{(a * 3 + i) % 100}") for i, c in enumerate(ids) for a in range(0, 100, 7)] + [(ids[0], None)], "chunk_id string, item string")
    there = {(c, f"{s}|{t}") for c, s, _, t in chunk_relations(docs, rows, ids)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written_rows(spark)
        got = {tuple(r) for r in cascades.linked_pairs(asked, chunks, m, e, key).collect()}
        assert written_rows(spark) - before < 100_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == there & {tuple(r) for r in asked.collect()} and got
