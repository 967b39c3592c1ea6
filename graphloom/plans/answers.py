"""Questions answered, chunks turned into graphs, reports merged: the end-to-end plans, each with its SQL twin where SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom import storage
from graphloom.functions import records
from graphloom.models import judges, stub
from graphloom.operators import cascades, evaluation, extraction, graph_build, patterns
from graphloom.plans import retrieval
from graphloom.plans.graph import CTE, ORACLES as GRAPH_ORACLES, QUERIES as GRAPH_QUERIES, Graph
from graphloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_EXTRACT = """with c as (select id, content, regexp_replace(id, '_[0-9]+$', '') || '.jsonl::' || id as doc, regexp_extract_all(content, '[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+') as e
  from chunks where length(content) > 0 and length(id) > 0),
x as (select doc, id, e, unnest(range(1, len(e))) as i from c where len(e) > 1),
r as (select distinct doc, id, e[i] as src, e[i + 1] as dst from x where e[i] <> e[i + 1])
"""


@query(_EXTRACT + "select distinct doc, src, 'MENTIONS' as rel, dst from r")
def graph_from_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the graph documents that an extraction provider makes of the chunks, under the pointer set from the chunk."""
    documents = extraction.chunk_documents(table(spark, d, "chunks"))
    rows = documents.select("doc", F.explode("relationships").alias("r"))
    return rows.select("doc", F.col("r.source").alias("src"), F.col("r.type").alias("rel"), F.col("r.target").alias("dst")).distinct()


@query(_EXTRACT + "select distinct doc as src, 'EXTRACTED' as rel, 'Concept' as dst_type, unnest(e) as dst from c")
def extracted_provenance(spark: SparkSession, d: str) -> DataFrame:
    """EXTRACTED edges from the source of each extracted document to its nodes."""
    return extraction.provenance(extraction.chunk_documents(table(spark, d, "chunks")))


@query(CTE + "select distinct doc as src, 'EXTRACTED' as rel, type as dst_type, id as dst from mentions")
def graph_provenance(spark: SparkSession, d: str) -> DataFrame:
    """EXTRACTED edges of the graph that is there."""
    return extraction.provenance_edges(Graph(spark, d).mentions)


@query(
    _EXTRACT.replace("with c as", CTE + ", c as", 1)
    + """, men as (select distinct id as chunk_id, lower(trim(src)) || chr(31) || lower(trim(dst)) as item from r),
ptr as (select distinct doc, string_split(doc, '::')[-1] as last from mentions),
link as (select distinct c.id as chunk_id, p.doc from (select distinct id from chunks where length(id) > 0) c join ptr p on c.id = p.last or c.id = p.doc),
i as (select distinct doc, chunk_id, m.id from mentions m join link using (doc)),
cov as (select distinct s.chunk_id, lower(trim(e.src)) || chr(31) || lower(trim(e.dst)) as item from (select distinct src, dst from edges) e join i s on s.id = e.src join i t on t.id = e.dst and t.doc = s.doc and t.chunk_id = s.chunk_id),
sh as (select men.chunk_id, count(cov.item) / count(*)::double as share from men left join cov on men.chunk_id = cov.chunk_id and men.item = cov.item group by 1)
select count(*) as chunks, coalesce(round(avg(share), 6), 0)::double as coverage from sh"""
)
def relation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Relation coverage of chunks: pairs that an extraction provider finds in the text against pairs that the graph links in the chunk.

    Providers and graph name relation types differently, so the ends are compared.
    """
    g = Graph(spark, d)
    key = lambda a, b: F.concat_ws("\x1f", F.lower(F.trim(a)), F.lower(F.trim(b)))
    found = g.chunks.where((F.length("content") > 0) & (F.length("id") > 0)).select(F.col("id").alias("chunk_id"), F.explode(stub.relations(F.col("content"))).alias("r"))
    mentioned = found.select("chunk_id", key(F.col("r.source"), F.col("r.target")).alias("item"))
    return cascades.coverage(mentioned, cascades.linked_pairs(mentioned, g.chunks, g.mentions, g.edges, key))


@query(
    CTE
    + """, e as (select distinct src_type, src, rel, dst_type, dst from edges), u as (select src as a, rel, dst_type, dst as b from e union all select dst, rel, src_type, src from e where src <> dst)
select distinct e.src as n0, e.rel as r1, e.dst as n1, u.rel as r2, u.b as n2 from e join u on e.dst = u.a
where e.src_type = 'Concept' and contains(lower(e.src), 'ra') and e.rel in ('INTRODUCED_BY', 'BUILDS_ON', 'SUPPORTS') and e.dst_type = 'Concept' and u.dst_type = 'Concept' and suffix(lower(u.b), 'n')"""
)
def pattern_paths(spark: SparkSession, d: str) -> DataFrame:
    """A pattern of two steps with type, id and relationship conditions, as a model would specify it."""
    step = patterns.Step(patterns.End(type="Concept"), ("INTRODUCED_BY", "BUILDS_ON", "SUPPORTS"))
    last = patterns.Step(patterns.End(type="Concept", ends_with="N"), directed=False)
    return patterns.compiled(patterns.Pattern(patterns.End(type="Concept", contains="Ra"), (step, last)), Graph(spark, d).edges)


@query(
    CTE
    + """select distinct src as n0, rel as r1, dst as n1, true as retried from edges where src_type = 'Image' and dst_type = 'Concept'
order by n0, coalesce(r1, ''), n1 limit 40"""
)
def pattern_retried(spark: SparkSession, d: str) -> DataFrame:
    """A pattern whose only relationship type does not exist: made sound, it runs again with any type. The limit is the pattern's."""
    g = Graph(spark, d)
    wanted = ("NO_SUCH_TYPE",)
    known = {r.rel for r in g.edges.where(F.col("rel").isin(list(wanted))).select("rel").distinct().collect()}  # at most the pattern's types
    pattern = patterns.Pattern(patterns.End(type="Image"), (patterns.Step(patterns.End(type="Concept"), wanted),), limit=40)
    return patterns.retried(pattern, g.edges, known)


@query(CTE + "select src, rel, dst_type, dst from (select distinct src, rel, dst_type, dst, src_type from edges) order by md5(concat_ws('|', '1', src, rel, dst_type, dst, src_type)), src limit 50")
def sampled_relations(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of fifty relations; sampling is what the operator is for."""
    return cascades.hashed_sample(Graph(spark, d).edges, ["src", "rel", "dst_type", "dst", "src_type"], 50, seed=1).select("src", "rel", "dst_type", "dst")


@query("select chunk_key from chunks where length(content) > 0 order by md5(concat_ws('|', '3', chunk_key::varchar)) limit 5")
def sampled_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of five chunks with text."""
    rows = table(spark, d, "chunks").where(F.length("content") > 0).select("chunk_key", F.col("chunk_key").cast("string").alias("key"))
    return cascades.hashed_sample(rows, ["key"], 5, seed=3).select("chunk_key")


@query("select a.chunks as coverage_chunks, a.coverage as entity_coverage, b.coverage as relation_coverage, c.node_faithfulness, e.relation_faithfulness, f.plausibility, v.* from "
       f"({retrieval.ORACLES['coverage_scores']}) a, ({ORACLES['relation_coverage']}) b, ({retrieval.ORACLES['faithfulness_ratio']}) c, ({retrieval.ORACLES['relation_faithfulness']}) e, ({retrieval.ORACLES['plausibility_score']}) f, ({GRAPH_ORACLES['validation_report']}) v")  # fmt: skip
def full_report(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, faithfulness, plausibility and structure of the graph in one row, each worked out by itself."""
    from graphloom import pipeline

    parts = [
        lambda: retrieval.QUERIES["coverage_scores"](spark, d).select(F.col("chunks").alias("coverage_chunks"), F.col("coverage").alias("entity_coverage")),
        lambda: relation_coverage(spark, d).select(F.col("coverage").alias("relation_coverage")),
        lambda: retrieval.QUERIES["faithfulness_ratio"](spark, d).select("node_faithfulness"),
        lambda: retrieval.QUERIES["relation_faithfulness"](spark, d).select("relation_faithfulness"),
        lambda: retrieval.QUERIES["plausibility_score"](spark, d).select("plausibility"),
        lambda: GRAPH_QUERIES["validation_report"](spark, d),
    ]
    return pipeline.merged_report([storage.one_row(spark, part) for part in parts])


@query(
    CTE
    + """, near as (select distinct case when src = p.a then dst else src end as n, rel from edges, pair p where src = p.a or dst = p.a),
ev as (
  (select 'direct' as kind, concat_ws(' ', src, rel, dst) as evidence from edges, pair p where least(src, dst) = p.a and greatest(src, dst) = p.b order by src, rel, dst limit 20)
  union all (select 'comention', doc from (select doc from mentions, pair p where source_type = 'chunk' and id in (p.a, p.b) group by doc having count(distinct id) = 2) order by doc limit 10))
select kind, evidence from ev"""
)
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Direct edges and shared documents of the strongest pair of the graph, tagged."""
    from graphloom import pipeline
    from graphloom.operators import graph_match

    g = Graph(spark, d)
    return pipeline.graph_evidence(pipeline.GraphTables(g.nodes, g.edges, g.mentions, g.items), graph_match.strongest_pair(g.edges), ["direct", "comention"])


@query()
def hybrid_answer(spark: SparkSession, d: str) -> DataFrame:
    """A question about the strongest pair answered from vectors and graph, with the evidence that carries it."""
    from graphloom import pipeline
    from graphloom.operators import graph_match

    g = Graph(spark, d)
    edges = storage.materialize(g.edges, "edges")  # read by every kind of evidence
    pair = graph_match.strongest_pair(edges).first()
    if pair is None:
        return spark.createDataFrame([], "question string, answer string, evidence array<string>, kinds array<string>")
    question = f"How is {pair.a} related to {pair.b}?"
    chunks = g.chunks.where(F.length("content") > 0).select(F.col("chunk_key").alias("vec_id"), F.col("content"), stub.embedding(F.col("content")).alias("embedding"))
    return pipeline.hybrid_answer(pipeline.GraphTables(g.nodes, edges, g.mentions, g.items), chunks, question, chunk_table=g.chunks)


_JUDGED = """with c as (select doc_id as test_idx, coalesce(source, 'none') as category, coalesce(paper, '') as q, coalesce(text, '') as a from documents),
"""


@query(
    """with q as (select doc_id, coalesce(source, 'none') as category from documents), r as (select doc_id, category, row_number() over (partition by category order by doc_id) as position from q)
select doc_id, category, position::int as position from r"""
)
def questions_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The questions of every category in file order."""
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("category"))
    return records.by_category(rows, "category", "doc_id")


@query(
    """with c as (select doc_id as test_idx, coalesce(source, 'none') as category, text as a from documents),
m as (select test_idx, category, 'Tone' as metric, case when regexp_matches(a, '!{2,}|\\p{Lu}{12,}') then 0.0 else 1.0 end as score, 0.6 as threshold, a is null as missing from c
  union all select test_idx, category, 'SourceAttribution', case when regexp_matches(lower(a), '\\[\\d+\\]|source|according to|reported by') then 1.0 else 0.0 end, 0.3, a is null from c)
select metric, count(*) as tests, count(*) filter (where score >= threshold) as passed from m group by 1"""
)
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two of the eight judges over the documents as answers, each with its own threshold."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("test_idx"), F.coalesce("source", F.lit("none")).alias("category"), F.coalesce("paper", F.lit("")).alias("query"), F.lit("").alias("context"), F.col("text").alias("final_answer"))
    rows = judges.judge(docs, {n: judges.JUDGES[n] for n in ("Tone", "SourceAttribution")})
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("tests"), F.count_if("success").alias("passed"))


@query()
def evaluation_run(spark: SparkSession, d: str) -> DataFrame:
    """All eight judges over the documents, rolled up by metric."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("test_idx"), F.coalesce("source", F.lit("none")).alias("category"), F.coalesce("paper", F.lit("")).alias("query"), F.coalesce("lang", F.lit("")).alias("context"), F.coalesce("text", F.lit("")).alias("final_answer"))
    return evaluation.metric_summary(judges.judge(docs))


@query("select node_row_id, coalesce(id, type) as name, '- ' || id || ' (' || concat_ws(', ', coalesce(type, 'Unknown'), 'Node') || ')' as line from graph_nodes")
def entity_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by name, and as the lines of an entity list."""
    n = table(spark, d, "graph_nodes")
    labels = F.array(F.coalesce("type", F.lit("Unknown")), F.lit("Node"))
    return n.select("node_row_id", records.name_of(F.col("id"), F.col("type")).alias("name"), records.entity_list(F.col("id"), labels).alias("line"))


@query("select graph_doc_id, coalesce(suffix(source_id, '::images') or contains(source_id, '.md'), false) as images from graph_sources")
def image_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which graph documents come from the images of a Markdown file."""
    return table(spark, d, "graph_sources").select("graph_doc_id", records.is_image_source(F.col("source_id")).alias("images"))


@query("select owner_kind, owner_id, count(distinct meta_key) filter (where meta_key not in ('section', 'page_number')) as others from metadata_items where owner_id is not null and meta_key is not null group by 1, 2")
def metadata_others(spark: SparkSession, d: str) -> DataFrame:
    """How many metadata keys an owner has beside two that are left out of evidence."""
    items = table(spark, d, "metadata_items").where("owner_id is not null and meta_key is not null")
    maps = items.select("owner_kind", "owner_id", "meta_key").distinct().groupBy("owner_kind", "owner_id").agg(F.map_from_entries(F.collect_list(F.struct("meta_key", F.lit("")))).alias("m"))
    return maps.select("owner_kind", "owner_id", F.size(records.metadata_without(F.col("m"), "section", "page_number")).cast("bigint").alias("others"))


@query("select graph_doc_id, '[' || string_agg('''' || replace(replace(type, '\\', '\\\\'), '''', '\\''') || '''', ', ' order by type) || ']' as types from (select distinct graph_doc_id, type from graph_nodes where type is not null) group by 1")
def type_lists(spark: SparkSession, d: str) -> DataFrame:
    """The node types of each graph document as a list literal."""
    rows = table(spark, d, "graph_nodes").where("type is not null").groupBy("graph_doc_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return rows.select("graph_doc_id", records.listed(F.col("types")).alias("types"))


@query("select rel_id, ((row_number() over (partition by graph_doc_id order by rel_id) - 1) // 100)::int as batch from graph_relationships")
def ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """Relationships in slices of a hundred per graph document, for sinks that take batches."""
    return records.micro_batches(table(spark, d, "graph_relationships").select("graph_doc_id", "rel_id"), "graph_doc_id", ["rel_id"], 100).select("rel_id", "batch")


@query("select event_id, floor(value * 1000)::int as latency_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, strftime(ts, '%Y%m%d_%H%M%S') as compact from events")
def clock_columns(spark: SparkSession, d: str) -> DataFrame:
    """Times as text and latencies in milliseconds."""
    e = table(spark, d, "events")
    return e.select("event_id", records.latency_ms(F.col("value")).alias("latency_ms"), records.stamp(F.col("ts")).alias("stamp"), records.stamp(F.col("ts"), compact=True).alias("compact"))


@query(
    CTE
    + """, w as (select id, regexp_extract_all(lower(id), '[\\p{L}\\p{N}]+') as w from ids),
c as (select id, len(w) as n, len(list_filter(w, lambda x: x = 'attention')) as a, len(list_filter(w, lambda x: x = 'sparse')) as b from w),
s as (select count(*) as docs, avg(n) as mean, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db from c)
select id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) as score
from c, s where a > 0 or b > 0 order by score desc, id limit 5"""
)
def entity_fulltext(spark: SparkSession, d: str) -> DataFrame:
    """The five entities that a question names best, by full text over node ids."""
    from graphloom import pipeline

    return pipeline.resolve(Graph(spark, d).nodes, "Sparse attention?")


@query(
    CTE
    + """, m as (select distinct doc, id from mentions), e as (select distinct src, rel, dst from edges), lm as (select id, min(doc) as doc from m group by id),
b as (select src, rel, dst, min(m1.doc) as doc from e join m m1 on m1.id = src join m m2 on m2.id = dst and m2.doc = m1.doc group by 1, 2, 3),
r as (select e.src, e.rel, e.dst, coalesce(b.doc, s.doc, t.doc) as doc from e left join b on e.src = b.src and e.rel is not distinct from b.rel and e.dst = b.dst left join lm s on s.id = e.src left join lm t on t.id = e.dst),
real as (select id, min(doc) as doc from m where not (suffix(doc, '::images') or contains(doc, '.md')) group by 1)
select r.src, r.rel, r.dst, case when suffix(r.doc, '::images') or contains(r.doc, '.md') then coalesce(real.doc, r.doc) else r.doc end as doc from r left join real on real.id = r.dst"""
)
def relation_source_redirected(spark: SparkSession, d: str) -> DataFrame:
    """The pointer of each relation, image sources redirected to the target's chunk."""
    g = Graph(spark, d)
    return cascades.relation_source(graph_build.edge_rows(g.raw_edges), g.mentions, redirect_images=True).select("src", "rel", "dst", "doc")


@query(CTE + "select distinct c.id as chunk_id, m.doc from (select distinct id from chunks where length(id) > 0) c join (select distinct doc from mentions) m on contains(m.doc, c.id)")
def chunks_contained_in_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Pointers that hold a chunk's id anywhere."""
    g = Graph(spark, d)
    return cascades.contained_pointers(g.chunks.select(F.col("id").alias("chunk_id")), g.mentions)
