"""Cascade, evaluation and validation queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as fn
from graphloom.models import stub
from graphloom.operators import cascades, evaluation, graph_match
from graphloom.plans.graph import CTE, Graph
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


_LINK = CTE + """, cid as (select distinct id as chunk_id from chunks where length(id) > 0),
ptr as (select distinct doc, string_split(doc, '::')[-1] as last, regexp_replace(split_part(doc, '::', 1), '\\.jsonl$', '') as stem from mentions),
l1 as (select distinct chunk_id, doc, 1 as rule from cid join ptr on chunk_id = last or chunk_id = doc),
l2 as (select distinct chunk_id, doc, 2 as rule from (select chunk_id, chunk_id as want from cid where regexp_matches(chunk_id, '_[0-9]+$') and chunk_id not in (select chunk_id from l1)) join (select doc, stem || regexp_extract(last, '(_[0-9]+)$', 1) as want from ptr where regexp_matches(last, '_[0-9]+$')) using (want)),
link as (select * from l1 union all select * from l2)
"""


@query(_LINK + "select chunk_id, doc, rule from link")
def chunk_pointer_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return cascades.chunk_pointers(g.chunks, g.mentions.select("doc"))


@query(_LINK + "select distinct chunk_id, m.id, m.type, rule from mentions m join link using (doc)")
def entities_for_chunk_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return cascades.entities_for_chunks(g.chunks, g.mentions)


@query(
    _LINK
    + """, i as (select distinct doc, chunk_id, rule, m.id from mentions m join link using (doc))
select distinct s.chunk_id, e.src, e.rel, e.dst, s.rule from (select distinct src, rel, dst from edges) e join i s on s.id = e.src join i t on t.id = e.dst and t.doc = s.doc and t.chunk_id = s.chunk_id"""
)
def relations_for_chunk_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return cascades.relations_for_chunks(g.chunks, g.mentions, g.edges)


@query(
    _LINK
    + """, h as (select id as chunk_id, metadata.source as file, chunk_index from chunks where length(content) > 0),
b as (select m.type, m.id, arg_min(chunk_id, (file, chunk_index, chunk_id)) as chunk_id from mentions m join link using (doc) join h using (chunk_id) group by 1, 2)
select n.type, n.id, b.chunk_id from nodes n left join b on n.type is not distinct from b.type and n.id = b.id"""
)
def node_source_chunk(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return cascades.node_source_chunk(g.nodes, g.mentions, g.chunks)


@query(
    CTE
    + """, e as (select distinct src, rel, dst from edges), m as (select distinct doc, id from mentions), lm as (select id, min(doc) as doc from m group by id),
b as (select src, rel, dst, min(m1.doc) as doc from e join m m1 on m1.id = src join m m2 on m2.id = dst and m2.doc = m1.doc group by 1, 2, 3)
select e.src, e.rel, e.dst, coalesce(b.doc, s.doc, t.doc) as doc, case when b.doc is not null then 1 when s.doc is not null then 2 when t.doc is not null then 3 end as rule
from e left join b on e.src = b.src and e.rel is not distinct from b.rel and e.dst = b.dst left join lm s on s.id = e.src left join lm t on t.id = e.dst"""
)
def relation_source_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(spark, d)
    return cascades.relation_source(g.edges, g.mentions)


@query(
    CTE
    + """, a as (select doc, split_part(doc, '::', 1) as file, substr(doc, instr(doc, '::') + 2) as chunk_id from (select distinct doc from docs) where split_part(doc, '::', 1) like '%.jsonl' and doc like '%::_%'),
p as (select id as chunk_id, coalesce(content, chr(0)) as content, (chunk_index, chunk_key) as rank,
  case when regexp_matches(id, '^.+_chunks_[^_]+_\\d+$') then regexp_replace(id, '_\\d+$', '') else regexp_replace(regexp_replace(metadata.source, '^.*/', ''), '\\.(jsonl|md)$', '') end as stem from chunks),
f as (select chunk_id, stem, arg_min(content, rank) as content from p group by 1, 2),
o as (select chunk_id, arg_min(content, rank) as content, count(distinct stem) as files from p group by 1)
select doc, file, a.chunk_id, case when f.chunk_id is not null or o.files <= 1 then 'OK' else 'NOT_FOUND_IN_FILE' end as status, case when f.chunk_id is not null then f.content when o.files <= 1 then o.content end as content
from a left join f on a.chunk_id = f.chunk_id and regexp_replace(a.file, '\\.jsonl$', '') = f.stem left join o on a.chunk_id = o.chunk_id"""
)
def chunk_by_source_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "graph_sources").select(F.coalesce("source_id", F.lit("unknown")).alias("doc")).distinct()
    return cascades.chunk_by_pointer(docs, table(spark, d, "chunks").withColumn("content", F.coalesce("content", F.lit("\0"))))


@query(
    """select source, chunk_key, chunk_index from (select metadata.source as source, chunk_key, chunk_index, row_number() over (partition by metadata.source order by chunk_index, chunk_key) as n
from chunks where contains(lower(content), 'attention') or contains(lower(content), 'sparse')) where n <= 3"""
)
def chunk_infer_by_terms(spark: SparkSession, d: str) -> DataFrame:
    return cascades.chunk_by_terms(table(spark, d, "chunks"), ["Attention", "Sparse"])


_GEN = r"regexp_matches(id, '^img_|_raw_with_image_ids_with_captions')"


@query(
    _LINK
    + """, men as (select distinct id as chunk_id, lower(w) as item from (select id, unnest(regexp_extract_all(content, '[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+')) as w from chunks where length(content) > 0)),
cov as (select distinct chunk_id, lower(trim(m.id)) as item from mentions m join link using (doc)),
s as (select men.chunk_id, count(cov.item) / count(*)::double as share from men left join cov on men.chunk_id = cov.chunk_id and men.item = cov.item group by 1)
select count(*) as chunks, coalesce(round(avg(share), 6), 0) as coverage from s"""
)
def coverage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Entity coverage of chunks: entities an extraction provider finds against those the graph links to the chunk."""
    g = Graph(spark, d)
    mentioned = g.chunks.where(F.length("content") > 0).select(F.col("id").alias("chunk_id"), F.explode(stub.entities(F.col("content"))).alias("e")).select("chunk_id", cascades.entity_key(F.col("e")).alias("item"))
    covered = cascades.entities_for_chunks(g.chunks, g.mentions).select("chunk_id", cascades.entity_key(F.col("id")).alias("item"))
    return cascades.coverage(mentioned, covered)


@query(
    _LINK
    + """, h as (select id as chunk_id, metadata.source as file, chunk_index from chunks where length(content) > 0),
b as (select m.type, m.id, arg_min(chunk_id, (file, chunk_index, chunk_id)) as chunk_id from mentions m join link using (doc) join h using (chunk_id) group by 1, 2),
c as (select id as chunk_id, arg_min(content, (chunk_index, chunk_key)) as content from chunks where length(content) > 0 group by 1),
g as (select contains(lower(content), lower(b.id)) as grounded from b join c using (chunk_id))
select count(*) as checked, count(*) filter (where grounded) as grounded, round(count(*) filter (where grounded) / count(*)::double, 6) as node_faithfulness from g"""
)
def faithfulness_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of nodes that a grounding provider finds in the text of their source chunk; nodes without text are out."""
    g = Graph(spark, d)
    texts = g.chunks.where(F.length("content") > 0).groupBy(F.col("id").alias("chunk_id")).agg(F.min_by("content", F.struct("chunk_index", "chunk_key")).alias("content"))
    told = cascades.node_source_chunk(g.nodes, g.mentions, g.chunks).where("chunk_id is not null").join(texts, "chunk_id")
    checked = told.select(stub.grounded(F.col("id"), F.col("content")).alias("ok"))
    return checked.agg(F.count(F.lit(1)).alias("checked"), F.count_if("ok").alias("grounded"), F.round(F.when(F.count(F.lit(1)) > 0, F.count_if("ok") / F.greatest(F.count(F.lit(1)), F.lit(1))), 6).alias("node_faithfulness"))


@query(
    CTE
    + """, v as (select case when src_type is null or dst_type is null or rel is null then 'unclear' when src = dst then 'no' else 'yes' end as v from edges)
select count(*) filter (where v = 'yes') as yes, count(*) filter (where v = 'no') as no, count(*) filter (where v = 'unclear') as unclear, round(count(*) filter (where v = 'yes') / greatest(count(*) filter (where v <> 'unclear'), 1)::double, 6) as plausibility from v"""
)
def plausibility_score(spark: SparkSession, d: str) -> DataFrame:
    """Share of typed relations a plausibility provider finds plausible; unclear ones are out."""
    g = Graph(spark, d)
    v = g.edges.select(stub.plausible(F.col("src_type"), F.col("src"), F.col("rel"), F.col("dst_type"), F.col("dst")).alias("v"))
    yes, no, unclear = (F.count_if(F.col("v") == x) for x in ("yes", "no", "unclear"))
    return v.agg(yes.alias("yes"), no.alias("no"), unclear.alias("unclear"), F.round(yes / F.greatest(yes + no, F.lit(1)), 6).alias("plausibility"))


#: Deterministic scores of documents stand for judged test cases: (length, vocabulary) per document.
_EVAL = """e0 as (select doc_id as test_idx, coalesce(source, 'none') as category, least(1.0, n_chars / 1000.0) as completeness, (doc_id % 10) / 10.0 as relevancy, case when lang is null then null else 0.6 end as tone from documents),
e as (select test_idx, category, 'completeness' as metric, completeness::double as score, 0.5 as threshold from e0 union all select test_idx, category, 'relevancy', relevancy::double, 0.5 from e0 union all select test_idx, category, 'tone', tone::double, 0.6 from e0),
ev as (select test_idx, category, metric, score, case when score is null then null else score >= threshold end as success, threshold::double as threshold, length(metric) / 10.0 as secs, false as error, score is null as skipped from e)
"""
METRICS = ["completeness", "relevancy", "tone"]


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("test_idx"), F.coalesce("source", F.lit("none")).alias("category"), F.least(F.lit(1.0), F.col("n_chars") / 1000.0).cast("double").alias("completeness"),
        ((F.col("doc_id") % 10) / 10.0).cast("double").alias("relevancy"), F.when(F.col("lang").isNotNull(), F.lit(0.6)).cast("double").alias("tone"),
    )
    rows = evaluation.unpivot(docs, ["test_idx", "category"], METRICS)
    rows = rows.withColumn("threshold", F.when(F.col("metric") == "tone", 0.6).otherwise(0.5)).withColumn("secs", F.length("metric") / 10.0)
    rows = rows.withColumn("error", F.lit(False)).withColumn("skipped", F.col("score").isNull()).withColumn("success", F.lit(None).cast("boolean"))
    return evaluation.judged(rows).select("test_idx", "category", "metric", "score", "success", "threshold", "secs", "error", "skipped")


@query(f"with {_EVAL} select test_idx, category, metric, score, success, threshold, secs::double as secs, error, skipped from ev")
def eval_long(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d)


@query(
    f"""with {_EVAL} select metric, count(*) filter (where success) as passed, count(*) filter (where not success) as failed, count(*) filter (where error) as errors,
round(case when count(success) > 0 then 100.0 * count(*) filter (where success) / count(success) else 0 end, 6)::double as pass_rate, round(avg(score), 6) as average_score, min(score) as min_score, max(score) as max_score from ev group by metric"""
)
def eval_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metric_summary(_evaluation(spark, d))


@query(f"with {_EVAL} select test_idx, bool_and(coalesce(success, skipped)) as overall_passed from ev group by 1")
def eval_overall_pass(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overall(_evaluation(spark, d))


@query(f"with {_EVAL}, o as (select test_idx, bool_and(coalesce(success, skipped)) as ok from ev group by 1) select count(*) as tests, count(*) filter (where ok) as passed, round(100.0 * count(*) filter (where ok) / count(*), 6)::double as rate from o")
def eval_overall_rate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.overall_rate(_evaluation(spark, d))


def _wide_sql(m: str) -> str:
    f = f"filter (where metric = '{m}')"
    return (
        f"coalesce(printf('%.4f', max(score) {f}), 'N/A') as {m}_score, case when bool_or(success) {f} then 'PASS' when not bool_or(success) {f} then 'FAIL' else 'N/A' end as {m}_status, "
        f"max(threshold) {f} as {m}_threshold, coalesce(printf('%.2f', max(secs)::double {f}), 'N/A') as {m}_secs, 'No' as {m}_error, case when bool_or(skipped) {f} then 'Yes' else 'No' end as {m}_skipped"
    )


@query(f"with {_EVAL} select test_idx, category, {', '.join(_wide_sql(m) for m in METRICS)} from ev group by 1, 2".replace("max(secs)::double filter", "max(secs::double) filter"))
def eval_wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.wide(_evaluation(spark, d), METRICS)


def _rollup_sql(m: str) -> str:
    p, n = f"count(*) filter (where metric = '{m}' and success)", f"count(success) filter (where metric = '{m}')"
    return f"round(case when {n} > 0 then 100.0 * {p} / {n} else 0 end, 6)::double as {m}_pass_rate, round(avg(score) filter (where metric = '{m}'), 6) as {m}_average"


@query(
    f"""with {_EVAL}, o as (select test_idx, category, bool_and(coalesce(success, skipped)) as ok from ev group by 1, 2),
t as (select category, grouping(category) as g, count(*) as tests, count(*) filter (where ok) as passed from o group by rollup (category)),
p as (select category, grouping(category) as g, {', '.join(_rollup_sql(m) for m in METRICS)} from ev group by rollup (category))
select t.category, tests, passed, {', '.join(f'{m}_pass_rate, {m}_average' for m in METRICS)} from t join p on t.g = p.g and t.category is not distinct from p.category"""
)
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.category_rollup(_evaluation(spark, d), METRICS)


@query("select source as category, count(*) as questions from documents group by rollup (source)")
def questions_per_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_category(table(spark, d, "documents").select(F.col("source").alias("category")))


@query(
    """with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda x: x <> '') as parts, text from documents)
select doc_id, case when len(parts) > 0 then parts else [text] end as parts from p"""
)
def retrieval_context_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.context_parts(F.col("text")).alias("parts"))


@query(
    CTE
    + """, w as (select unnest(['MENTIONS', 'DEPICTS', 'NO_SUCH_TYPE']) as rel, unnest([1, 2, 3]) as pos), k as (select distinct rel from edges)
select rel, pos, case when rel in (select rel from k where rel is not null) then 'kept' else 'dropped' end as status from w"""
)
def rel_type_allow_deny(spark: SparkSession, d: str) -> DataFrame:
    """A generated pattern's relationship types against those the graph has (types are a bounded list)."""
    wanted = spark.createDataFrame([("MENTIONS", 1), ("DEPICTS", 2), ("NO_SUCH_TYPE", 3)], "rel string, pos int")
    known = Graph(spark, d).edges.where("rel is not null").select("rel").distinct().withColumn("known", F.lit(True))
    return wanted.join(known, "rel", "left").select("rel", "pos", F.when(F.col("known"), "kept").otherwise("dropped").alias("status"))


@query()
def hybrid_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All evidence kinds for the strongest pair of the graph, tagged and unioned once."""
    from graphloom.operators import graph_metrics

    g = Graph(spark, d)
    pair = graph_match.strongest_pair(g.edges)
    direct = graph_match.direct_edges(g.edges, pair).select(F.lit("direct").alias("kind"), F.concat_ws(" ", "src", "rel", "dst").alias("evidence"))
    shared = graph_match.comention_documents(g.mentions, pair).select(F.lit("comention").alias("kind"), F.col("doc").alias("evidence"))
    near = graph_match.neighbourhood(g.edges, graph_metrics.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(1).select("id")).select(F.lit("neighbour").alias("kind"), F.concat_ws(" ", "rel", "neighbour").alias("evidence"))
    return direct.unionByName(shared).unionByName(near)


@query(
    """select line_id, (select count(distinct t.atom->>'$') from json_tree(case when json_valid(line) then line else 'null' end) t where t.type = 'VARCHAR' and contains(t.atom->>'$', '.jsonl::')) as pointers from graph_jsonl"""
)
def nested_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Provenance pointers among the string values of the raw lines, whatever their shape."""
    pointers = F.array_distinct(F.filter(fn.json_strings(F.regexp_replace("line", "^[\\s﻿]+", "")), lambda s: F.contains(s, F.lit(".jsonl::"))))
    return table(spark, d, "graph_jsonl").select("line_id", F.coalesce(F.size(pointers), F.lit(0)).cast("bigint").alias("pointers"))


@query("select event_id, try_cast(nullif(regexp_extract(props, '\"k\"\\s*:\\s*(-?[0-9]+)', 1), '') as bigint) as k from events")
def nested_int(spark: SparkSession, d: str) -> DataFrame:
    """The integer under a key of a JSON text."""
    return table(spark, d, "events").select("event_id", fn.nested_int(F.col("props"), "k").alias("k"))


@query(
    CTE
    + """, e as (select distinct src, rel, dst from edges), m as (select distinct doc, id from mentions), lm as (select id, min(doc) as doc from m group by id),
b as (select src, rel, dst, min(m1.doc) as doc from e join m m1 on m1.id = src join m m2 on m2.id = dst and m2.doc = m1.doc group by 1, 2, 3),
r as (select e.src, e.rel, e.dst, coalesce(b.doc, s.doc, t.doc) as doc from e left join b on e.src = b.src and e.rel is not distinct from b.rel and e.dst = b.dst left join lm s on s.id = e.src left join lm t on t.id = e.dst),
f as (select id as chunk_id, arg_min(content, (chunk_index, chunk_key)) as content from chunks where length(content) > 0 group by 1),
g as (select contains(lower(content), lower(src)) and contains(lower(content), lower(dst)) as ok from r join f on f.chunk_id = string_split(r.doc, '::')[-1])
select count(*) as checked, count(*) filter (where ok) as grounded, round(count(*) filter (where ok) / greatest(count(*), 1)::double, 6) as relation_faithfulness from g"""
)
def relation_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Share of relations both of whose ends a grounding provider finds in the chunk their pointer names."""
    g = Graph(spark, d)
    texts = g.chunks.where(F.length("content") > 0).groupBy(F.col("id").alias("chunk_id")).agg(F.min_by("content", F.struct("chunk_index", "chunk_key")).alias("content"))
    told = cascades.relation_source(g.edges, g.mentions).withColumn("chunk_id", fn.last_segment(F.col("doc"))).join(texts, "chunk_id")
    checked = told.select(stub.relation_grounded(F.col("src"), F.col("dst"), F.col("content")).alias("ok"))
    n = F.count(F.lit(1))
    return checked.agg(n.alias("checked"), F.count_if("ok").alias("grounded"), F.round(F.count_if("ok") / F.greatest(n, F.lit(1)), 6).alias("relation_faithfulness"))
