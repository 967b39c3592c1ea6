"""The stages chained: documents to graph and vectors, question to evidence, graph to report, cases to evaluation.

Model calls are column expressions given by the caller; the offline ones of ``models.stub`` are the
default. Every stage takes and returns DataFrames; nothing is collected on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.functions import records
from graphloom.models import stub
from graphloom.operators import cascades, chunking, evaluation, graph_build as build, graph_match as match, graph_metrics as metrics, images, patterns, search, vectors


@dataclass
class GraphTables:
    """What ingestion makes."""

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    properties: DataFrame


def ingest(documents: DataFrame) -> GraphTables:
    """Nested graph documents into tables, with a mention of every node by its document's pointer."""
    n, r, s = build.explode_documents(documents)
    props = n.where("size(metadata) > 0").select("type", "id", "graph_doc_id", "pos", F.posexplode("metadata").alias("at", "m")).select("type", "id", "graph_doc_id", "pos", "at", "m.key", "m.value")
    return GraphTables(build.nodes(n), build.edges(r), build.mentions(s, n), build.property_lists(props, ["type", "id"], "key", "value", ["graph_doc_id", "pos", "at"]))


def chunk_and_embed(markdown: DataFrame, key: str = "doc_id", text: str = "text", stem: str = "stem", embed=stub.embedding) -> DataFrame:
    """Chunks of the finer granularity with a unit embedding each; ``embed``: provider of document embeddings."""
    chunks = chunking.token_chunks(markdown, key, text, stem, granularities=chunking.GRANULARITIES[1:])
    return chunks.withColumn("embedding", embed(F.col("content")))


def caption_images(markdown: DataFrame, key: str, text: str, caption=stub.caption) -> DataFrame:
    """Image metadata of Markdown with captions laid over it."""
    found = images.block_images(markdown, key, text)
    told = found.select("image_id", caption(F.col("image_id"), F.col("meta.path")).alias("c")).select("image_id", "c.*").dropDuplicates(["image_id"])
    return images.merge_captions(found, told)


def annotated(markdown: DataFrame, key: str, text: str, caption=stub.caption) -> DataFrame:
    """(key, text): Markdown whose image metadata blocks hold the captions; other text stays as it is.

    A block whose image has no caption (a missing file) is left unchanged.
    """
    told = caption_images(markdown, key, text, caption)
    blocks = told.select(key, "block", records.snippet(F.col("meta")).alias("written")) if "block" in told.columns else told.select(key, F.lit(None).cast("string").alias("block"), records.snippet(F.col("meta")).alias("written"))
    listed = blocks.where("block is not null and written is not null").groupBy(key).agg(F.collect_list(F.struct("block", "written")).alias("blocks"))  # the images of one document
    done = markdown.select(key, text).join(listed, key, "left")
    return done.select(key, F.coalesce(F.aggregate("blocks", F.col(text), lambda acc, b: F.replace(acc, b["block"], b["written"])), F.col(text)).alias(text))


def retrieve(vector_table: DataFrame, questions: DataFrame, k: int = 3, subqueries=stub.subqueries, embed=stub.embedding) -> DataFrame:
    """(question_id, vec_id, score, rank): the best chunks over all sub-queries of a question, each once.

    questions: (question_id, question), a small stated set.
    """
    parts = questions.select("question_id", F.posexplode(subqueries(F.col("question"))).alias("pos", "sub"))
    asked = parts.select((F.col("question_id") * 10 + F.col("pos")).alias("query_id"), embed(F.col("sub")).alias("embedding"))
    hits = vectors.knn(asked, vector_table.select("vec_id", "embedding"), k)
    tagged = hits.withColumn("question_id", F.floor(F.col("query_id") / 10))
    return match.first_seen(tagged, ["question_id", "vec_id"], ["query_id", "rank"]).select("question_id", "vec_id", "score", "rank")


def resolve(node_table: DataFrame, question: str, limit: int = 5) -> DataFrame:
    """The entities a question names, by full text over node ids."""
    return search.bm25(node_table.select("id").distinct(), "id", "id", search_words(question), limit)


def search_words(question: str) -> list[str]:
    """The words of a question that are longer than three letters."""
    return [w for w in "".join(c.lower() if c.isalnum() else " " for c in question).split() if len(w) > 3]


def graph_evidence(tables: GraphTables, pair: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(kind, evidence) for a pair of entities (one row: a, b): direct edges, shared documents, neighbourhood of the first."""
    made = {
        "direct": lambda: match.direct_edges(tables.edges, pair).select(F.concat_ws(" ", "src", "rel", "dst").alias("evidence")),
        "comention": lambda: match.comention_documents(tables.mentions, pair).select(F.col("doc").alias("evidence")),
        "neighbour": lambda: match.neighbourhood(tables.edges, pair.select(F.col("a").alias("id"))).select(F.concat_ws(" ", "rel", "neighbour").alias("evidence")),
    }
    out = None
    for kind in kinds or list(made):
        part = made[kind]().select(F.lit(kind).alias("kind"), "evidence")
        out = part if out is None else out.unionByName(part)
    return out


def evidence_cascade(tables: GraphTables, question: str, pattern: patterns.Pattern | None = None, images_of: DataFrame | None = None, chunk_table: DataFrame | None = None) -> DataFrame:
    """(kind, evidence): what the graph says to a question, stage by stage.

    The entities are resolved by full text; the rows of the pattern, if one is given, come first. Only where it has none
    do the fallbacks run: direct edges, shared documents, shortest path, neighbourhood, images, the chunks behind the
    shared documents, and the subgraph. What comes to the driver are the best entities, five at most.
    """
    spark = tables.nodes.sparkSession
    resolved = resolve(tables.nodes, question)
    best = resolved.collect()
    named = spark.createDataFrame(best, resolved.schema)
    ends = [r.id for r in best[:2]]
    if pattern is not None:
        wanted = sorted({r for s in pattern.steps for r in s.rels})
        known = {r.rel for r in tables.edges.where(F.col("rel").isin(wanted)).select("rel").distinct().collect()}
        rows = patterns.retried(pattern, tables.edges, known)
        if not rows.isEmpty():
            return rows.select(F.lit("pattern").alias("kind"), F.to_json(F.struct(*rows.columns)).alias("evidence"))
    entities = named.select(F.lit("entity").alias("kind"), F.col("id").alias("evidence"))
    if not ends:
        return entities
    pair = spark.createDataFrame([tuple(sorted((ends[0], ends[-1])))], "a string, b string")
    about = replace(tables, mentions=tables.mentions.where(F.col("id").isin(ends)))  # filtered before mentions are made distinct
    out = entities.unionByName(graph_evidence(about, pair, ["direct", "comention"] if len(ends) > 1 else ["neighbour"]))
    if len(ends) > 1:
        out = out.unionByName(match.shortest_path(tables.edges, *ends).select(F.lit("path").alias("kind"), F.array_join("path", " - ").alias("evidence")))
        out = out.unionByName(graph_evidence(tables, pair, ["neighbour"]))
        if chunk_table is not None:
            docs = match.comention_documents(about.mentions, pair)
            asked = chunk_table.join(F.broadcast(docs.select(F.col("chunk_id").alias("id"))), "id", "left_semi")  # ten pointers at most
            told = cascades.chunk_by_pointer(docs.select("doc"), asked).where("status = 'OK' and content is not null")
            out = out.unionByName(told.select(F.lit("chunk").alias("kind"), F.col("content").alias("evidence")))
    if images_of is not None:
        shown = match.image_evidence(tables.edges, tables.mentions, named.select("id"), images_of)
        out = out.unionByName(shown.select(F.lit("image").alias("kind"), F.concat_ws(" ", "image", "path").alias("evidence")))
    around = match.subgraph_edges(tables.edges, named.select("id"))
    return out.unionByName(around.select(F.lit("subgraph").alias("kind"), F.concat_ws(" ", "src", "rel", "dst").alias("evidence")))


def hybrid_answer(tables: GraphTables, vector_table: DataFrame, question: str, k: int = 3, chunk_table: DataFrame | None = None, answer=stub.answer, **providers) -> DataFrame:
    """(question, answer, evidence, kinds): both retrievals always run, their evidence is the context of one answer.

    vector_table: (vec_id, content, embedding). ``answer``: provider (question, context) -> text. The evidence is a
    bounded list: every stage has its own limit.
    """
    spark = tables.nodes.sparkSession
    asked = spark.createDataFrame([(1, question)], "question_id bigint, question string")
    hits = F.broadcast(retrieve(vector_table, asked, k, **providers)).join(vector_table.select("vec_id", "content"), "vec_id").select(F.lit("vector").alias("kind"), F.col("content").alias("evidence"))
    found = hits.unionByName(evidence_cascade(tables, question, chunk_table=chunk_table))
    context = found.groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "evidence"))).alias("e"))
    told = context.select(F.lit(question).alias("question"), F.transform("e", lambda x: x["evidence"]).alias("evidence"), F.array_distinct(F.transform("e", lambda x: x["kind"])).alias("kinds"))
    return told.select("question", answer(F.col("question"), F.array_join("evidence", "\n")).alias("answer"), "evidence", "kinds")


def simple_answer(vector_table: DataFrame, questions: DataFrame, answer=stub.answer, **providers) -> DataFrame:
    """(question_id, question, context, final_answer): the single best chunk of each question, cut to 500 characters, as context."""
    hits = retrieve(vector_table, questions, 1, **providers).where("rank = 1").join(vector_table.select("vec_id", F.substring("content", 1, 500).alias("context")), "vec_id")
    best = hits.groupBy("question_id").agg(F.max_by("context", "score").alias("context"))
    told = questions.join(best, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return told.select("question_id", "question", "context", answer(F.col("question"), F.col("context")).alias("final_answer"))


def test_cases(vector_table: DataFrame, questions: DataFrame, clock: Column | None = None, answer=stub.answer, **providers) -> DataFrame:
    """A test case per question, by category and file order; a question without an answer becomes a row with an error.

    questions: (question_id, question, category). The clock is a parameter, so that runs can be compared.
    """
    told = simple_answer(vector_table, questions, answer, **providers).join(questions.select("question_id", "category"), "question_id")
    failed = F.col("final_answer").isNull() | F.startswith(F.col("final_answer"), F.lit("Error"))
    ordered = records.by_category(told, "category", "question_id")
    return ordered.select(
        F.col("question").alias("query"), "category", F.col("context").alias("retrieval_context"), F.when(~failed, F.col("final_answer")).otherwise("").alias("final_answer"),
        F.lit(None).cast("int").alias("retrieval_latency_ms"), F.lit(None).cast("int").alias("generation_latency_ms"), F.lit(None).cast("int").alias("total_latency_ms"), F.lit(None).cast("string").alias("token_usage"),
        F.when(F.length("context") > 0, 1).otherwise(0).alias("rag_chunks_count"), F.when(failed, F.coalesce("final_answer", F.lit("Error: no answer"))).alias("rag_error"), records.stamp(clock).alias("timestamp"), "position",
    )


def merged_report(parts: list[DataFrame]) -> DataFrame:
    """One-row reports side by side as one row; an earlier part's column stays where names repeat."""
    row = parts[0]
    for part in parts[1:]:
        row = row.join(F.broadcast(part.select(*[c for c in part.columns if c not in row.columns])))  # one row each
    return row


def validate(tables: GraphTables, raw_nodes: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """The structural report of a graph."""
    return metrics.report(tables.nodes, tables.edges, tables.mentions, raw_nodes, raw_edges)


def evaluate(cases: DataFrame, thresholds: dict[str, float], score=stub.judge_score) -> DataFrame:
    """Every usable case judged by every metric, in the long form the rollups read."""
    spark: SparkSession = cases.sparkSession
    metric_rows = spark.createDataFrame([(m, float(t)) for m, t in sorted(thresholds.items())], "metric string, threshold double")
    usable = evaluation.usable_cases(cases).select(F.xxhash64("query", "final_answer").alias("test_idx"), "category", "query", "final_answer")
    rows = usable.join(F.broadcast(metric_rows)).withColumn("score", score(F.col("query"), F.col("final_answer")))
    rows = rows.withColumns({"secs": F.lit(0.0), "error": F.col("score").isNull(), "skipped": F.lit(False), "success": F.lit(None).cast("boolean")})
    return evaluation.judged(rows).select("test_idx", "category", "metric", "score", "success", "threshold", "secs", "error", "skipped")
