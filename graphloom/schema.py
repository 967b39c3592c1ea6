"""Schemas of the file formats, and the column names the graph tables share."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


METADATA = T.ArrayType(_struct(key=_S, value=_S))
NODE = _struct(id=_S, type=_S, metadata=METADATA)
RELATIONSHIP = _struct(source=NODE, target=NODE, type=_S)
SOURCE = _struct(source_id=_S, source_type=_S, metadata=METADATA)
GRAPH_DOCUMENT = _struct(
    nodes=T.ArrayType(NODE), relationships=T.ArrayType(RELATIONSHIP), source=SOURCE,
    original_chunk_ids=T.ArrayType(_S), original_chunk_indices=T.ArrayType(_I), original_metadata=T.ArrayType(_struct(source=_S)),
    markdown_source=_S, source_chunk_file=_S,
)
CHUNK = _struct(id=_S, content=_S, metadata=_struct(source=_S), chunk_index=_I, token_size_config=_I)
SEMANTIC_CHUNK = _struct(id=_S, source=_S, source_path=_S, chunk_index=_I, text=_S, char_count=_I, word_count=_I, created_at=_S, embedding=T.ArrayType(T.DoubleType()))
IMAGE_BLOCK = _struct(path=_S, page=_I, section=_S, image_relevance=_S, image_type=_S, semantic_role=_S, caption=_S, depicted_concepts=T.ArrayType(_S), confidence=_S)
QUESTION = _struct(Category=_S, Question=_S)
HYBRID_CASE = _struct(
    query=_S, category=_S, rag_context=_S, graph_context=_S, retrieval_context=_S, final_answer=_S, rag_latency_ms=_I, graph_latency_ms=_I, synthesis_latency_ms=_I, total_latency_ms=_I,
    token_usage=_S, rag_subqueries=_S, rag_chunks_count=_I, graph_entities_count=_I, graph_cypher=_S, rag_error=_S, graph_error=_S, timestamp=_S,
)
SIMPLE_CASE = _struct(
    query=_S, category=_S, retrieval_context=_S, final_answer=_S, retrieval_latency_ms=_I, generation_latency_ms=_I, total_latency_ms=_I, token_usage=_S, rag_chunks_count=_I, rag_error=_S, timestamp=_S
)
TRACE = _struct(
    run_id=_S, timestamp_utc=_S, user_question=_S, rewritten_or_decomposed_queries=T.ArrayType(_S),
    retrieved_chunks=T.ArrayType(_struct(chunk_id=_S, source_file=_S, metadata=_S, text=_S)), final_answer=_S,
    token_usage=T.MapType(_S, T.LongType()), latency_ms=_struct(rag=_I, graph=_I, synthesis=_I, total=_I),
)
METRIC_RESULT = _struct(score=T.DoubleType(), success=T.BooleanType(), reason=_S, evaluation_time_seconds=T.DoubleType(), threshold=T.DoubleType(), error=T.BooleanType(), skipped=T.BooleanType())
EVALUATION = _struct(
    detailed_results=T.ArrayType(_struct(test_case_index=_I, input=_S, category=_S, metrics=T.MapType(_S, METRIC_RESULT), overall_passed=T.BooleanType())),
    evaluation_timestamp=_S,
)
