"""Queries whose logic also runs as a stream; here over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.models import stub
from graphloom.streaming import flows
from graphloom.tables import table


def trace_latency_windows(spark: SparkSession, d: str) -> DataFrame:
    """Latency of query traces by window; events stand for traces."""
    e = table(spark, d, "events")
    traces = e.select(F.col("ts").cast("string").alias("timestamp_utc"), F.struct(F.round("value").cast("int").alias("total")).alias("latency_ms"))
    out = flows.trace_latency(traces, "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_type_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return flows.event_windows(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stub_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sub-queries, an answer and a judge's score per document, by the offline providers."""
    docs = table(spark, d, "documents")
    question = F.element_at(F.split("text", r"(?<=[.?!])\s+"), 1)
    rows = docs.select("doc_id", question.alias("question"), "text")
    return rows.select("doc_id", F.size(stub.subqueries(F.col("question"))).alias("subqueries"), F.round(stub.judge_score(F.col("question"), stub.answer(F.col("question"), F.col("text"))), 6).alias("score"))


def stub_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """A unit embedding per chunk by feature hashing."""
    return table(spark, d, "chunks").select("chunk_key", stub.embedding(F.col("content")).alias("embedding"))


QUERIES = {f.__name__: f for f in (trace_latency_windows, event_type_windows, stub_answers, stub_embeddings)}
ORACLES = {
    "trace_latency_windows": "select date_trunc('day', ts)::timestamp as start, count(*) as queries, round(avg(v), 6) as mean_ms, max(v) as max_ms from (select ts, (case when value >= 0 then floor(value + 0.5) else ceil(value - 0.5) end)::int as v from events) group by 1",
    "event_type_windows": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
}
