"""Chunks into graph documents by an extraction provider.

A provider is a column expression (or Arrow function) from text and known ids to
``struct<nodes: array<struct<id, type>>, relationships: array<struct<source, target, type>>>``; null where it fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.models import stub


def chunk_documents(chunks: DataFrame, extract: Callable[[Column], Column] = stub.graph, text: str = "content", chunk_id: str = "id", file: Column | None = None) -> DataFrame:
    """(doc, nodes, relationships, source): a graph document per chunk with text.

    The source is set from the chunk, whatever the provider says: ``<file>.jsonl::<chunk id>`` of type chunk. A chunk
    whose extraction fails (null) makes no document.
    """
    place = F.regexp_replace(F.col(chunk_id), r"_[0-9]+$", "") if file is None else file
    pointer = F.concat(place, F.lit(".jsonl::"), F.col(chunk_id))
    made = chunks.where((F.length(text) > 0) & (F.length(chunk_id) > 0)).select(pointer.alias("doc"), extract(F.col(text)).alias("g")).where("g is not null")
    source = F.struct(F.col("doc").alias("source_id"), F.lit("chunk").alias("source_type"))
    return made.select("doc", F.col("g.nodes").alias("nodes"), F.col("g.relationships").alias("relationships"), source.alias("source"))


def batch_documents(batches: DataFrame, extract: Callable[[Column], Column] = stub.graph) -> DataFrame:
    """The same for batches (file, first_chunk, text): the source is ``<file>::batch::<first chunk>``."""
    doc = F.concat(F.col("file"), F.lit("::batch::"), F.col("first_chunk"))
    made = batches.select(doc.alias("doc"), extract(F.col("text")).alias("g")).where("g is not null")
    return made.select("doc", F.col("g.nodes").alias("nodes"), F.col("g.relationships").alias("relationships"), F.struct(F.col("doc").alias("source_id"), F.lit("chunk").alias("source_type")).alias("source"))


def provenance(documents: DataFrame) -> DataFrame:
    """(src, rel, dst_type, dst): an ``EXTRACTED`` edge from every document's source id to each of its nodes."""
    rows = documents.select(F.coalesce("source.source_id", F.lit("unknown")).alias("src"), F.explode("nodes").alias("n"))
    return rows.where(F.col("n.id").isNotNull() & (F.trim("n.id") != "")).select("src", F.lit("EXTRACTED").alias("rel"), F.col("n.type").alias("dst_type"), F.col("n.id").alias("dst")).distinct()


def provenance_edges(mention_table: DataFrame) -> DataFrame:
    """The same from a mention table (doc, type, id)."""
    return mention_table.select(F.col("doc").alias("src"), F.lit("EXTRACTED").alias("rel"), F.col("type").alias("dst_type"), F.col("id").alias("dst")).distinct()
