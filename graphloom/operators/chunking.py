"""Texts into chunks and chunks into batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text as fn
from graphloom.functions.tokens import count_tokens
from graphloom.tables import wide_enough

# Fixed values: (chunk size, overlap, suffix) of the two granularities, in tokens.
GRANULARITIES = [(5000, 500, "_chunks_5k"), (2000, 200, "_chunks_2k")]
# Where a text is cut, from the best place to the worst.
SEPARATORS = ["\n\n", "\n", " ", ""]


def words_length(text: str) -> int:
    """Length in words."""
    return len(text.split())


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int] = words_length, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size``, cut at the best separator that works, neighbours sharing up to ``overlap``.

    A piece that no separator cuts stays whole. An empty text has no pieces.
    """
    separators = SEPARATORS if separators is None else separators
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(separator) if separator else list(text)) if p != ""]
    glue = length(separator) if separator else 0
    out: list[str] = []
    held: list[str] = []
    held_size = 0

    def close() -> None:
        joined = separator.join(held).strip()
        if joined and (not out or out[-1] != joined):
            out.append(joined)

    for part in parts:
        n = length(part)
        if n > size and finer:
            if held:
                close()
                held, held_size = [], 0
            out.extend(recursive_split(part, size, overlap, length, finer))
            continue
        if held and held_size + glue + n > size:
            close()
            while held and (held_size > overlap or held_size + glue + n > size):
                held_size -= length(held[0]) + (glue if len(held) > 1 else 0)
                held = held[1:]
        held_size += n + (glue if held else 0)
        held.append(part)
    if held:
        close()
    return out


def token_chunks(documents: DataFrame, key: str, text: str, stem: str, length: Callable[[str], int] = count_tokens, granularities: list[tuple[int, int, str]] | None = None) -> DataFrame:
    """(key, id, content, source, chunk_index, token_size_config) at every granularity.

    Sizes are tokens of the public tokenizer unless another ``length`` is given. A text is split whole by an Arrow pass
    over its row; null and blank texts have no chunks.
    """
    sizes = granularities or GRANULARITIES
    rows = documents.where(F.length(F.trim(text)) > 0).select(F.col(key).cast("bigint").alias("key"), F.col(stem).cast("string").alias("stem"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, name, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size, overlap, suffix in sizes:
                    out += [(k, f"{name}{suffix}_{i}", piece, name, i, size) for i, piece in enumerate(recursive_split(body, size, overlap, length))]
            columns = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "id", "content", "source", "chunk_index", "token_size_config"])

    return wide_enough(rows).mapInArrow(split, "key bigint, id string, content string, source string, chunk_index int, token_size_config int").withColumnRenamed("key", key)


def semantic_chunks(islands: DataFrame, key: str, order: str, sentence: str) -> DataFrame:
    """(key, chunk_index, text, char_count, word_count): the sentences of each island joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(sentence).alias("s"))))
    joined = islands.groupBy(key, F.col("grp").alias("chunk_index")).agg(F.array_join(F.transform(pairs, lambda x: x["s"]), " ").alias("text"))
    return joined.select(key, "chunk_index", "text", F.length("text").alias("char_count"), fn.word_count(F.col("text")).alias("word_count"))


def adaptive_batches(chunks: DataFrame, group: str, order: str, content: str, limit: int = 5500, unique: str | None = None) -> DataFrame:
    """Adds ``batch``: chunks of a file in order, cut where the estimate would pass ``limit`` tokens.

    The cut depends on everything before it in the file, so a file's rows pass one task in order, streamed; only ids and
    estimates do, never texts. Empty and null contents are skipped. A chunk above the limit
    is a batch of its own.
    """
    rows = chunks.where(F.length(content) > 0).select(group, F.col(order), F.col(unique or order).alias("chunk_ref"), fn.token_estimate(F.col(content)).alias("tokens"))
    kinds = dict(rows.dtypes)
    schema = f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, chunk_ref {kinds['chunk_ref']}, tokens {kinds['tokens']}, batch int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, held = object(), 0, 0
        for rows in batches:
            numbers = []
            for name, size in zip(rows.column(0).to_pylist(), rows.column(3).to_pylist()):
                if name != file:
                    file, number, held = name, 0, 0
                if held > 0 and held + size > limit:
                    number, held = number + 1, 0
                held += size
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int32())], names=[*rows.schema.names, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, order, "chunk_ref").mapInArrow(cut, schema)


def batch_sources(batches: DataFrame, group: str, chunk_ids: str) -> DataFrame:
    """(file, batch, source_id, source_type, ids): the provenance pointer of each batch."""
    ids = F.array_sort(F.collect_list(F.struct("chunk_index", F.col(chunk_ids).alias("id"))))
    g = batches.groupBy(group, "batch").agg(F.transform(ids, lambda x: x["id"]).alias("ids"))
    first = F.coalesce(F.element_at("ids", 1), F.lit("unknown"))
    one = F.size("ids") == 1
    return g.select(
        group, "batch",
        F.when(one, F.concat(F.col(group), F.lit(".jsonl::"), first)).otherwise(F.concat(F.col(group), F.lit("::batch::"), first)).alias("source_id"),
        F.when(one, "chunk").otherwise("chunk_batch").alias("source_type"), "ids",
    )
