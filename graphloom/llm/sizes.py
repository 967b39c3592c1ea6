"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions.tokens import DEFAULT_TOKENIZER, count_tokens
from graphloom.tables import wide_enough

def token_sizes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, tokens) of every document; null and empty texts have 0 tokens."""
    keep = keep or []
    kept = documents.select(id_column, *keep, F.col(text_column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_tokens(t, tokenizer) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*batch.schema.names[:-1], "tokens"])

    return wide_enough(kept).mapInArrow(count, schema)
