"""Readers of the file formats. All are lazy; missing paths fail at analysis as Spark does."""

from graphloom.sources.files import (
    binary_files, chunk_lines, chunk_lines_strict, evaluation_json, graph_lines, image_files, image_files_by_prefix, key_value, markdown_files, pdf_files, questions, registry, test_cases, to_markdown, traces, vectors,
)

__all__ = [
    "binary_files", "chunk_lines", "chunk_lines_strict", "evaluation_json", "graph_lines", "image_files", "image_files_by_prefix", "key_value", "markdown_files", "pdf_files", "questions", "registry", "test_cases", "to_markdown", "traces", "vectors",
]
