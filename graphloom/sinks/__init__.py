"""Writers of the file formats."""

from graphloom.sinks.files import (
    breakpoint_plot_data, evaluation_sheets, show, write_cases, write_chunks, write_evaluation, write_graph_documents, write_graph_tables, write_markdown, write_registry, write_report, write_semantic_chunks, write_trace, write_vectors,
)

__all__ = [
    "breakpoint_plot_data", "evaluation_sheets", "show", "write_cases", "write_chunks", "write_evaluation", "write_graph_documents", "write_graph_tables", "write_markdown", "write_registry", "write_report", "write_semantic_chunks", "write_trace", "write_vectors",
]
