"""DataFrames into files. Large tables are written in parallel; only small reports go into one file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom import schema
from graphloom.operators import evaluation


def write_markdown(documents: DataFrame, path: str, suffix: str = "") -> None:
    """One folder per document (column ``stem``), its text as it is."""
    out = documents.select(F.concat("stem", F.lit(suffix)).alias("stem"), F.col("text").alias("value"))
    out.write.mode("overwrite").partitionBy("stem").option("lineSep", "\n").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk lines, one folder per source and granularity."""
    out = chunks.select("id", "content", F.struct("source").alias("metadata"), "chunk_index", "token_size_config", F.col("source").alias("_source"), F.col("token_size_config").alias("size"))
    out.write.mode("overwrite").partitionBy("_source", "size").json(path)


def write_semantic_chunks(chunks: DataFrame, path: str, with_embedding: bool = False) -> None:
    """Semantic chunk lines; a failed embedding is written as null where embeddings are asked for."""
    names = [f.name for f in schema.SEMANTIC_CHUNK.fields if f.name in chunks.columns and (with_embedding or f.name != "embedding")]
    chunks.select(*names).write.mode("overwrite").option("ignoreNullFields", not with_embedding).json(path)


def write_graph_documents(documents: DataFrame, path: str) -> None:
    """Graph documents, one a line; absent extras are left out."""
    documents.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_registry(ids: DataFrame, path: str) -> None:
    """The registry as a JSON array of distinct ids in order, one id a line.

    The ids are sorted over the cluster; only the lines pass one task, streamed, so that the file is one array.
    """
    given = ids.where(F.col("id").isNotNull()).select("id")
    if given.isEmpty():
        ids.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    ordered = given.distinct().orderBy("id")
    lines = ordered.select(F.to_json(F.array("id")).alias("a")).select(F.expr("substring(a, 2, length(a) - 2)").alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        for batch in batches:
            values = [v for v in [held, *batch.column(0).to_pylist()] if v is not None]
            held = values.pop() if values else None
            yield pa.RecordBatch.from_pydict({"value": pa.array([v + "," for v in values], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [held or "", "]"]})

    lines.coalesce(1).mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def write_graph_tables(node_table: DataFrame, edge_table: DataFrame, mention_table: DataFrame, path: str, buckets: int | None = None) -> None:
    """The graph as Parquet, nodes by type, edges and mentions clustered by their first id."""
    node_table.withColumn("_type", F.coalesce("type", F.lit("Unknown"))).write.mode("overwrite").partitionBy("_type").parquet(f"{path}/nodes")
    edge_table.repartitionByRange("src", "dst").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{path}/edges")
    mention_table.repartitionByRange("doc", "id").sortWithinPartitions("doc").write.mode("overwrite").parquet(f"{path}/mentions")


def write_vectors(vector_table: DataFrame, path: str) -> None:
    """The vector table."""
    vector_table.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str, drop_missing: bool = True) -> None:
    """A one-row report as JSON; missing metrics are left out rather than null."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", drop_missing).json(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Append query traces."""
    trace.write.mode("append").json(path)


def write_cases(cases: DataFrame, path: str, hybrid: bool = True) -> bool:
    """Test cases as CSV in their fixed column order; nothing is written where there are none."""
    names = [f.name for f in (schema.HYBRID_CASE if hybrid else schema.SIMPLE_CASE).fields]
    if cases.isEmpty():
        return False
    cases.select(*names).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return True


def evaluation_sheets(rows: DataFrame, metrics: list[str], path: str | None = None) -> dict[str, DataFrame]:
    """The four sheets of an evaluation (and CSV folders of them, if a path is given)."""
    sheets = {"Summary": evaluation.metric_summary(rows), "Detailed": evaluation.wide(rows, metrics), "Breakdown": rows, "Category": evaluation.category_rollup(rows, metrics)}
    for name, sheet in sheets.items() if path else ():
        sheet.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return sheets


def breakpoint_plot_data(islands: DataFrame, key: str, order: str) -> DataFrame:
    """What a breakpoint plot shows: distance by position, threshold and breaks."""
    return islands.select(key, order, "distance", "threshold", "is_break")


def write_evaluation(rows: DataFrame, path: str, at: str) -> None:
    """An evaluation as JSON: the summary per metric, every test with its metrics, and the time, given as text."""
    done = rows.withColumn("result", F.struct("score", "success", "threshold", F.col("secs").alias("evaluation_time_seconds"), "error", "skipped"))
    tests = done.groupBy(F.col("test_idx").alias("test_case_index"), "category").agg(F.map_from_entries(F.collect_list(F.struct("metric", "result"))).alias("metrics"))
    tests = tests.join(evaluation.overall(rows).withColumnRenamed("test_idx", "test_case_index"), "test_case_index").withColumn("evaluation_timestamp", F.lit(at))
    tests.write.mode("overwrite").json(f"{path}/detailed_results")
    evaluation.metric_summary(rows).withColumn("evaluation_timestamp", F.lit(at)).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def show(table: DataFrame, rows: int = 20) -> list[str]:
    """Print the first rows, each as a JSON line, and return them; a look, not an export."""
    lines = [r.value for r in table.limit(rows).select(F.to_json(F.struct(*table.columns)).alias("value")).collect()]
    print("\n".join(lines))
    return lines
