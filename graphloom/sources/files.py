"""Files into DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from graphloom import schema
from graphloom.functions import text as fn


def _stem(path: F.Column) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, stem, content, length) of files whole."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", _stem(F.col("path")).alias("stem"), "content", "length")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of a folder, or one file."""
    return binary_files(spark, path, "*.pdf")


def to_markdown(pdfs: DataFrame, convert: Callable[[str, bytes], str]) -> DataFrame:
    """(path, ok, markdown, images) by a converter given by the caller; a failing file has ok false and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    texts.append(convert(path, content))
                except Exception:  # a converter may fail in any way; the row says so
                    texts.append(None)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "markdown": pa.array(texts, pa.string())})

    from graphloom.operators.images import count_images

    made = pdfs.select("path", "content").mapInArrow(run, "path string, markdown string")
    return made.select("path", F.col("markdown").isNotNull().alias("ok"), "markdown", F.coalesce(count_images(F.col("markdown")), F.lit(0)).alias("images"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of whole Markdown files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), _stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def chunk_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Chunks of JSONL files, tolerant: blank lines, bad JSON and empty contents are left out.

    Adds ``source_file`` and ``chunk_id``: the id, or ``<stem>_<line>`` where there is none. Files are read by blocks in
    parallel; a line's number within its file comes from the lines of the blocks before, counted per block.
    """
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = spark.read.option("pathGlobFilter", pattern).text(path).select(block.alias("block"), F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    counted = rows.groupBy("block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("block.path").orderBy("block.start").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    lines = rows.join(starts, "block").select("source_file", (F.col("at") - F.col("first") + F.col("skip")).cast("int").alias("pos"), F.regexp_replace("line", "\r$", "").alias("line")).where(F.trim("line") != "")
    parsed = lines.select("source_file", (F.col("pos") + 1).alias("line_no"), F.from_json("line", schema.CHUNK).alias("c")).where("c is not null and length(c.content) > 0")
    return parsed.select("c.*", "source_file", "line_no", F.coalesce("c.id", F.concat(_stem(F.col("source_file")), F.lit("_"), F.col("line_no").cast("string"))).alias("chunk_id"))


def chunk_lines_strict(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSONL files; bad JSON fails the read."""
    return spark.read.schema(schema.CHUNK).option("mode", "FAILFAST").json(path)


def graph_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Graph documents of JSONL files; bad lines and unknown fields are left out, source defaults filled in."""
    shape = T.StructType([*schema.GRAPH_DOCUMENT.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(shape).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).json(path)
    kept = rows.where("_corrupt is null").drop("_corrupt")
    filled = F.struct(F.coalesce("source.source_id", F.lit("unknown")).alias("source_id"), F.coalesce("source.source_type", F.lit("chunk")).alias("source_type"), F.col("source.metadata").alias("metadata"))
    return kept.withColumn("source", filled)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(Category, Question, row_no) of a CSV with header, in file order within a file.

    A question list is small; it is read as one partition so that its order is known.
    """
    rows = spark.read.schema(schema.QUESTION).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.coalesce(1).withColumn("row_no", F.monotonically_increasing_id())


def test_cases(spark: SparkSession, path: str, hybrid: bool = True) -> DataFrame:
    """Test cases of a CSV; fields of any length."""
    shape = schema.HYBRID_CASE if hybrid else schema.SIMPLE_CASE
    return spark.read.schema(shape).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("maxCharsPerColumn", -1).csv(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a registry file, a JSON array of ids; a missing or bad file is an empty registry."""
    empty = spark.createDataFrame([], "id string")
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception:  # the path is missing
        return empty
    return rows.select(F.explode(F.from_json("value", "array<string>")).alias("id"))


def key_value(path: str, key: str, default=None):
    """A value of a JSON configuration file; the default where file, JSON or key is missing. Driver side."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8")).get(key, default)
    except (OSError, ValueError, AttributeError):
        return default


def evaluation_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per test case of an evaluation file, with its map of metrics."""
    rows = spark.read.schema(schema.EVALUATION).option("multiLine", True).json(path)
    return rows.select("evaluation_timestamp", F.explode("detailed_results").alias("r")).select("evaluation_timestamp", "r.*")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, media_type, base64) of image files."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kept = rows.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(list(fn.IMAGE_TYPES)))
    return kept.select("path", name.alias("name"), fn.media_type(F.col("path")).alias("media_type"), F.base64("content").alias("base64"))


def image_files_by_prefix(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Image files whose name starts with a prefix, by name."""
    return image_files(spark, path).where(F.col("name").startswith(prefix)).orderBy("name")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A persisted vector table."""
    return spark.read.parquet(path)


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Query traces, appended JSON lines."""
    return spark.read.schema(schema.TRACE).json(path)
