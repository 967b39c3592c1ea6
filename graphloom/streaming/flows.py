"""Streams over arriving files: registry upkeep, trace windows, incremental ingest, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom import schema
from graphloom.operators import graph_build as build


def read_graph_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Graph documents of JSONL files as they arrive."""
    shape = T.StructType([f for f in schema.GRAPH_DOCUMENT.fields if f.name in ("nodes", "relationships", "source")])
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other trouble rises."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def keep_registry(documents: DataFrame, registry_path: str, checkpoint: str) -> StreamingQuery:
    """Add the new ids of each micro-batch to the registry table; a batch replayed after a failure adds nothing twice.

    One writer: the ids of a batch that the table lacks are appended as one commit per batch id.
    """
    spark = documents.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        ids = build.registry(batch.select(F.explode("nodes.id").alias("id")))
        if _exists(spark, registry_path):
            known = spark.read.schema("id string, batch bigint").option("basePath", registry_path).parquet(registry_path).where(F.col("batch") != batch_id).select("id")
            ids = ids.join(known, "id", "left_anti")
        ids.write.mode("overwrite").parquet(f"{registry_path}/batch={batch_id}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_latency(traces: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Latency by window of event time; works on streams (with a watermark) and on tables."""
    timed = traces.withColumn("at", F.to_timestamp("timestamp_utc"))
    if traces.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", width)).agg(F.count(F.lit(1)).alias("queries"), F.avg("latency_ms.total").alias("mean_ms"), F.max("latency_ms.total").alias("max_ms")).select(
        F.col("window.start").alias("start"), "queries", F.round("mean_ms", 6).alias("mean_ms"), "max_ms"
    )


def latest_properties(items: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Keyed upsert on a table: the latest row of each key, ties by the whole row."""
    others = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.max(F.struct(F.col(at).alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])).alias("_row"))
    return best.select(*keys, *[F.col(f"_row._{i}").alias(c) for i, c in enumerate(others)]).select(*items.columns)


def keep_latest(items: DataFrame, keys: list[str], at: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream: each micro-batch is merged into the table by key, the later row stays.

    The table is written as one folder per batch; the newest is the whole table, and a batch replayed after a failure
    starts from the one before it.
    """
    spark = items.sparkSession
    shape = items.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0 and _exists(spark, f"{table_path}/batch={batch_id - 1}"):
            rows = rows.unionByName(spark.read.schema(shape).parquet(f"{table_path}/batch={batch_id - 1}"))
        latest_properties(rows, keys, at).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per event type and tumbling window."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
