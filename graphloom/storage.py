"""Cutting lineage: a stage's result becomes a Parquet table in the folder all executors share.

A written table survives the loss of any executor, is compressed and columnar (unlike an RDD
checkpoint), and lets later stages prune columns. The folder is the one the session names in
``spark.checkpoint.dir``; only where none is set (tests on one machine) a local one is chosen.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"graphloom-{os.getpid()}")
    return f"{named.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted when the block ends: for jobs whose result is written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        _delete(before)


def one_row(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """A report of one row, worked out here and now; what its working wrote and shuffled is given back before the next one's."""
    with scratch():
        report = make()
        row = spark.createDataFrame(report.collect(), report.schema)
    del report
    give_back(spark)
    return row


def give_back(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it keeps them until the driver has collected the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(keep: int) -> None:
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone, and so is its shared folder's use
            continue


def release() -> None:
    """Delete every table written by :func:`materialize`; results that read them must be done."""
    _delete(0)


atexit.register(release)
