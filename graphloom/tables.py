"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def missing_partitions(scan: DataFrame, minimum: int | None = None) -> int:
    """The partitions a CPU-heavy stage over ``scan`` should have, or 0 if the scan has as many.

    For scans without a shuffle only: asking a shuffled plan for its partitions would run it.
    """
    spark = scan.sparkSession
    want = minimum or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return want if scan.rdd.getNumPartitions() < want else 0


def wide_enough(scan: DataFrame, minimum: int | None = None) -> DataFrame:
    """Spread a scan that feeds CPU-heavy Python over the cluster's cores.

    A small file is one scan partition; a heavy per-row stage over it would use one core.
    Large scans already have more partitions than cores and pass unchanged.
    """
    want = missing_partitions(scan, minimum)
    return scan.repartition(want) if want else scan
