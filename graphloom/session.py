"""Session defaults for local work; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session() -> SparkSession:
    """The session a command runs in: the one that is there, or the one spark-submit configured; a local one only where neither is."""
    from pyspark import SparkConf

    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    return SparkSession.builder.getOrCreate() if SparkConf().contains("spark.master") or "MASTER" in os.environ else local_session()


def local_session(cores: int | str = 8, memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.path.join(tempfile.gettempdir(), f"graphloom-{os.getpid()}"))
        .getOrCreate()
    )
