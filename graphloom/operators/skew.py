"""Joins and ranks that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A key with fewer rows than that is never hot, whatever the table's size.
LEAST_ROWS = 20_000


def hot_keys(counted: DataFrame, key: str, count: str = "count") -> list[tuple]:
    """[(key, salts)] of the keys of a (key, count) table that are too large for one task.

    A task's fair share is all rows over the shuffle partitions (at least ``LEAST_ROWS``). A key above it is hot and
    gets as many salts as it holds shares; so there are at most as many hot keys, and twice as many salts, as partitions.
    """
    spark = counted.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = counted.agg(F.sum(count)).first()[0] or 0
    share = max(LEAST_ROWS, total // tasks)
    if total <= share:
        return []
    rows = counted.where((F.col(count) > F.lit(share)) & F.col(key).isNotNull()).select(key, F.ceil(F.col(count) / F.lit(share)).cast("int")).collect()
    return [tuple(r) for r in rows]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list[tuple], spread: Column, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` on ``key``; left's rows of hot keys spread over their salts, right's are repeated for each.

    ``hot`` comes from :func:`hot_keys` of the left side's counts. ``spread`` is an expression over left's rows that tells
    them apart, such as an id. Null keys match nothing.
    """
    if not hot:
        return left.join(right, key, how)
    listed = F.broadcast(left.sparkSession.createDataFrame(hot, StructType([StructField(key, left.schema[key].dataType), StructField("_salts", IntegerType())])))  # bounded by the partitions
    a = left.withColumn("_spread", F.xxhash64(spread)).join(listed, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.col("_spread"), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts", "_spread")
    b = right.join(listed, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def hub_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """:func:`salted_join` of a table whose hubs are not known yet: its keys are counted first (one map-side combined pass)."""
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return salted_join(left, right, key, hot_keys(counted, key), F.struct(*spread), how)


def bucketed_rank(df: DataFrame, group: list[str], order: str, weight: Column | None = None, name: str = "rank", rows_a_bucket: int = 20_000, total_rows: int | None = None) -> DataFrame:
    """A running sum of ``weight`` (1 by default) before each row of its group, in pseudo-random order.

    Rows fall into hash buckets of about ``rows_a_bucket``; each (group, bucket) is ranked in its own
    task and starts where the buckets before it end. A group of any size costs only its buckets.
    ``order`` names a unique column.
    """
    rows = total_rows if total_rows is not None else df.count()
    buckets = max(1, -(-rows // rows_a_bucket))
    w = F.lit(1) if weight is None else weight
    bucket = F.pmod(F.xxhash64(order, F.lit(17)), F.lit(buckets))
    d = df.withColumn("_bucket", bucket).withColumn("_w", w)
    sums = d.groupBy(*group, "_bucket").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(F.xxhash64(order), order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = d.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = ranked.join(starts, on)
    return joined.select(*[F.col(c) for c in df.columns], (F.col("_start") + F.col("_in")).alias(name))
