"""Exact and approximate nearest neighbours over embedding tables.

Queries are a stated, small set; the vectors are any number. The exact search keeps per-task heaps:
each scan partition meets the broadcast block of queries once in a matrix product and emits its best
k per query, so what is shuffled is queries x k x tasks rows, never pairs. Query sets beyond
``QUERY_BLOCK`` go in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.functions import vector as vx
from graphloom.storage import materialize

#: Queries held by a task at once (times 64 doubles: some megabytes).
QUERY_BLOCK = 512


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of greatest cosine per query, ties by id.

    queries: (query_id, embedding); vectors: (vec_id, embedding). Null embeddings match nothing;
    zero vectors score 0. Vectors have one length.
    """
    spark = vectors.sparkSession
    held = materialize(queries.where(F.col(embedding).isNotNull()).select(F.col(query_id).cast("bigint").alias("q"), F.col(embedding).cast("array<double>").alias("e")), "queries")
    rows = vectors.where(F.col(embedding).isNotNull()).select(F.col(vector_id).cast("bigint").alias("v"), F.col(embedding).cast("array<double>").alias("e"))
    total = held.count()
    parts = []
    for block in range(max(1, -(-total // QUERY_BLOCK))):
        blocks = -(-total // QUERY_BLOCK) or 1
        mine = held.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).orderBy("q").collect()
        ids = np.array([r.q for r in mine], dtype=np.int64)
        matrix = np.array([r.e for r in mine], dtype=np.float64) if mine else np.zeros((0, 1))
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True) if len(mine) else np.ones((0, 1))
        shared = spark.sparkContext.broadcast((ids, matrix / np.where(lengths > 0, lengths, 1)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            scores = np.zeros((len(ids), 0))
            found = np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                v = np.array(batch.column(0).to_pylist(), dtype=np.int64)
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                scores = np.concatenate([scores, matrix @ (m / np.where(n > 0, n, 1)).T], axis=1)
                found = np.concatenate([found, np.tile(v, (len(ids), 1))], axis=1)
                order = np.lexsort((found, -np.round(scores, 9)), axis=1)[:, :k]
                scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            width = scores.shape[1]
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(ids, width)), "v": pa.array(found.ravel()), "s": pa.array(scores.ravel())})

        parts.append(rows.mapInArrow(best, "q bigint, v bigint, s double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "v")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("v").alias(vector_id), F.round("s", 6).alias("score"), "rank")


def adjacent_distance(rows: DataFrame, key: str, order: str, embedding: str = "embedding") -> DataFrame:
    """Adds ``distance``: 1 - cosine to the next row of the same key; null for the last."""
    following = F.lead(embedding).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_next", following).withColumn("distance", F.when(F.col("_next").isNotNull(), 1 - vx.cosine(F.col(embedding), F.col("_next")))).drop("_next")


def breakpoints(distances: DataFrame, key: str, order: str, share: float = 0.95) -> DataFrame:
    """Adds ``threshold`` (exact percentile per key), ``is_break`` (strictly above it) and ``grp`` (islands between breaks)."""
    limit = F.percentile("distance", F.lit(share)).over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy(order)
    marked = distances.withColumn("threshold", limit).withColumn("is_break", F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)))
    before = F.coalesce(F.lag(F.col("is_break").cast("int")).over(w), F.lit(0))
    return marked.withColumn("_b", before).withColumn("grp", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def first_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of several queries as one list without repeats: the first by query and rank stays."""
    w = Window.partitionBy(*keys).orderBy("query_id", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lsh_neighbours(vectors: DataFrame, queries: DataFrame, k: int, rows_a_bucket: int = 128, tables: int = 12, probes: int | None = None, seed: int = 7) -> DataFrame:
    """Approximate neighbours by random hyperplanes: rows share a table's bucket if their signs agree.

    The number of planes grows with the logarithm of the number of vectors, so that a bucket holds about
    ``rows_a_bucket``; the buckets a query looks into grow with it: its own and those across the planes it
    lies nearest to, one or two at a time. Every row is indexed in every table, by id and bucket alone. Candidates are distinct
    (query, vector) pairs; their vectors are joined once and scored exactly.
    """
    total = vectors.count()
    bits = max(4, round(np.log2(max(1, total) / rows_a_bucket)))
    probes = probes or max(2, bits * (bits - 3) // 2)
    rng = np.random.default_rng(seed)
    some = vectors.select("embedding").where("embedding is not null").first()
    width = len(some[0]) if some else 1
    planes = rng.normal(size=(tables, bits, width))
    flips = [(1 << i,) for i in range(bits)] + [(1 << i, 1 << j) for i in range(bits) for j in range(i)]

    def index(df: DataFrame, name: str, looks: int) -> DataFrame:
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
                codes = np.zeros((batch.num_rows, tables * looks), dtype=np.int64)
                if batch.num_rows:
                    for t in range(tables):
                        side = m @ planes[t].T
                        codes[:, t] = (side > 0) @ (1 << np.arange(bits))
                        if looks > 1:
                            near = np.stack([sum(side[:, f.bit_length() - 1] ** 2 for f in flip) for flip in flips], axis=1)
                            order = np.argsort(near, axis=1, kind="stable")[:, : looks - 1]
                            masks = np.array([sum(flip) for flip in flips])[order]
                            for p in range(masks.shape[1]):
                                codes[:, (p + 1) * tables + t] = codes[:, t] ^ masks[:, p]
                            for p in range(masks.shape[1], looks - 1):
                                codes[:, (p + 1) * tables + t] = codes[:, t]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "codes"])

        rows = df.where("embedding is not null").select(F.col(name).cast("bigint").alias("id"), F.col("embedding").cast("array<double>"))
        signed = rows.mapInArrow(sign, "id bigint, codes array<bigint>").select("id", F.posexplode("codes").alias("tab", "code"))
        return signed.select("id", (F.col("tab") % tables).alias("tab"), "code")

    a = index(vectors, "vec_id", 1).withColumnRenamed("id", "vec_id")
    b = index(queries, "query_id", probes).withColumnRenamed("id", "query_id")
    pairs = a.join(b, ["tab", "code"]).select("query_id", "vec_id").distinct()
    ve = vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("ve"))
    qe = queries.where("embedding is not null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("qe"))
    scored = pairs.join(ve, "vec_id").join(qe, "query_id").select("query_id", "vec_id", F.round(vx.cosine(F.col("qe"), F.col("ve")), 6).alias("score")).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
