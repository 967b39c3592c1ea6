"""Full-text ranking over names and texts by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bm25(documents: DataFrame, key: str, text: str, query: str | list[str], k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the k best documents for a query, ties by key.

    One pass counts the query's terms per document; only documents that have one go on. Statistics
    are over all documents. Null texts are empty documents.
    """
    wanted = sorted({t.lower() for t in (query.split() if isinstance(query, str) else query)})
    words = terms(F.coalesce(F.col(text), F.lit("")))

    def uses(term: str) -> Column:
        return F.size(F.filter("w", lambda x: x == F.lit(term)))

    counted = documents.select(key, words.alias("w")).select(key, F.size("w").alias("n"), *[uses(t).alias(f"tf{i}") for i, t in enumerate(wanted)])
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.greatest(F.col("mean"), F.lit(1e-9))))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0
    scored = counted.where(hit).join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def containing(documents: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Documents that hold any of the words, whatever the case; at most six words are asked for."""
    low = F.lower(text)
    found = F.exists(F.array(*[F.lit(w.lower()) for w in words[:6]]), lambda w: F.contains(low, w))
    return documents.where(found)
