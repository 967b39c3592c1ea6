"""The eight judges of an evaluation with their own thresholds; each a provider (question, context, answer) -> score.

Offline they are deterministic shares between 0 and 1; a null is a failed judgement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import evaluation

# Names and thresholds of the judges, in their order.
THRESHOLDS = {"Tone": 0.6, "Completeness": 0.5, "Clarity": 0.6, "ContextRelevance": 0.5, "RetrievalQuality": 0.5, "SourceAttribution": 0.3, "Faithfulness": 0.5, "AnswerRelevancy": 0.5}


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _share(of: Column, among: Column) -> Column:
    """The share of the words of one text that another has; 0 where it has none."""
    a, b = _words(of), _words(among)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def _clarity(answer: Column) -> Column:
    """1 for sentences of up to 25 words on average, falling with their length."""
    words = F.size(F.regexp_extract_all(answer, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    sentences = F.greatest(F.size(F.regexp_extract_all(answer, F.lit(r"[.!?]+(\s|$)"), F.lit(0))), F.lit(1))
    return F.least(F.lit(1.0), F.lit(25.0) * sentences / F.greatest(words, F.lit(1)))


JUDGES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "Tone": lambda q, c, a: F.when(a.rlike(r"!{2,}|\p{Lu}{12,}"), 0.0).otherwise(1.0),
    "Completeness": lambda q, c, a: _share(q, a),
    "Clarity": lambda q, c, a: _clarity(a),
    "ContextRelevance": lambda q, c, a: _share(q, c),
    "RetrievalQuality": lambda q, c, a: F.least(F.lit(1.0), F.length(F.coalesce(c, F.lit(""))) / F.lit(500.0)),
    "SourceAttribution": lambda q, c, a: F.when(F.lower(a).rlike(r"\[\d+\]|source|according to|reported by"), 1.0).otherwise(0.0),
    "Faithfulness": lambda q, c, a: _share(a, c),
    "AnswerRelevancy": lambda q, c, a: _share(q, a),
}


def judge(cases: DataFrame, judges: dict[str, Callable] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Every case judged by every judge, in the long form the rollups read.

    cases: test_idx, category, query, context, final_answer. Each judge's success is its score at or above its own
    threshold; a null score is an error.
    """
    judges, thresholds = judges or JUDGES, thresholds or THRESHOLDS
    q, c, a = F.col("query"), F.coalesce(F.col("context"), F.lit("")), F.col("final_answer")
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(f(q, c, a).cast("double"), 6).alias("score"), F.lit(float(thresholds[n])).alias("threshold")) for n, f in judges.items()])
    rows = cases.select("test_idx", "category", F.explode(each).alias("m")).select("test_idx", "category", "m.*")
    rows = rows.withColumns({"secs": F.lit(0.0), "error": F.col("score").isNull(), "skipped": F.lit(False), "success": F.lit(None).cast("boolean")})
    return evaluation.judged(rows).select("test_idx", "category", "metric", "score", "success", "threshold", "secs", "error", "skipped")
