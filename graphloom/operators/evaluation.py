"""Rollups of test-case evaluations.

The long table (test_idx, category, metric, score, success, threshold, secs, error, skipped) is the
form all rollups read. Ratios of nothing are 0, extremes of nothing null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.functions import text as fn


def judged(rows: DataFrame) -> DataFrame:
    """Fill in ``success`` where a judge gave none: score at or above the threshold; errors have none."""
    return rows.withColumn("success", F.when(F.coalesce(F.col("error"), F.lit(False)), F.lit(None)).otherwise(F.coalesce("success", F.col("score") >= F.col("threshold"))))


def metric_summary(rows: DataFrame) -> DataFrame:
    """Per metric: passed, failed, errors, pass rate in percent, average, least and greatest score."""
    passed, failed = F.count_if(F.col("success")), F.count_if(~F.col("success"))
    return rows.groupBy("metric").agg(
        passed.alias("passed"), failed.alias("failed"), F.count_if(F.col("error")).alias("errors"),
        F.round(F.when(passed + failed > 0, 100.0 * passed / (passed + failed)).otherwise(0.0), 6).alias("pass_rate"),
        F.round(F.avg("score"), 6).alias("average_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
    )


def overall(rows: DataFrame) -> DataFrame:
    """Per test: whether all metrics succeeded; an error fails, a skipped metric does not."""
    ok = F.coalesce(F.col("success"), F.coalesce(F.col("skipped"), F.lit(False)))
    return rows.groupBy("test_idx").agg(F.bool_and(ok & ~F.coalesce(F.col("error"), F.lit(False))).alias("overall_passed"))


def overall_rate(rows: DataFrame) -> DataFrame:
    """Tests, passed tests and the rate in percent."""
    return overall(rows).agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("overall_passed").alias("passed"), F.round(F.when(F.count(F.lit(1)) > 0, 100.0 * F.count_if("overall_passed") / F.count(F.lit(1))).otherwise(0.0), 6).alias("rate")
    )


def wide(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per test with six text columns per metric; the metric list is given, so no pass discovers it."""
    out = []
    for m in metrics:
        pick = lambda c, m=m: F.first(F.when(F.col("metric") == m, F.col(c)), ignorenulls=True)
        score, success = pick("score"), pick("success")
        out += [
            F.when(score.isNotNull(), F.format_string("%.4f", score)).otherwise("N/A").alias(f"{m}_score"),
            F.when(success, "PASS").when(~success, "FAIL").otherwise("N/A").alias(f"{m}_status"),
            pick("threshold").alias(f"{m}_threshold"),
            F.when(pick("secs").isNotNull(), F.format_string("%.2f", pick("secs"))).otherwise("N/A").alias(f"{m}_secs"),
            F.when(F.coalesce(pick("error"), F.lit(False)), "Yes").otherwise("No").alias(f"{m}_error"),
            F.when(F.coalesce(pick("skipped"), F.lit(False)), "Yes").otherwise("No").alias(f"{m}_skipped"),
        ]
    return rows.groupBy("test_idx", "category").agg(*out)


def long(results: DataFrame) -> DataFrame:
    """One row per test and metric of nested results with a map of metrics."""
    return results.select("test_case_index", "category", F.explode(F.map_entries("metrics")).alias("m")).select(
        F.col("test_case_index").alias("test_idx"), "category", F.col("m.key").alias("metric"), "m.value.score", "m.value.success", "m.value.threshold",
        F.col("m.value.evaluation_time_seconds").alias("secs"), "m.value.error", "m.value.skipped",
    )


def unpivot(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Score columns into (ids..., metric, score)."""
    return rows.unpivot(ids, metrics, "metric", "score")


def category_rollup(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per category: tests, passed tests, and pass rate and average per metric; a grand total row has a null category."""
    tests = overall(rows).join(rows.select("test_idx", "category").distinct(), "test_idx")
    totals = tests.rollup("category").agg(F.grouping("category").alias("g"), F.count(F.lit(1)).alias("tests"), F.count_if("overall_passed").alias("passed"))
    columns = []
    for m in metrics:
        mine = F.col("metric") == m
        p, f = F.count_if(mine & F.col("success")), F.count_if(mine & ~F.col("success"))
        columns += [F.round(F.when(p + f > 0, 100.0 * p / (p + f)).otherwise(0.0), 6).alias(f"{m}_pass_rate"), F.round(F.avg(F.when(mine, F.col("score"))), 6).alias(f"{m}_average")]
    per = rows.rollup("category").agg(F.grouping("category").alias("g"), *columns)
    return totals.alias("a").join(per.alias("b"), (F.col("a.g") == F.col("b.g")) & F.col("a.category").eqNullSafe(F.col("b.category"))).select("a.category", "tests", "passed", *[F.col(f"b.`{c}`") for c in per.columns[2:]])


def per_category(questions: DataFrame) -> DataFrame:
    """Questions per category with the total in a row of null category."""
    return questions.rollup("category").agg(F.count(F.lit(1)).alias("questions"))


def success_rate(cases: DataFrame, error: str) -> DataFrame:
    """Percent of cases without an error."""
    bad = F.count_if(F.coalesce(F.col(error), F.lit("")) != "")
    n = F.count(F.lit(1))
    return cases.agg(n.alias("cases"), bad.alias("errors"), F.round(F.when(n > 0, 100.0 * (n - bad) / n).otherwise(0.0), 6).alias("rate"))


def usable_cases(cases: DataFrame, limit: int | None = None) -> DataFrame:
    """Cases with a query and an answer, their context as parts; a head limit applies before the filter."""
    rows = cases.limit(limit) if limit else cases
    context = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("retrieval_context", "rag_context", "graph_context") if c in cases.columns], F.lit(""))
    kept = rows.where((fn.strip(F.col("query")) != "") & (fn.strip(F.col("final_answer")) != ""))
    return kept.withColumn("context_parts", fn.context_parts(context))
