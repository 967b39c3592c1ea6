"""Ordered lines of documents: headers, page numbers, cleaning, fences.

Windows partition by document, so no group is larger than one document. Null texts have no lines;
an empty text has one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import text as fn


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line), line numbers from 1."""
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def _before(key: str, rows: int | None, current: bool) -> Window:
    start = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy(key).orderBy("line_no").rowsBetween(start, 0 if current else -1)


def section_of(line_table: DataFrame, key: str, include_current: bool = True) -> DataFrame:
    """Adds ``section``: the text of the nearest header before a line (or on it)."""
    header = F.when(fn.is_header(F.col("line")), fn.header_text(F.col("line")))
    return line_table.withColumn("section", F.last(header, ignorenulls=True).over(_before(key, None, include_current)))


def page_near(line_table: DataFrame, key: str, look_back: int = 10) -> DataFrame:
    """Adds ``page``: the nearest bare number in the ``look_back`` lines before a line."""
    number = F.when(fn.strip(F.col("line")).rlike("^[0-9]{1,9}$"), fn.strip(F.col("line")).try_cast("int"))
    return line_table.withColumn("page", F.last(number, ignorenulls=True).over(_before(key, look_back, False)))


def clean(line_table: DataFrame, key: str) -> DataFrame:
    """The lines that cleaning keeps, from the table of contents (or foreword) on."""
    title = F.lower(fn.strip(F.col("line"))).isin("contents", "foreword")
    start = F.coalesce(F.min(F.when(title, F.col("line_no"))).over(Window.partitionBy(key)), F.lit(1))
    return line_table.withColumn("_start", start).where((F.col("line_no") >= F.col("_start")) & ~fn.dropped_line(F.col("line"))).drop("_start")


def join_lines(line_table: DataFrame, key: str, extra: Column | None = None) -> DataFrame:
    """(key, text): lines put together again in order."""
    pairs = F.array_sort(F.collect_list(F.struct("line_no", (extra if extra is not None else F.col("line")).alias("line"))))
    return line_table.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n").alias("text"))


def clean_text(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): whole cleaned documents: lines dropped, blank runs cut to one, ends trimmed."""
    joined = join_lines(clean(lines(documents, key, text), key), key)
    body = F.regexp_replace("text", "\n{3,}", "\n\n")
    return joined.select(key, fn.strip(F.array_join(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, f"{fn.WS}+$", "")), "\n")).alias("text"))


def in_fence(line_table: DataFrame, key: str) -> DataFrame:
    """Adds ``fenced``: whether a line lies in a fence; one that never ends runs to the end of the document."""
    mark = F.when(fn.strip(F.col("line")).startswith("```"), 1).otherwise(0)
    marked = line_table.withColumn("_m", mark)
    upto = F.sum("_m").over(_before(key, None, True))
    return marked.withColumn("fenced", (upto % 2 == 1) | (F.col("_m") == 1)).drop("_m")


def sentence_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence), from 0."""
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(fn.sentences(F.col(text))).alias("idx", "sentence"))


def sentence_windows(sentence_rows: DataFrame, key: str, buffer: int = 1) -> DataFrame:
    """Adds ``combined``: each sentence with its ``buffer`` neighbours on both sides."""
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(-buffer, buffer)
    return sentence_rows.withColumn("combined", F.array_join(F.collect_list("sentence").over(w), " "))
