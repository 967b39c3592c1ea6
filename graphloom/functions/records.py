"""Names, metadata, clocks and renderings of answers and test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The fields of an image's metadata block, in the order they are written.
SNIPPET_FIELDS = ["path", "page", "section", "image_relevance", "image_type", "semantic_role", "caption", "depicted_concepts", "confidence"]


def name_of(*candidates: Column) -> Column:
    """The first of id, text and name that a node has."""
    return F.coalesce(*candidates)


def metadata_without(metadata: Column, *keys: str) -> Column:
    """A map of metadata without some of its keys."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(list(keys)))


def is_image_source(source_id: Column) -> Column:
    """Whether a provenance pointer leads to the images of a Markdown file rather than to a chunk."""
    return F.coalesce(F.endswith(source_id, F.lit("::images")) | F.contains(source_id, F.lit(".md")), F.lit(False))


def chosen(values: list[str], picks: list[int]) -> list[str]:
    """The entries of a menu (numbered from 1) that were picked, in the order picked; numbers it lacks are dropped."""
    return [values[p - 1] for p in picks if 1 <= p <= len(values)]


def entity_list(name: Column, labels: Column) -> Column:
    """``- name (l1, l2)``."""
    return F.concat(F.lit("- "), name, F.lit(" ("), F.array_join(labels, ", "), F.lit(")"))


def stamp(clock: Column | None = None, compact: bool = False) -> Column:
    """A time in UTC as text; the clock is a parameter, now by default."""
    at = F.current_timestamp() if clock is None else clock
    return F.date_format(at, "yyyyMMdd_HHmmss" if compact else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latency_ms(seconds: Column) -> Column:
    """Whole milliseconds."""
    return F.floor(seconds * 1000).cast("int")


def run_id() -> Column:
    """A random id of a run."""
    return F.uuid()


def listed(values: Column) -> Column:
    """A list of texts as a literal: each quoted, separated by a comma and a space."""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def snippet(meta: Column, extras: Column | None = None) -> Column:
    """A metadata block as JSON with two spaces of indent: the fixed fields first, in their order, then ``extras`` (a map) by name."""
    fixed = [F.concat(F.lit(f'  "{name}": '), F.coalesce(F.to_json(F.array(meta[name])).substr(F.lit(2), F.length(F.to_json(F.array(meta[name]))) - 2), F.lit("null"))) for name in SNIPPET_FIELDS]
    lines = F.array(*fixed)
    if extras is not None:
        text = lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)
        more = F.transform(F.array_sort(F.map_keys(extras)), lambda k: F.concat(F.lit("  "), text(k), F.lit(": "), text(F.element_at(extras, k))))
        lines = F.concat(lines, F.coalesce(more, F.array().cast("array<string>")))
    return F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def snippet_value(line: Column) -> tuple[Column, Column]:
    """(key, value) of a line of a metadata block, read leniently: path and section as JSON text or without quotes, page as
    its digits only, anything else as JSON where it is one, else as it stands."""
    pattern = r'^\s*"?([^":]+)"?\s*:\s*(.*?)\s*,?\s*$'
    key = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    raw = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 2))
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    bare = F.regexp_replace(raw, "^[\"']|[\"']$", "")
    value = F.when(key == "page", F.nullif(F.regexp_replace(raw, "[^0-9]", ""), F.lit(""))).otherwise(F.coalesce(quoted, bare))
    return key, value


def micro_batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: slices of ``size`` rows of each group, from 0."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("int"))


def by_category(questions: DataFrame, category: str = "category", row: str = "row_no") -> DataFrame:
    """Questions by category, in file order inside: adds ``position`` from 1 within the category."""
    return questions.withColumn("position", F.row_number().over(Window.partitionBy(category).orderBy(row)))
