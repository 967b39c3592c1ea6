"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm import canonical, format_duplicates, frequency, mixture, mojibake, packing, scans, sizes
from graphloom.storage import materialize
from graphloom.tables import table


def _type_rows(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "graph_nodes").select(F.lit("nodes.type").alias("field"), F.col("type").alias("term"), "graph_doc_id")
    rels = table(spark, d, "graph_relationships").select(F.lit("relationships.type").alias("field"), F.col("type").alias("term"), "graph_doc_id")
    return nodes.unionByName(rels)


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every type with its rows, its graph documents and its mark."""
    counted = frequency.term_frequencies(_type_rows(spark, d), F.col("field"), F.col("term"), F.col("graph_doc_id"))
    marked = frequency.mark(counted, table(spark, d, "graph_sources"))
    return marked.select(F.col("grp").alias("field"), F.col("ngram").alias("term"), F.col("occurrences").alias("n_rows"), F.col("records").alias("n_docs"), "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The types that are too rare or too common."""
    return p3_terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and graph documents of all word n-grams of the types, however long."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    counted = frequency.ngram_frequencies(_type_rows(spark, d), F.col("field"), F.col("term"), F.col("graph_doc_id"), tokenize=words)
    return counted.select(F.col("grp").alias("field"), "ngram", "n", "occurrences", "records")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of records that differ only in formatting, each with the first of its group."""
    return format_duplicates.copies(table(spark, d, "graph_jsonl")).select("first_line_id", "line_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    return format_duplicates.collapse(table(spark, d, "graph_jsonl"))


def _typed_rows(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("id", "type")])
    return table(spark, d, "graph_nodes").select("node_row_id", F.explode(both).alias("x")).select("node_row_id", "x.field", "x.value")


def _generated() -> Column:
    """Ids that programs made: documents, images, sections."""
    return (F.col("field") == "id") & F.col("value").rlike(r"^img_\w+_\d+_\d+$|^\w+_raw_with_image_ids_with_captions$|^\w+::section::")


def p5_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every freely typed id and type with the registry entry it means and the score."""
    return canonical.map_rows(_typed_rows(spark, d), "node_row_id", table(spark, d, "entity_registry"), _generated())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every freely typed id and type with the registry entry it means, or -1."""
    return p5_mapped(spark, d).select("node_row_id", "field", "ref_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of chunks with page furniture, split words or misread words."""
    return scans.line_kinds(table(spark, d, "chunks"))


def p7_mended(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as continuous paragraphs."""
    return scans.mended(table(spark, d, "chunks"))


def _packed(spark: SparkSession, d: str, solutions: dict | None = None) -> DataFrame:
    return packing.pack_all(sizes.token_sizes(table(spark, d, "documents")), "doc_id", table(spark, d, "containers"), solutions)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one that exceeds the capacity, in its container, for each capacity."""
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are, and how many the linear program proves to be needed."""
    solutions: dict = {}
    return packing.fill_report(_packed(spark, d, solutions), table(spark, d, "containers"), solutions)


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    sized = sizes.token_sizes(table(spark, d, "documents"), keep=["source", "lang", "paper"]).withColumnRenamed("paper", "topic")
    return mixture.mix(sized, table(spark, d, "mixture_targets"))


def p9_fit(spark: SparkSession, d: str) -> DataFrame:
    """How near the mixture comes to the corpus's shares of every language and topic."""
    documents = table(spark, d, "documents")
    sized = materialize(sizes.token_sizes(documents, keep=["source", "lang", "paper"]).withColumnRenamed("paper", "topic"), "sized")
    targets = table(spark, d, "mixture_targets")
    return mixture.fit_report(mixture.mix(sized, targets), sized, targets)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their number of uses."""
    return _mixed(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source reached against its target."""
    return mixture.share_report(_mixed(spark, d), table(spark, d, "mixture_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least a part was decoded wrongly."""
    return mojibake.affected(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with their text as far as it can be recovered."""
    return mojibake.restore(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p3_ngrams, p4_found, p4_records, p5_found, p5_mapped, p7_found, p7_mended, p8_packed, p8_fill, p9_mixture, p9_shares, p9_fit, p10_found, p10_restored)}
_TYPES = """with t as (
  select 'nodes.type' as field, type as term, graph_doc_id from graph_nodes where type is not null
  union all select 'relationships.type', type, graph_doc_id from graph_relationships where type is not null),
g as (select field, term, count(*) as n_rows, count(distinct graph_doc_id) as n_docs from t group by all),
m as (select field, term, n_rows, n_docs,
  case when n_docs < 3 then 'rare' when n_docs > (select count(*) from graph_sources) / 3.0 then 'common' end as mark from g)
"""
ORACLES: dict[str, str] = {
    "p3_found": _TYPES + "select field, term, mark from m where mark is not null",
    "p3_terms": _TYPES + "select field, term, n_rows, n_docs, mark from m",
    "p3_ngrams": """with t as (
  select 'nodes.type' as field, type as term, graph_doc_id as doc from graph_nodes where type is not null
  union all select 'relationships.type', type, graph_doc_id from graph_relationships where type is not null),
w as (select field, doc, regexp_extract_all(lower(term), '[\\p{L}\\p{N}]+') as ws from t),
p as (select field, doc, ws, unnest(range(1, len(ws) + 1)) as i from w),
q as (select field, doc, ws, i, unnest(range(1, len(ws) - i + 2)) as n from p)
select field, array_to_string(ws[i:i + n - 1], ' ') as ngram, n::int as n, count(*) as occurrences, count(distinct doc) as records
from q where i + n - 1 <= len(ws) group by all""",
}
