"""Images in Markdown: references, stable ids, metadata blocks, captions and the image graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.functions import text as fn
from graphloom.operators import lines as ln
from graphloom.schema import IMAGE_BLOCK

IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"


def count_images(text: F.Column) -> F.Column:
    """Number of image references of any form."""
    return F.regexp_count(text, F.lit(r"!\[.*?\]\(.*?\)"))


def image_refs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, pos, image_path, page_number, section_header) of every image reference.

    The page comes from the file name, else from a bare number in the ten lines before; the section
    is the nearest header strictly before the line.
    """
    rows = ln.page_near(ln.section_of(ln.lines(documents, key, text), key, include_current=False), key)
    found = rows.select(key, "line_no", "section", "page", F.posexplode(F.regexp_extract_all("line", F.lit(IMAGE_REF), F.lit(1))).alias("pos", "image_path"))
    return found.select(key, "line_no", "pos", "image_path", F.coalesce(fn.page_from_filename(F.col("image_path")), "page").alias("page_number"), F.col("section").alias("section_header"))


def snippet(image_id: F.Column, path: F.Column, page: F.Column, section: F.Column) -> F.Column:
    """The metadata block of one image as text (fenced JSON without the outer braces)."""
    return F.concat(
        F.lit('```json\n"'), image_id, F.lit('": {\n  "path": "'), path, F.lit('",\n  "page": '), page.cast("string"), F.lit(',\n  "section": "'), F.coalesce(section, F.lit("None")), F.lit('",\n}\n```')
    )


def assign_ids(documents: DataFrame, key: str, text: str, stem: F.Column, paper: F.Column | None = None) -> DataFrame:
    """(key, text): image references taken out of their lines, a metadata block with a stable id after the line for each."""
    rows = ln.section_of(ln.lines(documents, key, text), key)
    rows = rows.join(documents.select(key, stem.alias("_stem")), key)
    paths = F.regexp_extract_all("line", F.lit(IMAGE_REF), F.lit(1))
    page = lambda p: F.coalesce(fn.image_name_parts(p)[1], fn.page_from_filename(p), F.lit(0))
    blocks = F.transform(paths, lambda p: snippet(fn.image_id(p, F.col("_stem"), paper), p, page(p), F.col("section")))
    rest = F.regexp_replace("line", IMAGE_REF, "")
    kept = F.when(F.size(paths) == 0, F.array("line")).otherwise(F.concat(F.array(rest), blocks))
    return ln.join_lines(rows.withColumn("_out", F.array_join(kept, "\n")), key, F.col("_out"))


def blocks(text: F.Column) -> F.Column:
    """The bodies of a text's fenced JSON blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?is)```json\s*(.*?)\s*```"), F.lit(1))


def repair_json(body: F.Column) -> F.Column:
    """A block body without commas before a closing bracket."""
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def block_images(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, image_id, meta): the images of all metadata blocks, the last of a repeated id.

    Blocks that are no JSON and entries that are no objects or no images are skipped.
    """
    each = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(blocks(F.col(text))).alias("block", "body"))
    body = repair_json(F.regexp_replace(fn.strip(F.col("body")), r",\s*$", ""))
    wrapped = F.when(body.startswith("{"), body).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    parsed = each.select(key, "block", F.from_json(wrapped, T.MapType(T.StringType(), IMAGE_BLOCK)).alias("m")).where("m is not null")
    rows = parsed.select(key, "block", F.posexplode(F.map_entries("m")).alias("pos", "e")).select(key, "block", "pos", F.col("e.key").alias("image_id"), F.col("e.value").alias("meta"))
    rows = rows.where(F.col("image_id").startswith("img_") & F.col("meta").isNotNull())
    rank = F.struct("block", "pos")
    return rows.groupBy(key, "image_id").agg(F.max_by("meta", rank).alias("meta"), F.min(rank).alias("at"))


def image_graph(found: DataFrame, document_id: F.Column) -> DataFrame:
    """(rel, src_type, src, dst_type, dst): PART_OF, LOCATED_IN and DEPICTS edges of captioned images."""
    image = found.where(F.coalesce(F.col("meta.caption"), F.lit("")) != "").withColumn("doc", document_id)
    section = F.concat(F.col("doc"), F.lit("::section::"), F.when(F.coalesce(F.col("meta.section"), F.lit("")) != "", F.col("meta.section")).otherwise("Unknown"))
    part = image.select(F.lit("PART_OF").alias("rel"), F.lit("Document").alias("dst_type"), F.col("doc").alias("dst"), "image_id")
    place = image.select(F.lit("LOCATED_IN").alias("rel"), F.lit("Section").alias("dst_type"), section.alias("dst"), "image_id")
    shown = image.select(F.explode("meta.depicted_concepts").alias("c"), "image_id").where(F.trim("c") != "").select(F.lit("DEPICTS").alias("rel"), F.lit("Concept").alias("dst_type"), F.trim("c").alias("dst"), "image_id")
    return part.unionByName(place).unionByName(shown).select("rel", F.lit("Image").alias("src_type"), F.col("image_id").alias("src"), "dst_type", "dst").distinct()


def image_nodes(graph: DataFrame, document_ids: DataFrame) -> DataFrame:
    """(type, id) of an image graph: its documents (also without captions), images, sections and concepts."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("src_type").alias("type"), F.col("src").alias("id")), F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("id")))).alias("n")).select("n.*")
    return ends.unionByName(document_ids.select(F.lit("Document").alias("type"), F.col("id"))).distinct()


def merge_captions(found: DataFrame, captions: DataFrame) -> DataFrame:
    """Metadata with captions (image_id, caption struct fields) laid over it; images without a caption stay as they are."""
    fields = [f for f in captions.columns if f != "image_id"]
    joined = found.join(captions.select("image_id", F.struct(*fields).alias("cap")), "image_id", "left")
    laid = F.struct(*[(F.coalesce(F.col(f"cap.{f.name}"), F.col(f"meta.{f.name}")) if f.name in fields else F.col(f"meta.{f.name}")).alias(f.name) for f in IMAGE_BLOCK.fields])
    return joined.withColumn("meta", laid).drop("cap")
