"""Deterministic offline providers: column expressions with the contracts of model calls.

They keep each call's output schema and its default on failure, so plans and tests run without a
network. All stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def entities(text: Column) -> Column:
    """Entities of a text: runs of three capitalised words; null texts have none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0)), F.array().cast("array<string>"))


def grounded(name: Column, text: Column) -> Column:
    """Whether a text holds a name, whatever the case; False where either is missing."""
    return F.coalesce(F.contains(F.lower(text), F.lower(name)), F.lit(False))


def relation_grounded(src: Column, dst: Column, text: Column) -> Column:
    """Whether a text holds both ends of a relation."""
    return grounded(src, text) & grounded(dst, text)


def plausible(src_type: Column, src: Column, rel: Column, dst_type: Column, dst: Column) -> Column:
    """``yes``, ``no`` (a thing related to itself) or ``unclear`` (a part is missing)."""
    missing = src_type.isNull() | dst_type.isNull() | rel.isNull() | src.isNull() | dst.isNull()
    return F.when(missing, "unclear").when(src == dst, "no").otherwise("yes")


def subqueries(question: Column) -> Column:
    """One to five distinct sub-queries of a question: its clauses; the question itself where it has one."""
    parts = F.array_distinct(F.filter(F.transform(F.split(question, r"[?;]| and "), lambda p: F.trim(p)), lambda p: p != ""))
    return F.when(F.size(parts) > 0, F.slice(parts, 1, 5)).otherwise(F.array(question))


def answer(question: Column, context: Column) -> Column:
    """An answer that quotes the context's beginning; an error text where the context is empty."""
    return F.when(F.length(context) > 0, F.concat(F.lit("Answer to: "), question, F.lit("\n"), F.substring(context, 1, 500))).otherwise("Error: no context")


def caption(image_id: Column, path: Column) -> Column:
    """Caption metadata of an image."""
    return F.struct(
        F.lit("relevant").alias("image_relevance"), F.lit("figure").alias("image_type"), F.lit("illustration").alias("semantic_role"),
        F.concat(F.lit("Figure "), image_id).alias("caption"), F.array(F.lit("figure")).alias("depicted_concepts"), F.lit("low").alias("confidence"),
    )


def judge_score(question: Column, answer_text: Column) -> Column:
    """A judge's score: the share of the question's words that the answer uses."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    used = F.filter(words, lambda w: F.contains(F.lower(answer_text), w))
    return F.when(F.size(words) > 0, F.size(used) / F.size(words)).otherwise(0.0)


def embedding(text: Column, width: int = 64) -> Column:
    """A unit vector by signed feature hashing of words; zeros for no words, null for null.

    Every word becomes the letter of its place and sign, once; what a place holds is how often its two letters occur. The
    words are read in one pass, whatever the width (10,000 at most).
    """
    from graphloom.functions.vector import unit

    letters = [chr(33 + i) for i in range(2 * width)]  # of the places with a plus, then of those with a minus
    alphabet = F.array(*[F.lit(c) for c in letters])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(width)) + F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 0).otherwise(width)
    written = F.array_join(F.transform(words, lambda w: F.element_at(alphabet, (place(w) + 1).cast("int"))), "")
    uses = lambda s, c: (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))) / F.lit(len(c.encode()))
    totals = F.transform(F.array(written), lambda s: F.array(*[uses(s, letters[i]) - uses(s, letters[width + i]) for i in range(width)]))  # the list of one holds the text, which is read many times
    return F.when(text.isNotNull(), unit(totals[0]))


def relations(text: Column) -> Column:
    """Relations of a text: each entity mentions the next one after it."""
    found = entities(text)
    pairs = F.arrays_zip(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))).alias("source"), F.slice(found, 2, F.size(found)).alias("target"))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["source"] != p["target"]), lambda p: F.struct(p["source"].alias("source"), F.lit("MENTIONS").alias("type"), p["target"].alias("target"))))


def graph(text: Column) -> Column:
    """Nodes and relationships of a text; null where it names nothing."""
    nodes = F.transform(F.array_distinct(entities(text)), lambda e: F.struct(e.alias("id"), F.lit("Concept").alias("type")))
    return F.when(F.size(nodes) > 0, F.struct(nodes.alias("nodes"), relations(text).alias("relationships")))
