"""Scalar text functions as column expressions.

White space is the explicit class ``[ \\t\\n\\r\\f]`` throughout, so that results do not depend on a
regex dialect's idea of it. Null in, null out unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WS = r"[ \t\n\r\f]"
# Names of sections that are set as a bold line of their own.
COMMON_SECTIONS = ["Abstract", "Introduction", "Background", "Conclusion", "References", "Acknowledgements", "Acknowledgments"]
# Places whose lines are publishers' imprints.
IMPRINT_PLACES = ["New York", "Chicago", "San Francisco", "Lisbon", "London", "Madrid", "Mexico City"]
# Image file endings and their media types.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}


def strip(column: Column) -> Column:
    """Trim the white-space class on both sides."""
    return F.regexp_replace(column, f"^{WS}+|{WS}+$", "")


def sentences(text: Column) -> Column:
    """Array of sentences: split after ``.``, ``?`` or ``!`` and white space; an empty tail stays."""
    return F.split(text, rf"(?<=[.?!]){WS}+")


def word_count(text: Column) -> Column:
    """Number of runs of non-space."""
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def excerpt(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, with ``mark`` where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def page_from_filename(path: Column) -> Column:
    """The page of ``<paper>-<page>-<index>.<image ending>``, or null."""
    return F.regexp_extract(path, r"(?i)-(\d+)-\d+\.(png|jpg|jpeg|gif|svg)", 1).try_cast("int")


def image_name_parts(path: Column) -> tuple[Column, Column, Column]:
    """(paper, page, index) of ``<paper>.pdf-<page>-<index>.<ending>``; null where the name has another form."""
    name = F.element_at(F.split(path, "/"), -1)
    pattern = r"(?i)^(.+?)\.pdf-(\d+)-(\d+)\.(png|jpg|jpeg|gif|svg)$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return part(1), part(2).try_cast("int"), part(3).try_cast("int")


def image_id(path: Column, fallback_paper: Column, paper: Column | None = None) -> Column:
    """``img_<paper>_<page>_<index>``; unparsed names take the fallback paper, the page in the name or 0, and index 0."""
    stem, page, index = image_name_parts(path)
    known = stem.isNotNull()
    chosen = paper if paper is not None else F.when(known, stem).otherwise(fallback_paper)
    pages = F.when(known, page).otherwise(F.coalesce(page_from_filename(path), F.lit(0)))
    return F.concat_ws("_", F.lit("img"), chosen, pages.cast("string"), F.when(known, index).otherwise(0).cast("string"))


def is_header(line: Column) -> Column:
    """Whether a Markdown line is a section header (level two or deeper, bold number and title, or a known bold name)."""
    t = strip(line)
    bold = t.rlike(r"^\*\*[A-Z][^*]*\*\*$") & (F.length(t) < 100)
    named = F.exists(F.array(*[F.lit(s) for s in COMMON_SECTIONS]), lambda s: F.contains(t, s))
    return t.rlike(r"^##+[ \t]*\*?\*?[^*]") | t.rlike(r"^\*\*[0-9]+(\.[0-9]+)?\*\*[ \t]+\*\*[^*]") | (bold & named)


def header_text(line: Column) -> Column:
    """A header without its marks, white space collapsed."""
    t = F.regexp_replace(strip(line), rf"^##+{WS}*", "")
    return strip(F.regexp_replace(F.replace(t, F.lit("**"), F.lit("")), f"{WS}+", " "))


def dropped_line(line: Column) -> Column:
    """Whether cleaning drops a line: blank-page notice, bare number, bare roman number, imprint, rubbish, short odd bits."""
    t = strip(line)
    places = F.exists(F.array(*[F.lit(p) for p in IMPRINT_PLACES]), lambda p: F.contains(line, p))
    return (
        F.contains(F.lower(line), F.lit("this page intentionally left blank"))
        | line.rlike(rf"^{WS}*[0-9]+{WS}*$")
        | F.lower(line).rlike(rf"^{WS}*[ivxlcdm]+{WS}*$")
        | places
        | line.rlike(r"^[^\p{L}\p{N}]{10,}$")
        | ((F.length(t) > 0) & (F.length(t) < 5) & ~t.rlike(rf"^([A-Za-z0-9]|{WS})+$"))
    )


def last_segment(source_id: Column) -> Column:
    """What follows the last ``::``."""
    return F.element_at(F.split(source_id, "::"), -1)


def numeric_suffix(chunk_id: Column) -> Column:
    """``_<digits>`` at the end of an id, or null."""
    return F.nullif(F.regexp_extract(chunk_id, r"(_[0-9]+)$", 1), F.lit(""))


def media_type(path: Column) -> Column:
    """Media type by file ending; PNG where it is none of the known."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.when(F.lit(False), F.lit(""))
    for e, m in IMAGE_TYPES.items():
        out = out.when(ending == e, m)
    return out.otherwise("image/png")


def context_parts(context: Column) -> Column:
    """A retrieval context split at blank lines, trimmed, without empty parts; the whole where nothing is left."""
    parts = F.filter(F.transform(F.split(context, "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(context))


def fill_prompt(template: Column, chunk: Column, known_ids: Column) -> Column:
    """A prompt with the chunk put in first and the list of known ids after it (``None`` for none)."""
    listed = F.when(F.size(known_ids) > 0, F.array_join(known_ids, ", ")).otherwise("None")
    return F.replace(F.replace(template, F.lit("{chunk}"), chunk), F.lit("{entities}"), listed)


def json_strings(json_text: Column, depth: int = 8) -> Column:
    """The string values anywhere in a JSON text (escapes resolved, field names left out), down to ``depth`` levels; null for broken JSON."""
    level = F.array(F.try_parse_json(json_text))
    found = F.array().cast("array<string>")
    for _ in range(depth):
        kind = lambda v: F.schema_of_variant(v)
        found = F.concat(found, F.filter(F.transform(level, lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull()))
        items = F.flatten(F.transform(level, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))))
        level = F.filter(items, lambda v: v.isNotNull())
    return found


def nested_strings(value: Column, mark: str) -> Column:
    """Distinct strings anywhere in a nested value that hold ``mark``."""
    return F.array_distinct(F.filter(json_strings(F.to_json(value)), lambda s: F.contains(s, F.lit(mark))))


def nested_int(json_text: Column, key: str) -> Column:
    """The integer under ``key`` of a JSON object: at its top, else the last that its objects below have; null where there is none."""
    value = F.try_parse_json(json_text)
    top = F.try_variant_get(value, f"$.{key}", "bigint")
    below = F.transform(F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), lambda v: F.try_variant_get(v, f"$.{key}", "bigint"))
    return F.coalesce(top, F.try_element_at(F.filter(below, lambda v: v.isNotNull()), F.lit(-1)))


def evidence_ids(block: Column) -> Column:
    """The ids of an evidence block's ``- id | rest`` lines, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^- ([^|\n]+)"), F.lit(1)), lambda x: F.trim(x)))


def with_block(answer: Column, title: str, body: Column) -> Column:
    """An answer with an evidence block put at its end, unless it holds the block's title or there is no evidence."""
    missing = ~F.contains(answer, F.lit(title)) & (F.length(body) > 0)
    return F.when(missing, F.concat(answer, F.lit(f"\n\n{title}\n"), body)).otherwise(answer)


def without_section(text: Column, title: str) -> Column:
    """A text without the section that starts with ``title``: its line, the non-blank lines after it and one blank line."""
    return F.regexp_replace(text, rf"(?m)^\Q{title}\E[^\n]*\n(?:[^\n]*\S[^\n]*\n?)*\n?", "")


def without_prefix(source_id: Column, stem: Column) -> Column:
    """A source id without its file stem in front; only ids without ``::``."""
    cut = F.regexp_replace(F.substring(source_id, F.length(stem) + 1, F.length(source_id)), "^_+", "")
    return F.when(~F.contains(source_id, F.lit("::")) & F.startswith(source_id, stem), cut).otherwise(source_id)


def snippet_field(line: Column) -> tuple[Column, Column]:
    """(key, value) of one line of a metadata block, quotes and a comma at the end taken off; page digits stay as text."""
    pattern = r'^\s*"([^"]+)"\s*:\s*(.*?)\s*,?\s*$'
    value = F.regexp_extract(line, pattern, 2)
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.when(line.rlike(pattern), F.regexp_replace(value, '^"|"$', ""))
