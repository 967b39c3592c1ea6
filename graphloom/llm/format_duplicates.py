"""Records that differ only in whitespace, letter case, punctuation or field order.

Progressive partition refinement, every step on the members of the step before that share a class:

1. length: the number of characters that formatting does not touch. Lengths fall into ``LENGTHS``
   buckets, so the classes with several members are one bitmap of fixed size;
2. length and letter histogram, only for records whose length class has several members. The classes
   with several members become a Bloom filter of ``FILTER_BITS`` bits: its size is a parameter, and
   what it lets through by chance only reaches the next step, it never changes the result;
3. the hash of the canonical form, only for records that pass the filter. It alone decides.

Each step reads the lines again through the filter of the step before: texts are never shuffled,
only ids and hashes are. Group counts combine map-side, and the join that brings each member its
group's first id salts hot groups. Nothing is compared in pairs.

What formatting is: white space (with zero-width space and byte order mark), everything Unicode calls
punctuation, and letter case (full case folding, after the punctuation is gone). Symbols (+ $ < = ^),
combining marks and emoji are content. Numbers are compared as written. The order of fields does not
matter, that of array elements does; absent, null and empty are different.

Defined results: lines that are null, blank, broken or hold no JSON object are no records; a record
encoded twice is unwrapped once; of a field that one object repeats the last counts; nesting of any
depth is read; of repeated ids the rows count as the same record; groups of one are records with one
copy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.bitmaps import bitmap, has
from graphloom.operators.jsonvalue import Number, canonical_text, parse_line, places
from graphloom.operators.skew import hot_keys, salted_join
from graphloom.storage import materialize
from graphloom.tables import wide_enough

#: Buckets of lengths; one bit each is broadcast.
LENGTHS = 1 << 20
#: Bits of the Bloom filter over histogram classes; 1/8 byte each is broadcast.
FILTER_BITS = 1 << 25

_noise = regex.compile(r"[\p{P}\p{Z}\s​﻿]+")
_ascii_noise = dict.fromkeys(i for i in range(128) if _noise.fullmatch(chr(i)))
_escape = re.compile(r"\\(?:u[0-9a-fA-F]{4}|.)")


def bare(text: str) -> str:
    """A text without what formatting can change."""
    return text.translate(_ascii_noise).lower() if text.isascii() else _noise.sub("", text).casefold()


def canonical(value) -> str:
    """A hash of a value that formatting and field order do not change; bottom-up, without recursion."""
    every = places(value) if isinstance(value, (dict, list)) else []
    if not every:
        return _leaf(value)
    digests = [""] * len(every)
    below: list[dict[int, str]] = [{} for _ in every]
    for at in range(len(every) - 1, -1, -1):
        above, _, ordinal, held = every[at]
        mine = below[at]
        if isinstance(held, dict):
            parts = sorted(f"{_word(k)}\x00{mine[i] if i in mine else _leaf(v)}" for i, (k, v) in enumerate(held.items()))
            content = "o\x01" + "\x01".join(parts)
        else:
            content = "a\x01" + "\x01".join([mine[i] if i in mine else _leaf(v) for i, v in enumerate(held)])
        digests[at] = "h" + blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        if above >= 0:
            below[above][ordinal] = digests[at]
    return digests[0]


def _word(text: str) -> str:
    """The bare text; control characters, which the separators are, come out escaped."""
    return _short_word(text) if len(text) <= 64 else _long_word(text)


def _long_word(text: str) -> str:
    text = bare(text)
    return text if text.isprintable() else repr(text)


_short_word = lru_cache(1 << 16)(_long_word)


def _leaf(value) -> str:
    if type(value) is str:
        return "s" + _word(value)
    if isinstance(value, Number):
        return "n" + value.lower()
    return "v" + str(value)


def _content(value) -> str:
    """All characters of a record that formatting does not touch; a little coarser than :func:`canonical`."""
    try:
        text = _plain(value)
    except RecursionError:
        text = canonical_text(value)
    return bare(_escape.sub("", text))


class _Encoder:
    """JSON text of a parsed value by the C encoder; numbers come out as strings, which the histogram does not mind."""

    def __init__(self) -> None:
        import json

        self.encode = json.JSONEncoder(ensure_ascii=False, check_circular=False).encode


_plain = _Encoder().encode


def _histogram(content: str) -> int:
    """Class of length and letter histogram, as a number of 63 bits."""
    counts = "\0".join([f"{c}{content.count(c)}" for c in sorted(set(content))]) if len(content) < 1 << 16 else "\0".join(f"{c}{n}" for c, n in sorted(Counter(content).items()))
    return int.from_bytes(blake2b(counts.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    for line_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        try:
            value = parse_line(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            yield line_id, value


def _filter_bits(key: int) -> tuple[int, int]:
    return key % FILTER_BITS, (key >> 25) % FILTER_BITS


def _step(rows: DataFrame, keys: Callable[[int, dict], list], schema: str) -> DataFrame:
    """One reading of the lines: what ``keys`` gives of each record."""
    fields = [f.split() for f in schema.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for line_id, value in _records(batch) for row in keys(line_id, value)]
            columns = list(zip(*found)) if found else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema)


def refine(lines: DataFrame, id_column: str = "line_id", text_column: str = "line") -> DataFrame:
    """(line_id, canon): the canonical hash of every record that shares its length and histogram class with another."""
    spark = lines.sparkSession
    raw = wide_enough(lines.select(F.col(id_column).cast("bigint").alias("line_id"), F.col(text_column).alias("line")).where(F.col("line").isNotNull()))

    lengths = _step(raw, lambda _, value: [(len(_content(value)) % LENGTHS,)], "at int")
    several = spark.sparkContext.broadcast(bitmap(lengths.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("at").cast("bigint")), LENGTHS))

    def classes(_: int, value: dict) -> list:
        content = _content(value)
        return [(_histogram(content),)] if has(several.value, len(content) % LENGTHS) else []

    shared = _step(raw, classes, "class bigint").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = shared.select(F.explode(F.array(F.col("class") % FILTER_BITS, F.shiftrightunsigned("class", 25) % FILTER_BITS)).alias("at"))
    passing = spark.sparkContext.broadcast(bitmap(bits, FILTER_BITS))

    def keys(line_id: int, value: dict) -> list:
        content = _content(value)
        if not has(several.value, len(content) % LENGTHS) or not all(has(passing.value, b) for b in _filter_bits(_histogram(content))):
            return []
        return [(line_id, canonical(value))]

    return _step(raw, keys, "line_id bigint, canon string")


def copies(lines: DataFrame, id_column: str = "line_id", text_column: str = "line") -> DataFrame:
    """(first_line_id, line_id, copies): every member of a group of several copies but the first, with the group's first id."""
    hashed = materialize(refine(lines, id_column, text_column), "canonical")
    groups = materialize(hashed.groupBy("canon").agg(F.count(F.lit(1)).alias("count"), F.min("line_id").alias("first_line_id")).where("count > 1"), "groups")
    joined = salted_join(hashed, groups, "canon", hot_keys(groups, "canon"), F.col("line_id"))
    return joined.where("line_id <> first_line_id").select("first_line_id", "line_id", F.col("count").alias("copies"))


def collapse(lines: DataFrame, id_column: str = "line_id", text_column: str = "line") -> DataFrame:
    """(line_id, copies): one row per distinct record, the smallest id of its copies."""
    raw = lines.select(F.col(id_column).cast("bigint").alias("line_id"), F.col(text_column).alias("line"))
    found = materialize(copies(lines, id_column, text_column), "copies")
    firsts = found.groupBy(F.col("first_line_id").alias("line_id")).agg((F.count(F.lit(1)) + 1).alias("copies"))
    records = _step(wide_enough(raw), lambda line_id, _: [(line_id,)], "line_id bigint")
    rest = records.join(found.select("line_id"), "line_id", "left_anti")
    return rest.join(firsts, "line_id", "left").select("line_id", F.coalesce("copies", F.lit(1)).alias("copies"))
