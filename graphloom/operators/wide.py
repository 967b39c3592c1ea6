"""Attribute-value rows into wide, typed tables.

The attribute list is discovered first, in one aggregate over all items: which declared attributes
occur, how often, and which kinds their values read as. It drives the pivot; the declared attributes
(a small fixed table) name the columns, and their types where they state one. Each item row is
resolved to a declared attribute by a codegen expression, never by a join, so no key can be hot;
then duplicates of a cell are resolved and one conditional aggregate per attribute makes the wide row.
All aggregates combine map-side, so an owner that holds any share of the rows costs one partial
row per attribute and task.

Defined results: a null or undeclared key makes no column and shows in :func:`discover`; a null
owner makes no row; among several readable values of one cell the latest ``recorded_at`` wins,
ties by the largest item id (null times lose to any time); exact repeats change nothing but the
item count; a cell whose items are all unreadable is null with ``<column>__items`` > 0; empty
input gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SQL_TYPE = {"string": "string", "int": "bigint", "double": "double", "boolean": "boolean", "date": "date"}

# Spellings of truth values, lower case.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off"]

# Date notations that state one calendar day (pattern of the text, format to read it).
DATE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
]


def normal_key(key: Column) -> Column:
    """Letters and digits of a key in lower case."""
    return F.lower(F.regexp_replace(key, r"[^\p{L}\p{N}]", ""))


def _plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def resolve_key(key: Column, declared: Sequence[str]) -> Column:
    """The declared key that a written key means, or null.

    Equal after removing case and punctuation, else the only declared key within one edit
    (insertion, deletion, substitution, swap of neighbours). Keys of under four letters have to
    be equal.
    """
    norm = normal_key(key)
    plain = {name: _plain(name) for name in declared}
    exact = reduce(lambda acc, kv: acc.when(norm == kv[1], kv[0]), plain.items(), F.when(F.lit(False), F.lit(None).cast("string")))

    def close(word: str) -> Column:
        swaps = sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)})
        return (F.levenshtein(norm, F.lit(word), 1) >= 0) | norm.isin(swaps)

    hits = F.array_compact(F.array(*[F.when(close(w), F.lit(n)) for n, w in plain.items() if len(w) >= 4] or [F.lit(None).cast("string")]))
    return F.coalesce(exact, F.when((F.length(norm) >= 3) & (F.size(hits) == 1), F.element_at(hits, 1)))


def typed_value(value: Column, kind: str) -> Column:
    """The one value of the declared kind that a text states, else null."""
    text = F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    if kind == "string":
        return F.when(F.length(text) > 0, value)
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin(TRUE_WORDS), F.lit(True)).when(low.isin(FALSE_WORDS), F.lit(False))
    if kind == "int":
        plain = F.when(text.rlike(r"^[+-]?\d{1,3}([, _']\d{3})+(\.0*)?$"), F.regexp_replace(text, "[, _']", "")).when(
            text.rlike(r"^[+-]?\d+\.?$|^[+-]?\d+\.\d+$|^[+-]?\d+(\.\d+)?[eE][+-]?\d{1,2}$"), text
        )
        number = F.regexp_replace(plain, r"\.$", "").try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if kind == "double":
        percent = text.endswith("%")
        body = F.rtrim(F.regexp_replace(text, "%$", ""))
        plain = (
            F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), body)
            .when(body.rlike(r"^[+-]?\d+,\d+$"), F.regexp_replace(body, ",", "."))
            .when(body.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d+$"), F.regexp_replace(body, ",", ""))
            .when(body.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d+$"), F.regexp_replace(F.regexp_replace(body, r"\.", ""), ",", "."))
        )
        number = plain.try_cast("double")
        return F.when(percent, number / 100).otherwise(number)
    if kind == "date":
        day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
        for pattern, form in DATE_FORMS:
            day = day.when(text.rlike(pattern), F.try_to_timestamp(F.initcap(text), F.lit(form)))
        return day.cast("date")
    raise ValueError(f"unknown kind {kind}")


def declared_attributes(keys: DataFrame) -> dict[str, dict[str, str]]:
    """Owner kind -> attribute -> kind, from the declaration table (fixed, one row per column).

    A null or an unknown kind declares the attribute with the kind ``""``: its values decide.
    """
    out: dict[str, dict[str, str]] = {}
    rows = keys.select("owner_kind", "meta_key", F.when(F.col("value_type").isin(list(SQL_TYPE)), F.col("value_type")).otherwise("").alias("value_type")).where("owner_kind is not null and meta_key is not null").distinct()
    for row in sorted(rows.collect()):
        out.setdefault(row.owner_kind, {})[row.meta_key] = row.value_type
    return out


def _resolved(items: DataFrame, declared: dict[str, dict[str, str]]) -> Column:
    col = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, attributes in declared.items():
        col = col.when(F.col("owner_kind") == kind, resolve_key(F.col("meta_key"), list(attributes)))
    return col


#: Share of the values of an attribute that have to read as a kind for the kind to be inferred.
READS = 0.9
#: Kinds from the narrowest to the widest.
NARROWEST = ["boolean", "int", "double", "date", "string"]


def _inferred() -> Column:
    """The narrowest kind that (nearly) all values read as."""
    return F.coalesce(*[F.when((F.col("reads_string") > 0) & (F.col(f"reads_{kind}") >= READS * F.col("reads_string")), F.lit(kind)) for kind in NARROWEST])


def discover(items: DataFrame, declared: dict[str, dict[str, str]]) -> DataFrame:
    """Every key as written: the attribute it means (null if undeclared), items, for how many each kind reads, and the kind they suggest."""
    reads = [F.count(typed_value(F.col("meta_value"), kind)).alias(f"reads_{kind}") for kind in SQL_TYPE]
    counted = items.groupBy("owner_kind", "meta_key").agg(F.count(F.lit(1)).alias("items"), *reads)
    return counted.withColumn("attribute", _resolved(counted, declared)).withColumn("inferred_type", _inferred())


def attributes(items: DataFrame, declared: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """The attribute list that drives the pivot: owner kind -> attribute that the items have -> its kind.

    Discovered by one aggregate over all items. The declared kind counts where there is one; an attribute declared
    without a kind (null or unknown) gets the kind that its values suggest. At most one row per declared attribute
    comes to the driver.
    """
    found = discover(items, declared).where("attribute is not null").groupBy("owner_kind", "attribute")
    found = found.agg(F.sum("items").alias("items"), *[F.sum(f"reads_{kind}").alias(f"reads_{kind}") for kind in SQL_TYPE])
    out: dict[str, dict[str, str]] = {}
    for r in sorted(found.select("owner_kind", "attribute", F.coalesce(_inferred(), F.lit("string")).alias("kind")).collect()):
        kind = declared[r.owner_kind][r.attribute]
        out.setdefault(r.owner_kind, {})[r.attribute] = kind if kind in SQL_TYPE else r.kind
    return out


def widen(items: DataFrame, declared: dict[str, dict[str, str]], owners: DataFrame | None = None) -> DataFrame:
    """One row per (owner_kind, owner_id) with a typed column and an item count per declared attribute.

    Columns are ``<owner kind>.<attribute>`` and the same with ``__items``. ``owners``
    (owner_kind, owner_id) adds owners without items and flags them ``listed``.
    """
    rows = items.select("owner_kind", "owner_id", "meta_key", "meta_value", "recorded_at", "item_id", F.lit(False).alias("listed"))
    if owners is not None:
        rows = rows.unionByName(owners.select("owner_kind", "owner_id", F.lit(True).alias("listed")), allowMissingColumns=True)
    kinds = sorted({k for a in declared.values() for k in a.values()})
    if not kinds:
        return rows.where(F.col("owner_id").isNotNull()).groupBy("owner_kind", "owner_id").agg(F.max("listed").alias("listed"))
    rows = rows.where(F.col("owner_id").isNotNull()).withColumn("attribute", _resolved(rows, declared))
    needs = {kind: sorted({a for attrs in declared.values() for a, k in attrs.items() if k == kind}) for kind in kinds}
    typed = F.struct(*[F.when(F.col("attribute").isin(needs[kind]), typed_value(F.col("meta_value"), kind)).alias(kind) for kind in kinds])
    rows = rows.select(
        "owner_kind", "owner_id", "attribute", "listed",
        F.struct(F.coalesce(F.col("recorded_at"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), F.col("item_id").alias("item")).alias("rank"),
        typed.alias("typed"),
    )
    # duplicates first: one row per cell, the latest item that states a value
    states = F.col(f"typed.{kinds[0]}").isNotNull()
    for kind in kinds[1:]:
        states = states | F.col(f"typed.{kind}").isNotNull()
    cells = rows.groupBy("owner_kind", "owner_id", "attribute").agg(
        F.max_by("typed", F.when(states, F.col("rank"))).alias("typed"), F.count("attribute").alias("items"), F.max("listed").alias("listed")
    )
    aggregates = [F.max("listed").alias("listed")]
    for owner_kind, attributes in declared.items():
        for name, kind in attributes.items():
            here = (F.col("owner_kind") == owner_kind) & (F.col("attribute") == name)
            aggregates.append(F.max(F.when(here, F.col(f"typed.{kind}"))).alias(f"{owner_kind}.{name}"))
            aggregates.append(F.coalesce(F.max(F.when(here, F.col("items"))), F.lit(0)).alias(f"{owner_kind}.{name}__items"))
    return cells.groupBy("owner_kind", "owner_id").agg(*aggregates)


def wide_table(items: DataFrame, declared: dict[str, dict[str, str]], owner_kind: str, owners: DataFrame | None = None) -> DataFrame:
    """The wide table of one owner kind with plain column names: every declared attribute, null where no item has it."""
    here = items.where(F.col("owner_kind") == owner_kind)
    names = declared.get(owner_kind, {})
    found = attributes(here, {owner_kind: names}).get(owner_kind, {})
    wide = widen(here, {owner_kind: found}, owners)
    values = [F.col(f"`{owner_kind}.{a}`").alias(a) if a in found else F.lit(None).cast(SQL_TYPE.get(kind, "string")).alias(a) for a, kind in names.items()]
    counts = [F.col(f"`{owner_kind}.{a}__items`").alias(f"{a}__items") if a in found else F.lit(0).cast("bigint").alias(f"{a}__items") for a in names]
    return wide.select("owner_id", "listed", *values, *counts)


def cell_states(wide: DataFrame, declared: dict[str, dict[str, str]]) -> DataFrame:
    """One row per owner and attribute with items: ``filled`` or ``unreadable``."""
    cells = []
    for owner_kind, attributes in declared.items():
        for name in attributes:
            held = F.col(f"`{owner_kind}.{name}__items`") > 0
            state = F.when(F.col(f"`{owner_kind}.{name}`").isNotNull(), "filled").otherwise("unreadable")
            cells.append(F.when(held, F.struct(F.lit(name).alias("meta_key"), state.alias("state"))))
    if not cells:
        cells = [F.lit(None).cast("struct<meta_key:string,state:string>")]
    return wide.select("owner_kind", "owner_id", F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("owner_kind", "owner_id", "cell.meta_key", "cell.state")
