"""Graph patterns as data: a chain of steps, made sound against the graph's types and compiled into joins.

A pattern comes from a model as a specification, never as query text. Each step names what its edge
and its nodes have to be; :func:`sound` drops relationship types the graph has not (none left: any
type), and :func:`compiled` turns the chain into one DataFrame of paths.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import hub_join


@dataclass(frozen=True)
class End:
    """What a node has to be: type, id exactly, or id containing or ending with a text, whatever the case."""

    type: str | None = None
    id: str | None = None
    contains: str | None = None
    ends_with: str | None = None

    def holds(self, type_: Column, id_: Column) -> Column:
        out = F.lit(True)
        if self.type is not None:
            out = out & (type_ == self.type)
        if self.id is not None:
            out = out & (id_ == self.id)
        if self.contains is not None:
            out = out & F.contains(F.lower(id_), F.lit(self.contains.lower()))
        if self.ends_with is not None:
            out = out & F.endswith(F.lower(id_), F.lit(self.ends_with.lower()))
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Step:
    """An edge of the pattern: its types (none: any), whether its direction counts, and the node it leads to."""

    to: End = End()
    rels: tuple[str, ...] = ()
    directed: bool = True


@dataclass(frozen=True)
class Pattern:
    start: End = End()
    steps: tuple[Step, ...] = ()
    limit: int | None = None
    dropped: tuple[str, ...] = field(default=())


def sound(pattern: Pattern, known: set[str]) -> Pattern:
    """The pattern with the relationship types the graph has, in their order; ``dropped`` lists the others."""
    dropped = tuple(r for s in pattern.steps for r in s.rels if r not in known)
    return replace(pattern, steps=tuple(replace(s, rels=tuple(r for r in s.rels if r in known)) for s in pattern.steps), dropped=dropped)


def _links(edge_table: DataFrame, step: Step) -> DataFrame:
    e = edge_table.select("src_type", "src", "rel", "dst_type", "dst")
    if step.rels:
        e = e.where(F.col("rel").isin(list(step.rels)))
    if not step.directed:
        back = e.where("src <> dst").select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), "rel", F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
        e = e.unionByName(back)
    return e.where(step.to.holds(F.col("dst_type"), F.col("dst")))


def compiled(pattern: Pattern, edge_table: DataFrame) -> DataFrame:
    """(n0, r1, n1, ...): every distinct path of the pattern; nodes are met by id. A limit takes the first paths in order."""
    if not pattern.steps:
        raise ValueError("a pattern has at least one step")
    first = _links(edge_table, pattern.steps[0]).where(pattern.start.holds(F.col("src_type"), F.col("src")))
    out = first.select(F.col("src").alias("n0"), F.col("rel").alias("r1"), F.col("dst").alias("n1")).distinct()
    for i, step in enumerate(pattern.steps[1:], 2):
        follow = _links(edge_table, step).select(F.col("src").alias(f"n{i - 1}"), F.col("rel").alias(f"r{i}"), F.col("dst").alias(f"n{i}")).distinct()
        out = hub_join(out, follow, f"n{i - 1}", ["n0", "r1"])
    names = ["n0", *[c for i in range(1, len(pattern.steps) + 1) for c in (f"r{i}", f"n{i}")]]
    out = out.select(*names)
    return out.orderBy(*[F.coalesce(c, F.lit("")) for c in names]).limit(pattern.limit) if pattern.limit else out


def retried(pattern: Pattern, edge_table: DataFrame, known: set[str]) -> DataFrame:
    """The paths of the pattern; where it has none and names unknown types, those of the pattern made sound, flagged ``retried``."""
    rows = compiled(pattern, edge_table).withColumn("retried", F.lit(False))
    safe = sound(pattern, known)
    if not safe.dropped or not rows.isEmpty():
        return rows
    return compiled(safe, edge_table).withColumn("retried", F.lit(True))
