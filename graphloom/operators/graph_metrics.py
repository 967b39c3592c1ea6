"""Structural quality of a property graph: counts, degrees, orphans, types, provenance.

Empty graphs give zeros (ratios), and null where an average has nothing to average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# Metrics that a report remarks on, from where, and the remark.
REMARKS = [("orphan_ratio", 0.1, "many orphan nodes"), ("component_ratio", 0.5, "fragmented graph"), ("type_violation_rate", 0.05, "missing ids or endpoints")]


def undirected(edge_table: DataFrame) -> DataFrame:
    """(a, rel, b): both orientations of every edge; a self-loop once."""
    there = edge_table.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b"))
    return there.unionByName(edge_table.where("src <> dst").select(F.col("dst").alias("a"), "rel", F.col("src").alias("b")))


def degrees(edge_table: DataFrame) -> DataFrame:
    """(id, degree) of every node with an edge; a self-loop counts once."""
    return undirected(edge_table).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def orphans(node_ids: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Ids of nodes without any edge."""
    touched = edge_table.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return node_ids.select("id").distinct().join(touched, "id", "left_anti")


def type_counts(table: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(column, n) by frequency, ties by name; the top ``n`` if asked."""
    counted = table.groupBy(F.coalesce(column, F.lit("Unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), column).limit(n) if n else counted


def reciprocal(edge_table: DataFrame) -> DataFrame:
    """Distinct edges whose reverse of the same type exists; a self-loop is its own reverse."""
    e = edge_table.select("src", "rel", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    return e.join(back, ["src", "rel", "dst"], "left_semi")


def report(node_table: DataFrame, edge_table: DataFrame, mention_table: DataFrame, raw_nodes: DataFrame, raw_edges: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row with every structural metric, or with those of ``only``, whose plan then reads no more than they need.

    node_table: distinct (type, id); edge_table: distinct edges; the raw tables are the rows as
    they came, for the violations (blank ids, blank endpoints).
    """
    ids = node_table.select("id").distinct()
    blank = lambda c: c.isNull() | (c == "")
    parts = {  # one row each
        "n": lambda: ids.agg(F.count(F.lit(1)).alias("_nodes")),
        "e": lambda: edge_table.agg(F.count(F.lit(1)).alias("_rels"), F.countDistinct("rel").alias("_rel_types")),
        "o": lambda: orphans(ids, edge_table).agg(F.count(F.lit(1)).alias("_orphans")),
        "d": lambda: degrees(edge_table).join(ids, "id", "left_semi").agg(F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree")),
        "t": lambda: node_table.agg(F.countDistinct("type").alias("_types"), F.count_if(F.col("type") == "Document").alias("_documents")),
        "b": lambda: reciprocal(edge_table).agg(F.count(F.lit(1)).alias("_bidirectional")),
        "vn": lambda: raw_nodes.agg(F.count_if(blank(F.col("id"))).alias("_blank_nodes")),
        "ve": lambda: raw_edges.agg(F.count_if(blank(F.col("source.id")) | blank(F.col("target.id"))).alias("_blank_edges"), F.count(F.lit(1)).alias("_raw_rels")),
        "m": lambda: mention_table.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).agg(F.round(F.avg("k"), 6).alias("_per_document")),
    }
    nodes, rels, orph = F.col("_nodes"), F.col("_rels"), F.col("_orphans")
    ratio = lambda a, z: F.when(z > 0, a / z).otherwise(0.0)
    connected = nodes - orph
    components = F.when(connected == nodes, F.lit(1)).otherwise(F.greatest(F.lit(1), orph) + (connected > 0).cast("int"))
    columns = {
        "nodes": ("n", nodes), "rels": ("e", rels), "orphans": ("o", orph),
        "orphan_ratio": ("n o", F.round(ratio(orph, nodes), 6)),
        "component_ratio": ("n o", F.round(ratio(components, nodes), 6)),
        "type_violation_rate": ("vn ve", F.round((F.col("_blank_nodes") + F.col("_blank_edges")) / F.greatest(F.col("_raw_rels"), F.lit(1)), 6)),
        "avg_degree": ("d", F.col("avg_degree")), "max_degree": ("d", F.col("max_degree")), "min_degree": ("d", F.col("min_degree")),
        "relationship_density": ("n e", F.round(F.when(nodes > 1, rels / (nodes.cast("double") * (nodes - 1))).otherwise(0.0), 12)),
        "unique_entity_types": ("t", F.col("_types").cast("double")), "unique_relationship_types": ("e", F.col("_rel_types").cast("double")),
        "avg_relationships_per_node": ("n e", F.round(ratio(rels, nodes), 6)),
        "connectivity_ratio": ("n o", F.round(ratio(connected, nodes), 6)),
        "document_node_count": ("t", F.col("_documents")),
        "avg_entities_per_document": ("m", F.col("_per_document")),
        "bidirectional_relationship_ratio": ("e b", F.round(ratio(F.col("_bidirectional"), rels), 6)),
    }
    wanted = {c: columns[c] for c in only or columns}
    needed = [p for p in parts if any(p in need.split() for need, _ in wanted.values())]
    row = parts[needed[0]]()
    for p in needed[1:]:
        row = row.join(F.broadcast(parts[p]()))
    return row.select(*[value.alias(c) for c, (_, value) in wanted.items()])


def notes(report_row: DataFrame) -> DataFrame:
    """The remarks that a report's thresholds call for, one row each."""
    remarks = F.array_compact(F.array(*[F.when(F.col(c) > limit, F.lit(text)) for c, limit, text in REMARKS]))
    return report_row.select(F.explode(remarks).alias("note"))
