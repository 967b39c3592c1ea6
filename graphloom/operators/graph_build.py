"""Graph documents into node, edge, mention and property tables.

Two identities are served: a node is (type, id), or id alone with the type last seen. Edges are
(rel, src, dst) with their endpoint types. Null and blank ids make no nodes; an edge needs both
endpoints where asked for. All merges are hash aggregations that combine map-side, so a hub costs
one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import hub_join


def given(column: Column) -> Column:
    """True where a text is neither null nor blank (spaces)."""
    return column.isNotNull() & (F.trim(column) != "")


def nodes(raw: DataFrame) -> DataFrame:
    """(type, id): distinct nodes by type and id."""
    return raw.where(given(F.col("id"))).select("type", "id").distinct()


def nodes_last_wins(raw: DataFrame, order: list[str]) -> DataFrame:
    """(id, type, first_at): one node per id; the type is the last by ``order``, the position the first."""
    rank = F.struct(*order)
    return raw.where(given(F.col("id"))).groupBy("id").agg(F.max_by("type", rank).alias("type"), F.min(order[0]).alias("first_at"))


def edge_rows(raw: DataFrame) -> DataFrame:
    """(src_type, src, rel, dst_type, dst) of every relationship with given endpoints, as often as it occurs: for readers that merge edges themselves."""
    return raw.where(given(F.col("source.id")) & given(F.col("target.id"))).select(
        F.col("source.type").alias("src_type"), F.col("source.id").alias("src"), F.col("type").alias("rel"), F.col("target.type").alias("dst_type"), F.col("target.id").alias("dst")
    )


def edges(raw: DataFrame) -> DataFrame:
    """(src_type, src, rel, dst_type, dst): distinct edges with given endpoints."""
    return edge_rows(raw).distinct()


def edges_with_endpoints(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges both of whose endpoints are nodes by id."""
    ids = node_table.select("id").distinct()
    columns = edge_table.columns
    from_nodes = hub_join(edge_table, ids.withColumnRenamed("id", "src"), "src", columns, "left_semi")
    return hub_join(from_nodes, ids.withColumnRenamed("id", "dst"), "dst", columns, "left_semi").select(*columns)


def mentions(sources: DataFrame, raw_nodes: DataFrame) -> DataFrame:
    """(doc, source_type, type, id): which provenance pointer mentions which node.

    The pointer side carries defaults: source id ``unknown``, source type ``chunk``.
    """
    docs = sources.select("graph_doc_id", F.coalesce("source_id", F.lit("unknown")).alias("doc"), F.coalesce("source_type", F.lit("chunk")).alias("source_type"))
    return raw_nodes.where(given(F.col("id"))).select("graph_doc_id", "type", "id").join(docs, "graph_doc_id").select("doc", "source_type", "type", "id").distinct()


def explode_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relationships, sources) of a table of nested graph documents, each keyed by ``graph_doc_id``."""
    keyed = documents if "graph_doc_id" in documents.columns else documents.withColumn("graph_doc_id", F.xxhash64(F.to_json(F.struct("nodes", "relationships", "source"))))
    n = keyed.select("graph_doc_id", F.posexplode("nodes").alias("pos", "n")).select("graph_doc_id", "pos", "n.id", "n.type", "n.metadata")
    r = keyed.select("graph_doc_id", F.posexplode("relationships").alias("pos", "r")).select("graph_doc_id", "pos", "r.source", "r.target", "r.type")
    s = keyed.select("graph_doc_id", F.coalesce("source.source_id", F.lit("unknown")).alias("source_id"), F.coalesce("source.source_type", F.lit("chunk")).alias("source_type"), F.col("source.metadata").alias("metadata"))
    return n, r, s


def property_lists(items: DataFrame, owner: list[str], key: str, value: str, order: list[str]) -> DataFrame:
    """(owner..., key, values): the values of each property in first-seen order; one value stays a list of one."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return items.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(*owner, key).agg(F.transform(rows, lambda x: x["_v"]).alias("values"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keyed merge: new values replace existing ones; of several new ones the greatest wins."""
    both = existing.select(*keys, value).withColumn("_gen", F.lit(0)).unionByName(new.select(*keys, value).withColumn("_gen", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(value, F.struct("_gen", value)).alias(value))


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where the uniqueness constraint holds."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def registry(*id_tables: DataFrame) -> DataFrame:
    """The sorted registry of distinct ids."""
    out = id_tables[0].select("id")
    for t in id_tables[1:]:
        out = out.unionByName(t.select("id"))
    return out.where(given(F.col("id"))).distinct()


def new_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Ids that the registry does not hold yet."""
    return registry(ids).join(known.select("id").distinct(), "id", "left_anti")
