"""Queries of the general data-pipeline operators: wide tables, nested records, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import nested, orphans, wide
from graphloom.tables import table


def _owners(spark: SparkSession, d: str, kind: str) -> DataFrame:
    name, column = {"node": ("graph_nodes", "node_row_id"), "source": ("graph_sources", "graph_doc_id")}[kind]
    return table(spark, d, name).select(F.lit(kind).alias("owner_kind"), F.col(column).alias("owner_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """State of every declared cell that has items."""
    items = table(spark, d, "metadata_items")
    found = wide.attributes(items, wide.declared_attributes(table(spark, d, "metadata_keys")))
    return wide.cell_states(wide.widen(items, found), found)


def p1_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The attribute list as discovered: keys as written, what they mean, what their values read as."""
    return wide.discover(table(spark, d, "metadata_items"), wide.declared_attributes(table(spark, d, "metadata_keys")))


def _wide(spark: SparkSession, d: str, kind: str) -> DataFrame:
    declared = wide.declared_attributes(table(spark, d, "metadata_keys"))
    return wide.wide_table(table(spark, d, "metadata_items"), declared, kind, _owners(spark, d, kind))


def p1_nodes_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per node."""
    return _wide(spark, d, "node")


def p1_sources_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per graph document source."""
    return _wide(spark, d, "source")


def _shredded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return nested.shred(table(spark, d, "graph_jsonl"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every metadata entry of every owner of every valid line, a repeated key once."""
    entries = nested.metadata_entries(*_shredded(spark, d))
    return entries.where("key_ordinal = 0").select("line_id", "doc_pos", "owner", "owner_pos", "meta_key")


def p2_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of metadata entries with values and parents."""
    return nested.metadata_entries(*_shredded(spark, d))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of nodes."""
    return nested.nodes(*_shredded(spark, d)).drop("hash")


def p2_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of relationships with their endpoints."""
    return nested.relationships(*_shredded(spark, d))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of documents."""
    return nested.documents(*_shredded(spark, d))


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    """The object store: each distinct object once with its use."""
    return nested.object_use(*_shredded(spark, d))


def p2_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every object and array of a line with its parent: nothing of a line is left out."""
    return nested.occurrences(*_shredded(spark, d))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rel = table(spark, d, "graph_relationships")
    ends = rel.select(
        F.col("extracted_at").alias("at"), F.lit("graph_relationships").alias("table_name"), F.col("rel_id").alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(f"{end}.id").alias("field"), F.col(f"{end}.id").alias("id")) for end in ("source", "target")])).alias("end"),
    )
    ends = ends.where(~orphans.blank(F.col("end.id")) & (F.col("end.id") != "unknown")).select(F.concat(F.lit("node:"), "end.id").alias("key"), "at", "table_name", "row_id", "end.field")
    sid = F.col("source_id")
    image = sid.endswith("::images")
    last = F.element_at(F.split(sid, "::"), -1)
    key = F.when(image, F.concat(F.lit("file:"), F.expr("left(source_id, length(source_id) - 8)"))).otherwise(F.concat(F.lit("chunk:"), last))
    real = ~orphans.blank(sid) & (sid != "unknown") & ~(~image & (orphans.blank(last) | (last == "unknown")))
    sources = table(spark, d, "graph_sources").where(real).select(
        key.alias("key"), F.col("extracted_at").alias("at"), F.lit("graph_sources").alias("table_name"), F.col("graph_doc_id").alias("row_id"), F.lit("source_id").alias("field")
    )
    nodes = table(spark, d, "graph_nodes").select(F.concat(F.lit("node:"), "id").alias("key"), F.col("first_seen_at").alias("start"), F.col("deleted_at").alias("end"))
    chunks = table(spark, d, "chunks").select("created_at", "deleted_at", F.explode(F.array(F.concat(F.lit("chunk:"), "id"), F.concat(F.lit("file:"), "metadata.source"))).alias("key"))
    return ends.unionByName(sources), nodes.unionByName(chunks.select("key", F.col("created_at").alias("start"), F.col("deleted_at").alias("end")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference without a valid target at its time."""
    return orphans.reference_states(*_references(spark, d)).select("table_name", "row_id", "field", "state")


def p6_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, month and state."""
    return (
        orphans.reference_states(*_references(spark, d))
        .groupBy("table_name", "field", F.date_format(F.col("at"), "yyyy-MM").alias("month"), "state")
        .agg(F.count(F.lit(1)).alias("orphans"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_attributes, p1_nodes_wide, p1_sources_wide, p2_found, p2_metadata, p2_nodes, p2_relationships, p2_documents, p2_objects, p2_occurrences, p6_found, p6_orphans_by_month)}

_ITEMS = r"""with k as (select owner_kind, meta_key, value_type, lower(regexp_replace(meta_key, '[^\p{L}\p{N}]', '', 'g')) as n from metadata_keys),
raw as (select owner_kind, owner_id, item_id, recorded_at, meta_value, lower(regexp_replace(meta_key, '[^\p{L}\p{N}]', '', 'g')) as n from metadata_items where meta_key is not null and owner_id is not null),
m as (select raw.*, k.meta_key as attribute, k.value_type, case when raw.n = k.n then 0 else 1 end as d from raw join k on raw.owner_kind = k.owner_kind
  and (raw.n = k.n or (length(raw.n) >= 3 and length(k.n) >= 4 and damerau_levenshtein(raw.n, k.n) = 1))),
b as (select *, count(*) over (partition by item_id, d) as same, min(d) over (partition by item_id) as best from m),
i as (select * exclude (meta_value), regexp_replace(meta_value, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as v, meta_value from b where d = best and (d = 0 or same = 1)),
r as (select owner_kind, owner_id, attribute, case value_type
  when 'string' then length(v) > 0
  when 'boolean' then lower(v) in ('true', 't', 'yes', 'y', '1', 'on', 'false', 'f', 'no', 'n', '0', 'off')
  when 'int' then try_cast(case when regexp_matches(v, '^[+-]?\d{1,3}([, _'']\d{3})+(\.0*)?$') then regexp_replace(v, '[, _'']', '', 'g')
     when regexp_matches(v, '^[+-]?\d+\.?$|^[+-]?\d+\.\d+$|^[+-]?\d+(\.\d+)?[eE][+-]?\d{1,2}$') then v end as double) % 1 = 0
  when 'double' then regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*%?$|^[+-]?\d+,\d+\s*%?$|^[+-]?\d{1,3}(,\d{3})+\.\d+\s*%?$|^[+-]?\d{1,3}(\.\d{3})+,\d+\s*%?$')
  when 'date' then coalesce(case when regexp_matches(v, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$') then try_strptime(v[1:10], '%Y-%m-%d') end,
     case when regexp_matches(v, '^\d{8}$') then try_strptime(v, '%Y%m%d') end,
     try_strptime(v, ['%Y-%m-%d', '%Y/%m/%d', '%Y.%m.%d', '%d.%m.%Y', '%d %b %Y', '%d %B %Y', '%b %d, %Y', '%B %d, %Y'])) is not null
  end as ok from i)
"""

_REFS = r"""with ends as (select 'graph_relationships' as table_name, rel_id as row_id, 'source.id' as field, 'node:' || source.id as key, source.id as raw, extracted_at as t from graph_relationships
  union all select 'graph_relationships', rel_id, 'target.id', 'node:' || target.id, target.id, extracted_at from graph_relationships
  union all select 'graph_sources', graph_doc_id, 'source_id', case when source_id like '%::images' then 'file:' || left(source_id, length(source_id) - 8) else 'chunk:' || string_split(source_id, '::')[-1] end,
    case when source_id = 'unknown' or source_id like '%::images' then source_id else string_split(source_id, '::')[-1] end, extracted_at from graph_sources),
refs as (select * from ends where raw is not null and length(regexp_replace(raw, '[\s\p{Z}]+', '', 'g')) > 0 and raw <> 'unknown'),
targets as (select 'node:' || id as key, first_seen_at as a, deleted_at as z from graph_nodes where id is not null
  union all select 'chunk:' || id, created_at, deleted_at from chunks where id is not null union all select 'file:' || metadata.source, created_at, deleted_at from chunks where metadata.source is not null),
j as (select table_name, row_id, field, r.t, count(g.key) as rows, coalesce(bool_or(a <= r.t and (z is null or z > r.t)), false) as valid, coalesce(bool_or(a > r.t and (z is null or z > a)), false) as later
  from refs r left join targets g on r.key = g.key group by all),
s as (select table_name, row_id, field, t, case when rows = 0 then 'missing' when later then 'late' else 'deleted' end as state from j where not valid)
"""

_DOCS = r"""with raw as (select line_id, ltrim(line, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) as line from graph_jsonl),
one as (select line_id, case when json_valid(line) then line::json end as v from raw),
two as (select line_id, case when json_type(v) = 'VARCHAR' then case when json_valid(ltrim(v->>'$', chr(65279) || ' ' || chr(9) || chr(10) || chr(13))) then (v->>'$')::json end else v end as v from one where v is not null),
many as (select line_id, case when json_type(v) = 'OBJECT' and json_type(v->'documents') = 'ARRAY' and not json_exists(v, '$.nodes') then v->'documents' when json_type(v) = 'ARRAY' then v else json_array(v) end as docs from two where v is not null),
each as (select line_id, unnest(range(json_array_length(docs)::bigint))::int as doc_pos, docs from many),
doc as (select line_id, doc_pos, docs->doc_pos as d from each where json_type(docs->doc_pos) = 'OBJECT'),
body as (select line_id, doc_pos, case when json_type(d->'graph') = 'OBJECT' then d->'graph' else d end as b from doc)
"""

ORACLES = {
    "p2_nodes": _DOCS
    + r""", held as (select line_id, doc_pos, case json_type(b->'nodes') when 'ARRAY' then b->'nodes' when 'OBJECT' then json_array(b->'nodes') end as ns from body),
node as (select line_id, doc_pos, unnest(range(json_array_length(ns)::bigint))::int as node_pos, ns from held where ns is not null),
n as (select line_id, doc_pos, node_pos, ns->node_pos as n from node where json_type(ns->node_pos) = 'OBJECT'),
m as (select *, n->'metadata' as m from n)
select line_id, doc_pos, node_pos, n->>'id' as node_id, n->>'type' as node_type,
  (case json_type(m) when 'ARRAY' then len(list_filter(m::json[], lambda x: json_type(x) = 'OBJECT' and coalesce(json_type(x->'key'), 'NULL') <> 'NULL'))
   when 'OBJECT' then case when json_type(m->'key') = 'VARCHAR' and len(list_filter(json_keys(m), lambda k: k not in ('key', 'value'))) = 0 then 1 else len(json_keys(m)) end else 0 end)::int as entries from m""",
    "p2_relationships": _DOCS
    + r""", held as (select line_id, doc_pos, case json_type(b->'relationships') when 'ARRAY' then b->'relationships' when 'OBJECT' then json_array(b->'relationships') end as rs from body),
rel as (select line_id, doc_pos, unnest(range(json_array_length(rs)::bigint))::int as rel_pos, rs from held where rs is not null),
r as (select line_id, doc_pos, rel_pos, rs->rel_pos as r from rel where json_type(rs->rel_pos) = 'OBJECT')
select line_id, doc_pos, rel_pos, r->>'type' as rel_type,
  case json_type(r->'source') when 'OBJECT' then r->'source'->>'id' when 'VARCHAR' then r->>'source' end as source_id, case json_type(r->'source') when 'OBJECT' then r->'source'->>'type' end as source_type,
  case json_type(r->'target') when 'OBJECT' then r->'target'->>'id' when 'VARCHAR' then r->>'target' end as target_id, case json_type(r->'target') when 'OBJECT' then r->'target'->>'type' end as target_type from r""",
    "p1_found": _ITEMS + "select owner_kind, owner_id, attribute as meta_key, case when bool_or(ok) then 'filled' else 'unreadable' end as state from r group by 1, 2, 3",
    "p6_found": _REFS + "select table_name, row_id, field, state from s",
    "p6_orphans_by_month": _REFS + "select table_name, field, strftime(t, '%Y-%m') as month, state, count(*) as orphans from s group by all",
}
