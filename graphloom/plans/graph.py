"""Graph queries over the domain tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import cascades, graph_build as build, graph_match as match, graph_metrics as metrics
from graphloom.tables import table


class Graph:
    """The graph tables of a folder."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.raw_nodes, self.raw_edges, self.sources = (table(spark, d, n) for n in ("graph_nodes", "graph_relationships", "graph_sources"))
        self.nodes, self.edges = build.nodes(self.raw_nodes), build.edges(self.raw_edges)
        self.mentions = build.mentions(self.sources, self.raw_nodes)
        self.items = table(spark, d, "metadata_items")
        self.chunks = table(spark, d, "chunks")


#: The same tables in SQL.
CTE = """with nodes as (select distinct type, id from graph_nodes where id is not null and trim(id) <> ''),
edges as (select distinct source.type as src_type, source.id as src, type as rel, target.type as dst_type, target.id as dst from graph_relationships
  where source.id is not null and trim(source.id) <> '' and target.id is not null and trim(target.id) <> ''),
docs as (select graph_doc_id, coalesce(source_id, 'unknown') as doc, coalesce(source_type, 'chunk') as source_type from graph_sources),
mentions as (select distinct doc, source_type, n.type as type, n.id as id from graph_nodes n join docs using (graph_doc_id) where n.id is not null and trim(n.id) <> ''),
undirected as (select src as a, rel, dst as b from edges union all select dst, rel, src from edges where src <> dst),
ids as (select distinct id from nodes),
pair as (select least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst group by 1, 2 order by count(*) desc, 1, 2 limit 1),
deg as (select a as id, count(*) as degree from undirected group by 1)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL after the shared tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Graph(spark, d))
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return register


@query("select count(*) as nodes from nodes")
def graph_node_counts(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes"))


@query("select count(*) as rels from edges")
def graph_rel_counts(g: Graph) -> DataFrame:
    return g.edges.agg(F.count(F.lit(1)).alias("rels"))


@query("select id from ids where id not in (select src from edges) and id not in (select dst from edges)")
def orphan_nodes(g: Graph) -> DataFrame:
    return metrics.orphans(g.nodes, g.edges)


@query(
    """, rn as (select count(*) as nodes from ids), re as (select count(*) as rels, count(distinct rel) as rel_types from edges),
ro as (select count(*) as orphans from ids where id not in (select src from edges union all select dst from edges)),
rd as (select avg(degree) as a, max(degree) as mx, min(degree) as mn from deg where id in (select id from ids)),
rt as (select count(distinct type) as types, count(*) filter (where type = 'Document') as documents from nodes),
rb as (select count(*) as k from (select distinct e.src, e.rel, e.dst from edges e join edges f on e.src = f.dst and e.dst = f.src and e.rel = f.rel)),
rv as (select count(*) filter (where id is null or id = '') as bn from graph_nodes),
rw as (select count(*) filter (where source.id is null or source.id = '' or target.id is null or target.id = '') as be, count(*) as n from graph_relationships),
rm as (select avg(k) as per from (select doc, count(*) as k from mentions group by doc))
select nodes, rels, orphans, round(orphans / nodes::double, 6) as orphan_ratio,
round((case when orphans = 0 then 1 else greatest(1, orphans) + (nodes - orphans > 0)::int end) / nodes::double, 6) as component_ratio,
round((bn + be) / greatest(n, 1)::double, 6) as type_violation_rate, round(a, 6) as avg_degree, mx as max_degree, mn as min_degree,
round(rels / (nodes::double * (nodes - 1)), 12) as relationship_density, types::double as unique_entity_types, rel_types::double as unique_relationship_types,
round(rels / nodes::double, 6) as avg_relationships_per_node, round((nodes - orphans) / nodes::double, 6) as connectivity_ratio, documents as document_node_count,
round(per, 6) as avg_entities_per_document, round(k / rels::double, 6) as bidirectional_relationship_ratio
from rn, re, ro, rd, rt, rb, rv, rw, rm"""
)
def validation_report(g: Graph) -> DataFrame:
    return metrics.report(g.nodes, g.edges, g.mentions, g.raw_nodes, g.raw_edges)


def _metric(name: str, columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, d: (lambda g: metrics.report(g.nodes, g.edges, g.mentions, g.raw_nodes, g.raw_edges, columns))(Graph(spark, d))
    ORACLES[name] = CTE + sql


_metric("orphan_ratio", ["orphan_ratio"], "select round(count(*) filter (where id not in (select src from edges union all select dst from edges)) / count(*)::double, 6) as orphan_ratio from ids")
_metric("component_ratio", ["component_ratio"], ", o as (select count(*) as n, count(*) filter (where id not in (select src from edges union all select dst from edges)) as k from ids) select round((case when k = 0 then 1 else greatest(1, k) + (n - k > 0)::int end) / n::double, 6) as component_ratio from o")
_metric("type_violation_rate", ["type_violation_rate"], "select round(((select count(*) from graph_nodes where id is null or id = '') + count(*) filter (where source.id is null or source.id = '' or target.id is null or target.id = '')) / greatest(count(*), 1)::double, 6) as type_violation_rate from graph_relationships")
_metric("degree_stats", ["avg_degree", "max_degree", "min_degree"], "select round(avg(degree), 6) as avg_degree, max(degree) as max_degree, min(degree) as min_degree from deg where id in (select id from ids)")
_metric("density", ["relationship_density"], "select round((select count(*) from edges) / (count(*)::double * (count(*) - 1)), 12) as relationship_density from ids")
_metric("unique_types", ["unique_entity_types", "unique_relationship_types"], "select count(distinct type)::double as unique_entity_types, (select count(distinct rel)::double from edges) as unique_relationship_types from nodes")
_metric("avg_rels_per_node", ["avg_relationships_per_node"], "select round((select count(*) from edges) / count(*)::double, 6) as avg_relationships_per_node from ids")
_metric("connectivity_ratio", ["connectivity_ratio"], "select round(count(*) filter (where id in (select src from edges union all select dst from edges)) / count(*)::double, 6) as connectivity_ratio from ids")
_metric("doc_count", ["document_node_count"], "select count(*) filter (where type = 'Document') as document_node_count from nodes")
_metric("bidirectional_ratio", ["bidirectional_relationship_ratio"], "select round((select count(*) from (select distinct e.src, e.rel, e.dst from edges e join edges f on e.src = f.dst and e.dst = f.src and e.rel = f.rel)) / count(*)::double, 6) as bidirectional_relationship_ratio from edges")


@query("select doc, count(*) as entities from mentions group by doc")
def entities_per_document(g: Graph) -> DataFrame:
    return g.mentions.groupBy("doc").agg(F.count(F.lit(1)).alias("entities"))


@query("select coalesce(type, 'Unknown') as type, count(*) as n from nodes group by 1 order by n desc, 1 limit 5")
def top_entity_types(g: Graph) -> DataFrame:
    return metrics.type_counts(g.nodes, "type", 5)


@query("select coalesce(rel, 'Unknown') as rel, count(*) as n from edges group by 1 order by n desc, 1 limit 5")
def top_rel_types(g: Graph) -> DataFrame:
    return metrics.type_counts(g.edges, "rel", 5)


@query("select id, degree from deg order by degree desc, id limit 5")
def highest_degree_nodes(g: Graph) -> DataFrame:
    return metrics.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(5)


@query("select id, degree from deg")
def node_degrees(g: Graph) -> DataFrame:
    return metrics.degrees(g.edges)


@query("select distinct e.src, e.rel, e.dst from edges e join edges f on e.src = f.dst and e.dst = f.src and e.rel = f.rel")
def bidirectional_edges(g: Graph) -> DataFrame:
    return metrics.reciprocal(g.edges)


@query("select string_agg(rel, ', ' order by rel) as rels from (select distinct rel from edges where rel is not null)")
def rel_type_catalog(g: Graph) -> DataFrame:
    return g.edges.where("rel is not null").select("rel").distinct().agg(F.array_join(F.array_sort(F.collect_set("rel")), ", ").alias("rels"))


@query("select id, arg_max(coalesce(type, chr(0)), (first_seen_at, node_row_id)) as type, min(first_seen_at) as first_at from graph_nodes where id is not null and trim(id) <> '' group by id")
def merge_nodes_last_wins(g: Graph) -> DataFrame:
    return build.nodes_last_wins(g.raw_nodes.withColumn("type", F.coalesce("type", F.lit("\0"))), ["first_seen_at", "node_row_id"])


@query("select src_type, src, rel, dst_type, dst from edges where src in (select id from ids) and dst in (select id from ids)")
def merge_edges_require_endpoints(g: Graph) -> DataFrame:
    return build.edges_with_endpoints(g.edges, g.nodes).select("src_type", "src", "rel", "dst_type", "dst")


@query("select e.src_type, e.src, e.rel, e.dst_type, e.dst from edges e join nodes s on e.src = s.id and e.src_type = s.type join nodes t on e.dst = t.id and e.dst_type = t.type")
def edge_endpoint_join(g: Graph) -> DataFrame:
    return match.with_endpoints(g.edges, g.nodes).select("src_type", "src", "rel", "dst_type", "dst")


@query("select a, rel, b from undirected")
def undirected_edges(g: Graph) -> DataFrame:
    return metrics.undirected(g.edges)


@query("select e.src as a, e.rel, e.dst as b from edges e where src_type = 'Concept' and dst_type = 'Concept' and rel in ('MENTIONS', 'USES', 'SUPPORTS')")
def labelled_pattern(g: Graph) -> DataFrame:
    return match.match(g.edges, "Concept", ["MENTIONS", "USES", "SUPPORTS"], "Concept")


@query("select distinct src as a, rel, dst as b from edges where src_type = 'Person' and dst_type = 'Concept' union select dst, rel, src from edges where src <> dst and dst_type = 'Person' and src_type = 'Concept'")
def labelled_pattern_undirected(g: Graph) -> DataFrame:
    return match.match(g.edges, "Person", None, "Concept", directed=False)


@query(
    "select owner_kind, owner_id, meta_key, list(meta_value order by recorded_at, item_id) as \"values\" from metadata_items where meta_key is not null and meta_value is not null group by 1, 2, 3"
)
def props_multimap(g: Graph) -> DataFrame:
    return build.property_lists(g.items, ["owner_kind", "owner_id"], "meta_key", "meta_value", ["recorded_at", "item_id"])


@query(
    """, b as (select owner_kind, owner_id, meta_key, meta_value as value, case when recorded_at < timestamp '2024-07-01' then 0 else 1 end as gen from metadata_items where meta_key is not null and meta_value is not null)
select owner_kind, owner_id, meta_key, arg_max(value, (gen, value)) as value from b group by 1, 2, 3"""
)
def upsert_props(g: Graph) -> DataFrame:
    items = g.items.where("meta_key is not null and meta_value is not null").select("owner_kind", "owner_id", "meta_key", F.col("meta_value").alias("value"), "recorded_at")
    late = F.col("recorded_at") >= F.lit("2024-07-01").cast("timestamp_ntz")
    return build.upsert(items.where(~late), items.where(late), ["owner_kind", "owner_id", "meta_key"])


@query("select id, count(*) as n from nodes group by id having count(*) > 1")
def constraint_violations(g: Graph) -> DataFrame:
    return build.duplicate_keys(g.nodes, ["id"])


@query("select id from (select id from ids union select src from edges union select dst from edges)")
def entity_registry_ids(g: Graph) -> DataFrame:
    return build.registry(g.nodes, g.edges.select(F.col("src").alias("id")), g.edges.select(F.col("dst").alias("id")))


@query("select distinct dst as id from edges where dst not in (select id from ids)")
def registry_new_ids(g: Graph) -> DataFrame:
    return build.new_ids(g.edges.select(F.col("dst").alias("id")), g.nodes)


@query("select e.src, e.rel, e.dst from edges e, pair p where least(src, dst) = p.a and greatest(src, dst) = p.b order by src, rel, dst limit 20")
def direct_edges(g: Graph) -> DataFrame:
    return match.direct_edges(g.edges, match.strongest_pair(g.edges))


@query("select count(*) as n from edges e, pair p where least(src, dst) = p.a and greatest(src, dst) = p.b")
def direct_edge_count(g: Graph) -> DataFrame:
    return match.direct_edges(g.edges, match.strongest_pair(g.edges), 2**31 - 1).agg(F.count(F.lit(1)).alias("n"))


_PAIR_DOCS = "d as (select doc from mentions, pair where source_type = 'chunk' and id in (a, b) group by doc having count(distinct id) = 2)"


@query(
    f""", {_PAIR_DOCS}
select doc, case when split_part(doc, '::', 1) like '%.jsonl' and doc like '%::_%' then split_part(doc, '::', 1) end as chunk_file,
case when split_part(doc, '::', 1) like '%.jsonl' and doc like '%::_%' then substr(doc, instr(doc, '::') + 2) end as chunk_id
from d order by doc limit 10"""
)
def comention_documents(g: Graph) -> DataFrame:
    return match.comention_documents(g.mentions, match.strongest_pair(g.edges))


@query(
    f""", {_PAIR_DOCS}
select distinct e.src, e.rel, e.dst from mentions m1 join d on m1.doc = d.doc join edges e on e.src = m1.id join mentions m2 on m2.doc = d.doc and m2.id = e.dst"""
)
def triangle_in_documents(g: Graph) -> DataFrame:
    """Edges both of whose ends are mentioned by a document of the pair."""
    docs = match.comention_documents(g.mentions, match.strongest_pair(g.edges), 2**31 - 1).select("doc")
    inside = g.mentions.join(docs, "doc", "left_semi").select("doc", "id").distinct()
    return cascades.shared_pointers(g.edges, inside).select("src", "rel", "dst").distinct()


@query(
    """, c as (select id from deg order by degree desc, id limit 1),
n as (select src as id, rel, dst as neighbour, dst_type as neighbour_type from edges union all select dst, rel, src, src_type from edges where src <> dst)
select distinct rel, neighbour, neighbour_type from n join c using (id) order by coalesce(rel, ''), neighbour, coalesce(neighbour_type, '') limit 25"""
)
def neighborhood(g: Graph) -> DataFrame:
    return match.neighbourhood(g.edges, metrics.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(1).select("id"))


def _top_names(g: Graph) -> DataFrame:
    return metrics.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(10).select("id")


_NAMES = "names as (select id from deg order by degree desc, id limit 10), sub as (select distinct src, rel, dst from edges where src in (select id from names) or dst in (select id from names) order by src, coalesce(rel, ''), dst limit 200)"


@query(f", {_NAMES} select src, rel, dst from sub")
def grounded_subgraph_edges(g: Graph) -> DataFrame:
    return match.subgraph_edges(g.edges, _top_names(g))


@query(f", {_NAMES} select distinct id from (select src as id from sub union all select dst from sub)")
def grounded_subgraph_nodes(g: Graph) -> DataFrame:
    return match.subgraph_nodes(match.subgraph_edges(g.edges, _top_names(g)))


@query(
    """, ranked as (select id, any_value(type order by type) as type, row_number() over (order by max(degree) desc, id) as rank from deg join nodes using (id) where type is not null group by id order by rank limit 10),
e as (select count(*) filter (where type = 'Concept') >= 2 as enough from ranked)
select id, type, rank::int as rank from ranked, e where not enough or type = 'Concept' order by rank limit 2"""
)
def top2_concepts(g: Graph) -> DataFrame:
    known = g.nodes.where("type is not null").groupBy("id").agg(F.min("type").alias("type"))
    top = metrics.degrees(g.edges).join(known, "id").orderBy(F.desc("degree"), "id").limit(10)
    ranked = top.select("id", "type", F.struct((-F.col("degree")).alias("d"), "id").alias("k")).groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "id", "type"))).alias("rows"))
    ranked = ranked.select(F.posexplode("rows").alias("pos", "r")).select("r.id", "r.type", (F.col("pos") + 1).alias("rank"))
    return match.top_concepts(ranked)


_PATHS = "paths as (select n.id as image, min(m.meta_value) as path from metadata_items m join graph_nodes n on m.owner_kind = 'node' and m.owner_id = n.node_row_id where m.meta_key = 'source_path' and n.type = 'Image' and trim(m.meta_value) <> '' group by 1)"


@query(
    f""", {_NAMES}, {_PATHS},
dep as (select dst as concept, src as image from edges where rel = 'DEPICTS' and src_type = 'Image' and dst in (select id from names)),
bes as (select distinct c.id as concept, i.id as image from mentions c join mentions i on c.doc = i.doc where c.id in (select id from names) and i.type = 'Image')
select distinct concept, image, path from (select * from dep union select * from bes) join paths using (image) where path <> '' order by 1, 2, 3 limit 15"""
)
def image_evidence(g: Graph) -> DataFrame:
    images = g.raw_nodes.where("type = 'Image'").select("node_row_id", F.col("id").alias("image"))
    kept = g.items.where("owner_kind = 'node' and meta_key = 'source_path' and trim(meta_value) <> ''").select(F.col("owner_id").alias("node_row_id"), "meta_value")
    paths = images.join(kept, "node_row_id").groupBy("image").agg(F.min("meta_value").alias("path"))
    return match.image_evidence(g.edges, g.mentions, _top_names(g), paths)


@query(
    """, recursive_links as (select distinct a, b from undirected where a <> b), c as (select id from deg order by degree desc, id limit 1),
h1 as (select distinct b as id from recursive_links join c on a = c.id where b <> c.id),
h2 as (select distinct b as id from recursive_links join h1 on a = h1.id where b not in (select id from c union all select id from h1)),
h3 as (select distinct b as id from recursive_links join h2 on a = h2.id where b not in (select id from c union all select id from h1 union all select id from h2)),
h4 as (select distinct b as id from recursive_links join h3 on a = h3.id where b not in (select id from c union all select id from h1 union all select id from h2 union all select id from h3))
select id, 0 as hops from c union all select id, 1 from h1 union all select id, 2 from h2 union all select id, 3 from h3 union all select id, 4 from h4"""
)
def hops_from_hub(g: Graph) -> DataFrame:
    return match.hops_from(g.edges, metrics.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(1).select("id"))


@query(
    """, l as (select distinct a, b from undirected where a <> b), s as (select least(a, b) as x from pair),
t as (select max(m.b) as y from l f join l m on f.b = m.a where f.a = (select x from s) and m.b <> (select x from s) and m.b not in (select b from l where a = (select x from s)))
select 2 as hops, '[' || x || ', ' || (select min(f.b) from l f join l m on f.b = m.a where f.a = x and m.b = y) || ', ' || y || ']' as path from s, t where y is not null"""
)
def shortest_path_le4(g: Graph) -> DataFrame:
    """The shortest path from the first node of the strongest pair to the last, by name, of the nodes two hops away from it."""
    pair = match.strongest_pair(g.edges).first()
    if pair is None:
        return g.edges.sparkSession.createDataFrame([], "hops int, path string")
    near = match.hops_from(g.edges, g.edges.sparkSession.createDataFrame([(pair.a,)], "id string"), 2)
    far = near.where("hops = 2").agg(F.max("id")).first()[0]
    return match.shortest_path(g.edges, pair.a, far).select("hops", F.concat(F.lit("["), F.array_join("path", ", "), F.lit("]")).alias("path"))


@query(
    """, recursive_links as (select distinct a, b from undirected where a <> b)
select id, component from (
  with recursive cc(id, component) using key (id) as (
    select id, id from (select id from ids union select a from recursive_links)
    union
    select l.a, min(p.component) from recursive_links l join recurring.cc p on p.id = l.b join recurring.cc q on q.id = l.a where p.component < q.component group by l.a)
  select * from cc) where id in (select id from ids)"""
)
def connected_components(g: Graph) -> DataFrame:
    return match.connected_components(g.nodes, g.edges)


@query("select 1 as ok")
def ping(g: Graph) -> DataFrame:
    return g.nodes.sparkSession.sql("select 1 as ok")


@query(
    """, o as (select count(*) as n, count(*) filter (where id not in (select src from edges union all select dst from edges)) as k from ids),
v as (select ((select count(*) from graph_nodes where id is null or id = '') + count(*) filter (where source.id is null or source.id = '' or target.id is null or target.id = '')) / greatest(count(*), 1)::double as rate from graph_relationships)
select metric, round(value, 6) as value, threshold::double as threshold, value > threshold as raised from (
  select 'orphan_ratio' as metric, k / n::double as value, 0.1 as threshold from o
  union all select 'component_ratio', (case when k = 0 then 1 else greatest(1, k) + (n - k > 0)::int end) / n::double, 0.5 from o
  union all select 'type_violation_rate', rate, 0.05 from v)"""
)
def report_flags(g: Graph) -> DataFrame:
    """The three metrics that a report remarks on, against their thresholds."""
    r = metrics.report(g.nodes, g.edges, g.mentions, g.raw_nodes, g.raw_edges, [m for m, _, _ in metrics.REMARKS])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(limit).alias("threshold")) for m, limit, _ in metrics.REMARKS])
    return r.select(F.explode(rows).alias("x")).select("x.metric", "x.value", "x.threshold", (F.col("x.value") > F.col("x.threshold")).alias("raised"))
