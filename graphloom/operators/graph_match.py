"""Pattern retrieval over the edge and mention tables.

Every pattern binds its entities first and joins afterwards, so a hub is read by a filtered scan and
never multiplied. Limits are top-k reports with a unique order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.operators.skew import hot_keys, hub_join, salted_join
from graphloom.storage import materialize


def with_endpoints(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges joined to both endpoint nodes by (type, id): an inner match of (s)-[r]->(t)."""
    out = edge_table
    columns = [c for c in edge_table.columns if c not in ("src_type", "src", "dst_type", "dst")]
    for end in ("src", "dst"):
        side = node_table.select(F.struct(F.col("type"), F.col("id")).alias("_end")).where("_end.type is not null and _end.id is not null")
        keyed = out.withColumn("_end", F.when(F.col(f"{end}_type").isNotNull() & F.col(end).isNotNull(), F.struct(F.col(f"{end}_type").alias("type"), F.col(end).alias("id"))))
        out = hub_join(keyed, side, "_end", ["src", "dst", *columns]).drop("_end")
    return out.select("dst_type", "dst", "src_type", "src", *columns)


def match(edge_table: DataFrame, src_type: str | None = None, rels: list[str] | None = None, dst_type: str | None = None, directed: bool = True) -> DataFrame:
    """(a, rel, b) of a typed pattern; undirected patterns match both ways."""
    e = edge_table
    if directed:
        e = e.where(F.col("src_type") == src_type) if src_type else e
        e = e.where(F.col("dst_type") == dst_type) if dst_type else e
        e = e.where(F.col("rel").isin(rels)) if rels else e
        return e.select(F.col("src").alias("a"), "rel", F.col("dst").alias("b"))
    both = match(edge_table, src_type, rels, dst_type).unionByName(match(edge_table.where("src <> dst"), dst_type, rels, src_type).select(F.col("b").alias("a"), "rel", F.col("a").alias("b")))
    return both.distinct()


def allowed_types(wanted: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """(kept, dropped) relationship types of a generated pattern, in its order; none kept means untyped."""
    return [t for t in wanted if t in known], [t for t in wanted if t not in known]


def strongest_pair(edge_table: DataFrame) -> DataFrame:
    """(a, b): the unordered pair of different nodes with the most edges, ties by name; one row."""
    pair = edge_table.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pair.orderBy(F.desc("n"), "a", "b").limit(1).select("a", "b")


def direct_edges(edge_table: DataFrame, pair: DataFrame, limit: int = 20) -> DataFrame:
    """Edges between the two nodes of ``pair`` (one row), either way."""
    p = F.broadcast(pair)
    return edge_table.join(p, (F.least("src", "dst") == p.a) & (F.greatest("src", "dst") == p.b)).select("src", "rel", "dst").orderBy("src", "rel", "dst").limit(limit)


def split_pointer(doc: Column) -> tuple[Column, Column]:
    """(file, chunk id) of ``<file>.jsonl::<chunk id>``, split at the first mark; null where it is another form."""
    parts = F.split(doc, "::", 2)
    file, rest = F.get(parts, 0), F.get(parts, 1)
    ok = file.endswith(".jsonl") & (rest != "")
    return F.when(ok, file), F.when(ok, rest)


def comention_documents(mention_table: DataFrame, pair: DataFrame, limit: int = 10) -> DataFrame:
    """Chunk pointers that mention both nodes of ``pair``, with file and chunk id.

    One filtered pass and one aggregation by pointer: no pairs are formed.
    """
    p = F.broadcast(pair.select(F.explode(F.array("a", "b")).alias("id")))
    both = mention_table.where("source_type = 'chunk'").join(p, "id").groupBy("doc").agg(F.countDistinct("id").alias("n")).where("n = 2")
    file, chunk = split_pointer(F.col("doc"))
    return both.select("doc", file.alias("chunk_file"), chunk.alias("chunk_id")).orderBy("doc").limit(limit)


def neighbourhood(edge_table: DataFrame, centre: DataFrame, limit: int = 25) -> DataFrame:
    """(rel, neighbour, neighbour_type) one hop around ``centre`` (one row: id)."""
    there = edge_table.select(F.col("src").alias("id"), "rel", F.col("dst").alias("neighbour"), F.col("dst_type").alias("neighbour_type"))
    back = edge_table.where("src <> dst").select(F.col("dst").alias("id"), "rel", F.col("src").alias("neighbour"), F.col("src_type").alias("neighbour_type"))
    found = there.unionByName(back).join(F.broadcast(centre), "id").select("rel", "neighbour", "neighbour_type").distinct()
    return found.orderBy(F.coalesce("rel", F.lit("")), "neighbour", F.coalesce("neighbour_type", F.lit(""))).limit(limit)


def subgraph_edges(edge_table: DataFrame, names: DataFrame, limit: int = 200) -> DataFrame:
    """Distinct (src, rel, dst) that touch one of ``names`` (bounded list: id)."""
    n = F.broadcast(names.select("id"))
    touching = edge_table.select("src", "rel", "dst").distinct()
    hit = touching.join(n.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(touching.join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")).distinct()
    return hit.select("src", "rel", "dst").orderBy("src", F.coalesce("rel", F.lit("")), "dst").limit(limit)


def subgraph_nodes(edges_found: DataFrame) -> DataFrame:
    """Ids of a subgraph's edges."""
    return edges_found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def image_evidence(edge_table: DataFrame, mention_table: DataFrame, concepts: DataFrame, paths: DataFrame, limit: int = 15) -> DataFrame:
    """(concept, image, path): images that depict a concept, or that a pointer mentions beside it.

    concepts: bounded list (id). paths: (image, path).
    """
    c = F.broadcast(concepts.select(F.col("id").alias("concept")))
    depicted = edge_table.where("rel = 'DEPICTS' and src_type = 'Image'").join(c, F.col("dst") == F.col("concept")).select("concept", F.col("src").alias("image"))
    pointers = mention_table.join(c, F.col("id") == F.col("concept")).select("doc", "concept").distinct()
    beside = mention_table.where("type = 'Image'").select("doc", F.col("id").alias("image")).distinct().join(pointers, "doc").select("concept", "image")
    found = depicted.unionByName(beside).distinct().join(paths, "image", "left")
    return found.where("path is not null and path <> ''").select("concept", "image", "path").distinct().orderBy("concept", "image", "path").limit(limit)


def top_concepts(ranked: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` of type Concept by rank; the first ``n`` of any type if there are fewer.

    ranked: (id, type, rank), bounded (a top-k list).
    """
    concepts = ranked.where("type = 'Concept'")
    enough = concepts.agg((F.count(F.lit(1)) >= n).alias("enough"))
    marked = ranked.join(F.broadcast(enough)).where(~F.col("enough") | (F.col("type") == "Concept"))
    return marked.orderBy("rank").limit(n).select("id", "type", "rank")


def _links(edge_table: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """((a, b) both ways of every two nodes that an edge links, written once; its hot keys)."""
    pairs = edge_table.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*")
    links = materialize(both, "links")
    return links, hot_keys(links.groupBy("a").agg(F.count(F.lit(1)).alias("count")), "a")


def _hops(links: DataFrame, hubs: list[tuple], start: DataFrame, most: int) -> DataFrame:
    """(id, hops) along :func:`_links`."""
    seen = start.select("id", F.lit(0).alias("hops"))
    frontier = start.select("id")
    for hop in range(1, most + 1):
        reached = salted_join(links, frontier.select(F.col("id").alias("a")), "a", hubs, F.col("b")).select(F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti"), f"hop-{hop}")
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return seen


def hops_from(edge_table: DataFrame, start: DataFrame, most: int = 4) -> DataFrame:
    """(id, hops) of every node within ``most`` undirected hops of ``start`` (one row: id).

    Breadth-first: each round joins the frontier only and drops what was seen; each round is written
    so that the plan stays flat and survives lost executors.
    """
    return _hops(*_links(edge_table), start, most)


def shortest_path(edge_table: DataFrame, start: str, end: str, most: int = 4) -> DataFrame:
    """(hops, path): the lexicographically smallest shortest path between two nodes, as an array of ids.

    Two breadth-first passes bound the search: only nodes on some shortest path are kept, and the
    smallest path grows layer by layer with one row per node.
    """
    spark = edge_table.sparkSession
    out_schema = "hops int, path array<string>"
    if start is None or end is None:
        return spark.createDataFrame([], out_schema)
    if start == end:
        return spark.createDataFrame([(0, [start])], out_schema)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    links, hubs = _links(edge_table)
    ahead = _hops(links, hubs, one(start), most)
    target = ahead.where(F.col("id") == end).select("hops").first()
    if target is None:
        return spark.createDataFrame([], out_schema)
    length = target.hops
    back = _hops(links, hubs, one(end), length)
    layer = ahead.withColumnRenamed("hops", "h").join(back, "id").where(F.col("h") + F.col("hops") == length).select("id", "h")
    paths = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    for h in range(1, length + 1):
        step = salted_join(links, paths.withColumnRenamed("id", "a"), "a", hubs, F.col("b")).join(layer.where(F.col("h") == h), F.col("b") == F.col("id")).drop("id")
        paths = materialize(step.groupBy(F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("b"))).alias("path")), f"path-{h}")
    return paths.where(F.col("id") == end).select(F.lit(length).alias("hops"), "path")


def connected_components(node_ids: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each node's connected component.

    Alternating large-star and small-star steps: each step links a node's neighbours to the least
    one, rounds grow with the logarithm of the diameter, and groups are reduced by ``min`` only; the
    neighbours of a hub spread over tasks. Rounds go on until nothing changes.
    """
    links = edge_table.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    links = materialize(links, "cc-0")
    before, round_ = None, 0
    while True:
        round_ += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("count")), f"cc-least-{round_}")
        hubs = hot_keys(least, "u")
        large = salted_join(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", hubs, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), f"cc-large-{round_}")
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("count")), f"cc-small-{round_}")
        small = salted_join(large, small_least.select("u", "m"), "u", hot_keys(small_least, "u"), F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(small_least.select("u", F.col("m").alias("v")))
        links = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"cc-{round_}")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    ids = node_ids.select("id").distinct()
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
