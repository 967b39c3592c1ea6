"""Linking chunks, nodes and relations to each other by ids that only roughly agree.

A cascade is an ordered list of rules; each item takes the matches of its first rule that has any.
Every rule that can be one is an equi-join: a pointer is cut into its possible keys (whole, after
the last ``::``, its numeric suffix), so nothing is compared with everything. Matches are tagged
with their rule and the least is kept per item by a window over that item's own matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions import records, text as fn
from graphloom.operators.skew import hub_join
from graphloom.storage import give_back, materialize


def pointer_keys(pointers: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, rule, key): the keys a pointer can be met by: 1 whole or last part, 2 numeric suffix."""
    last = fn.last_segment(F.col(doc))
    keys = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("rule"), last.alias("key")),
            F.when(last != F.col(doc), F.struct(F.lit(1).alias("rule"), F.col(doc).alias("key"))),
            F.when(fn.numeric_suffix(last).isNotNull(), F.struct(F.lit(2).alias("rule"), fn.numeric_suffix(last).alias("key"))),
        )
    )
    return pointers.select(doc, F.explode(keys).alias("k")).select(doc, "k.rule", "k.key")


def chunk_pointers(chunks: DataFrame, pointers: DataFrame, chunk_id: str = "id", doc: str = "doc", suffix_rule: bool = True) -> DataFrame:
    """(chunk_id, doc, rule): the pointers of each chunk by the first rule that finds any.

    Rule 1: the pointer or its last part is the chunk's id. Rule 2: numeric suffixes agree and the
    chunk's file stem starts the pointer. Null and empty ids match nothing.
    """
    ids = chunks.where(F.length(chunk_id) > 0).select(F.col(chunk_id).alias("chunk_id")).distinct()
    keyed = pointer_keys(pointers.select(doc).distinct(), doc)
    exact = ids.join(keyed.where("rule = 1"), F.col("chunk_id") == F.col("key")).select("chunk_id", F.col(doc).alias("doc"), F.lit(1).alias("rule"))
    found = exact
    if suffix_rule:
        stem = F.expr("regexp_replace(chunk_id, '_[0-9]+$', '')")
        asked = ids.join(exact.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.concat(stem, fn.numeric_suffix(F.col("chunk_id"))).alias("want"))
        first = F.regexp_replace(F.substring_index(doc, "::", 1), r"\.jsonl$", "")
        have = keyed.where("rule = 2").select(F.col(doc).alias("doc"), F.concat(first, "key").alias("want"))
        found = exact.unionByName(asked.join(have, "want").select("chunk_id", "doc", F.lit(2).alias("rule")))
    return found


def shared_pointers(edge_table: DataFrame, inside: DataFrame) -> DataFrame:
    """(src, rel, dst, doc): every pointer that mentions both ends of an edge.

    inside: distinct (doc, id). Each edge looks up the pointers of its end with the fewer mentions and
    checks the other end by (doc, id); so a hub's pointers are never multiplied by its edges.
    """
    count = inside.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    e = materialize(edge_table.select("src", "rel", "dst").distinct(), "asked")  # a join of hubs reads its left side three times
    e = materialize(hub_join(e, count.select(F.col("id").alias("src"), F.col("n").alias("ns")), "src", ["rel", "dst"]), "asked-here")
    e = hub_join(e, count.select(F.col("id").alias("dst"), F.col("n").alias("nd")), "dst", ["src", "rel"])
    by_source = F.col("ns") <= F.col("nd")
    asked = e.select("src", "rel", "dst", F.when(by_source, F.col("src")).otherwise(F.col("dst")).alias("few"), F.when(by_source, F.col("dst")).otherwise(F.col("src")).alias("many"))
    looked = asked.join(inside.withColumnRenamed("id", "few"), "few")
    return looked.join(inside.withColumnRenamed("id", "many"), ["doc", "many"]).select("src", "rel", "dst", "doc")


#: Pairs are listed for groups of at most so many ids; larger ones are met edge by edge (:func:`shared_pointers`).
LARGEST = 500


def _numbers(column: Column, seed: int) -> Column:
    """(k, o): the number that stands for an id while pairs are looked for, and another that tells ids of one number apart."""
    return F.struct(F.xxhash64(F.lit(seed), column).alias("k"), F.hash(F.lit(-1 - seed), column).alias("o"))


def _indexed(edge_table: DataFrame, groups: Callable[[Callable[[Column], Column]], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(named, pairs, groups) with ids as numbers: named (lo, hi, lo_name, hi_name, rels), pairs (a, b), groups with ``ids``.

    ``groups`` makes the table, with a ``no`` of its own for each row, from the function that turns an id into its numbers.
    The two tables without names are written; where two ids have one number, they are made anew with the next seed, so that
    numbers are as good as ids. A pair's relations, of either direction, are one row.
    """
    seed = 0
    while True:
        number = lambda c, seed=seed: _numbers(c, seed)
        pairs = materialize(edge_table.select(number(F.col("src")).alias("s"), number(F.col("dst")).alias("d")).distinct(), "pairs")
        held = materialize(groups(number), "groups")
        every = pairs.select("s.*").unionByName(pairs.select("d.*")).unionByName(held.select(F.explode("ids").alias("i")).select("i.*"))
        if every.groupBy("k").agg(F.min("o").alias("x"), F.max("o").alias("y")).where("x <> y").isEmpty():
            break
        seed += 1
    keyed = edge_table.select("src", "rel", "dst", _numbers(F.col("src"), seed)["k"].alias("a"), _numbers(F.col("dst"), seed)["k"].alias("b"))
    forward = F.col("a") <= F.col("b")
    names = [F.first(F.when(forward, F.col(x)).otherwise(F.col(y))).alias(n) for x, y, n in (("src", "dst", "lo_name"), ("dst", "src", "hi_name"))]
    named = keyed.groupBy(*_ends()).agg(*names, F.collect_set(F.struct(forward.alias("forward"), "rel")).alias("rels"))
    return named, pairs.select(F.col("s.k").alias("a"), F.col("d.k").alias("b")), held.withColumn("ids", F.col("ids.k"))


def _ends() -> list[Column]:
    """A pair (a, b) whatever its direction."""
    return [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]


def _pairs_inside(pairs: DataFrame, groups: DataFrame, carried: list[str]) -> DataFrame:
    """(lo, hi, carried...): pairs of ids that lie in a group: all of a small group, those of ``pairs`` of a large one."""
    small = groups.where(F.size("ids") <= LARGEST)
    listed = small.select(*carried, "ids", F.explode("ids").alias("lo")).select(*carried, "lo", F.explode("ids").alias("hi")).where("lo <= hi").select("lo", "hi", *carried)
    large = groups.where(F.size("ids") > LARGEST)
    if large.isEmpty():
        return listed
    asked = pairs.select(*_ends()).distinct().select(F.col("lo").alias("src"), F.lit(0).alias("rel"), F.col("hi").alias("dst"))
    found = shared_pointers(asked, large.select(F.col("no").alias("doc"), F.explode("ids").alias("id"))).select(F.col("src").alias("lo"), F.col("dst").alias("hi"), F.col("doc").alias("no"))
    return listed.unionByName(found.join(large.select(*{"no", *carried}), "no").select("lo", "hi", *carried))


def _with_names(joined: DataFrame, carried: list[str]) -> DataFrame:
    """(src, rel, dst, carried...): the relations of named pairs."""
    rows = joined.select("lo_name", "hi_name", *carried, F.explode("rels").alias("r"))
    ends = [F.when(F.col("r.forward"), F.col(x)).otherwise(F.col(y)) for x, y in (("lo_name", "hi_name"), ("hi_name", "lo_name"))]
    return rows.select(ends[0].alias("src"), "r.rel", ends[1].alias("dst"), *carried)


def contained_pointers(ids: DataFrame, pointers: DataFrame, id_column: str = "chunk_id", doc: str = "doc", block: int = 100_000) -> DataFrame:
    """(chunk_id, doc): every pointer that holds an id anywhere in it, ``_1`` in ``_10`` included.

    The ids are the patterns of an automaton, ``block`` of them at a time, whatever their number; every pointer passes
    each automaton once. Nothing is compared in pairs. Empty ids are left out.
    """
    spark = ids.sparkSession
    given = ids.where(F.length(id_column) > 0).select(F.col(id_column).alias("chunk_id")).distinct()
    blocks = max(1, -(-given.count() // block))
    texts = pointers.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc")).distinct()
    out = None
    for n in range(blocks):
        held = spark.sparkContext.broadcast([r[0] for r in given.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == n).collect()])

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for word in held.value:
                machine.add_word(word, word)
            if held.value:
                machine.make_automaton()
            for batch in batches:
                rows = [(word, text) for text in batch.column(0).to_pylist() for word in ({w for _, w in machine.iter(text)} if held.value else ())]
                yield pa.RecordBatch.from_pydict({"chunk_id": pa.array([w for w, _ in rows], pa.string()), "doc": pa.array([t for _, t in rows], pa.string())})

        one = texts.mapInArrow(find, "chunk_id string, doc string")
        out = one if out is None else out.unionByName(one)
    return out


def _by_own_source(chunks: DataFrame, found: DataFrame, node_sources: DataFrame) -> DataFrame:
    """(chunk_id, id): for chunks without anything ``found``, the nodes whose own source id names the chunk."""
    ids = chunks.where(F.length("id") > 0).select(F.col("id").alias("chunk_id")).distinct().join(found.select("chunk_id").distinct(), "chunk_id", "left_anti")
    keyed = pointer_keys(node_sources.select("source_id").distinct(), "source_id").where("rule = 1").select("source_id", F.col("key").alias("chunk_id"))
    return ids.join(keyed, "chunk_id").join(node_sources.select("source_id", "id"), "source_id").select("chunk_id", "id").distinct()


def entities_for_chunks(chunks: DataFrame, mention_table: DataFrame, node_sources: DataFrame | None = None) -> DataFrame:
    """(chunk_id, id, type, rule): entities of each chunk through the pointers that name it.

    ``node_sources`` (id, type, source_id): where a node carries its own source id; rule 3, for chunks that have nothing else.
    """
    linked = chunk_pointers(chunks, mention_table.select("doc"))
    found = mention_table.join(linked, "doc").select("chunk_id", "id", "type", "rule").distinct()
    if node_sources is None:
        return found
    types = node_sources.select("id", "type").distinct()
    return found.unionByName(_by_own_source(chunks, found, node_sources).join(types, "id").select("chunk_id", "id", "type", F.lit(3).alias("rule")))


def relations_for_chunks(chunks: DataFrame, mention_table: DataFrame, edge_table: DataFrame, node_sources: DataFrame | None = None) -> DataFrame:
    """(chunk_id, src, rel, dst, rule): relations both of whose ends a chunk's pointer mentions; with ``node_sources``, for
    chunks that have none, those one of whose ends names the chunk as its own source (rule 3)."""
    m = mention_table.where("doc is not null and id is not null")
    linked = chunk_pointers(chunks, mention_table.select("doc"))

    def groups(number: Callable[[Column], Column]) -> DataFrame:
        return m.groupBy("doc").agg(F.collect_set(number(F.col("id"))).alias("ids")).join(linked, "doc").select("chunk_id", "rule", "ids", F.monotonically_increasing_id().alias("no"))

    named, pairs, held = _indexed(edge_table, groups)
    inside = _pairs_inside(pairs, held, ["chunk_id", "rule"]).repartition("lo", "hi").distinct()  # a chunk's pointers share pairs
    found = _with_names(inside.join(named.hint("shuffle_hash"), ["lo", "hi"]), ["chunk_id", "rule"]).select("chunk_id", "src", "rel", "dst", "rule")
    if node_sources is None:
        return found
    own = _by_own_source(chunks, found, node_sources)
    e = edge_table.select("src", "rel", "dst").distinct()
    ends = [hub_join(e, own.withColumnRenamed("id", end), end, ["src", "rel", "dst"]).select("chunk_id", "src", "rel", "dst") for end in ("src", "dst")]
    return found.unionByName(ends[0].unionByName(ends[1]).distinct().withColumn("rule", F.lit(3)))


def node_source_chunk(node_table: DataFrame, mention_table: DataFrame, chunks: DataFrame, chunk_id: str = "id", content: str = "content", order: list[str] | None = None) -> DataFrame:
    """(type, id, chunk_id): the first chunk, by file and place, that a node's pointers lead to; null where none does."""
    order = order or ["chunk_id"]
    held = chunks.where(F.length(content) > 0).select(F.col(chunk_id).alias("chunk_id"), F.col("metadata.source").alias("file"), "chunk_index")
    linked = chunk_pointers(chunks, mention_table.select("doc"))
    to = mention_table.join(linked, "doc").select("type", "id", "chunk_id").distinct().join(held, "chunk_id")
    best = to.groupBy("type", "id").agg(F.min_by("chunk_id", F.struct("file", "chunk_index", "chunk_id")).alias("chunk_id"))
    return node_table.alias("n").join(best.alias("b"), (F.col("n.type").eqNullSafe(F.col("b.type"))) & (F.col("n.id") == F.col("b.id")), "left").select("n.type", "n.id", "b.chunk_id")


def relation_source(edge_table: DataFrame, mention_table: DataFrame, redirect_images: bool = False) -> DataFrame:
    """(src, rel, dst, doc, rule): the pointer of each relation: one that mentions both ends, else the source, else the target.

    The smallest pointer of the first rule that finds one; null where none does. ``redirect_images``: a pointer to the
    images of a file gives way to the smallest pointer of the target that is none, where there is one.

    Pointers are numbered in their order, and each lists the pairs of ids it holds: what is shuffled follows the pointers,
    not how often the ends of an edge are mentioned elsewhere. Names come back at the end, once per pair.
    """
    m = mention_table.where("doc is not null and id is not null")
    image = records.is_image_source(F.col("doc")).cast("int")  # a number's last bit: a pointer tells what it leads to without being looked up
    docs = lambda number: m.groupBy("doc").agg(F.collect_set(number(F.col("id"))).alias("ids")).orderBy("doc").withColumn("no", F.shiftleft(F.monotonically_increasing_id(), 1) + image)
    named, pairs, docs = _indexed(edge_table, docs)
    both = _pairs_inside(pairs, docs, ["no"]).groupBy("lo", "hi").agg(F.min("no").alias("no"))
    first = materialize(pairs.select("a", "b", *_ends()).join(both, ["lo", "hi"], "left").select("a", "b", "no"), "first")
    del both
    give_back(edge_table.sparkSession)
    shows = lambda no: F.lit(redirect_images) & (F.col(no) % 2 == 1)
    least = docs.select("no", F.explode("ids").alias("id")).groupBy("id").agg(F.min("no").alias("no"), F.min(F.when(F.col("no") % 2 == 0, F.col("no"))).alias("real"))
    of_source, of_target = least.select(F.col("id").alias("a"), F.col("no").alias("s")), least.select(F.col("id").alias("b"), F.col("no").alias("t"), "real")
    rest = first.where("no is null").select("a", "b").join(of_source, "a", "left").join(of_target, "b", "left")
    rule = F.when(F.col("s").isNotNull(), 2).when(F.col("t").isNotNull(), 3)
    rest = rest.select("a", "b", F.coalesce("s", "t").alias("no"), "real", rule.alias("rule")).select("a", "b", F.when(shows("no"), F.coalesce("real", "no")).otherwise(F.col("no")).alias("no"), "rule")
    told = first.where(F.col("no").isNotNull() & ~shows("no")).select("a", "b", "no", F.lit(1).alias("rule")).unionByName(rest)
    if redirect_images:
        shown = first.where(shows("no")).join(of_target, "b", "left")
        told = told.unionByName(shown.select("a", "b", F.coalesce("real", "no").alias("no"), F.lit(1).alias("rule")))
    written = told.join(docs.select("no", "doc"), "no", "left").select(*_ends(), (F.col("a") <= F.col("b")).alias("forward"), "doc", "rule")
    told_here = named.join(written, ["lo", "hi"]).withColumn("rels", F.filter("rels", lambda r: r["forward"] == F.col("forward")))
    return _with_names(told_here, ["doc", "rule"])


def chunk_by_pointer(pointers: DataFrame, chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, file, chunk_id, status, content): the chunk that ``<file>.jsonl::<id>`` names; the first of several.

    A chunk is looked up by file and id. The file a chunk lies in is its ``chunk_file`` column, where the table has one,
    else the one its id names (``<file>_chunks_<size>_<number>``), else the stem of its Markdown file; a pointer whose file none of the chunks lies in is resolved by id alone only
    where all chunks of that id lie in one file.
    """
    from graphloom.operators.graph_match import split_pointer

    file, chunk = split_pointer(F.col(doc))
    asked = pointers.select(F.col(doc).alias("doc"), file.alias("file"), chunk.alias("chunk_id")).where("chunk_id is not null")
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*[/\\\\]", ""), r"\.(jsonl|md)$", "")
    named = F.regexp_extract("id", r"^(.+_chunks_[^_]+)_\d+$", 1)
    place = F.col("chunk_file") if "chunk_file" in chunks.columns else F.when(named != "", named).otherwise(F.col("metadata.source"))
    rows = chunks.select(F.col("id").alias("chunk_id"), stem(place).alias("stem"), "content", F.struct("chunk_index", "chunk_key").alias("rank"))
    here = rows.groupBy("chunk_id", "stem").agg(F.min_by("content", "rank").alias("here"), F.lit(True).alias("in_file"))
    alone = rows.groupBy("chunk_id").agg(F.min_by("content", "rank").alias("alone"), (F.count_distinct("stem") <= 1).alias("one_file"))
    both = asked.withColumn("stem", stem(F.col("file"))).join(here, ["chunk_id", "stem"], "left").join(alone, "chunk_id", "left")
    found = F.coalesce("in_file", F.lit(False)) | F.coalesce("one_file", F.lit(False))
    content = F.when(F.col("in_file"), F.col("here")).when(F.col("one_file"), F.col("alone"))
    return both.select("doc", "file", "chunk_id", F.when(found, "OK").otherwise("NOT_FOUND_IN_FILE").alias("status"), content.alias("content"))


def chunk_by_terms(chunks: DataFrame, words: list[str], per_file: int = 3) -> DataFrame:
    """(source, chunk_key, chunk_index): the first chunks of each file that hold any of the words (six at most)."""
    from graphloom.operators.search import containing

    hits = containing(chunks, "content", words).select(F.col("metadata.source").alias("source"), "chunk_key", "chunk_index")
    w = Window.partitionBy("source").orderBy("chunk_index", "chunk_key")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_file).drop("_n")


def linked_pairs(asked: DataFrame, chunks: DataFrame, mention_table: DataFrame, edge_table: DataFrame, key: Callable[[Column, Column], Column]) -> DataFrame:
    """(chunk_id, item): those of the ``asked`` items (chunk_id, item) that the graph links in the chunk: ``key`` of an edge both of whose ends one pointer of the chunk mentions.

    It starts at what is asked: only edges of an asked item are looked up in the chunk's pointers.
    """
    wanted = asked.where("item is not null").select("chunk_id", "item").distinct()
    pairs = edge_table.select("src", "dst").distinct().select("src", "dst", key(F.col("src"), F.col("dst")).alias("item"))
    linked = chunk_pointers(chunks, mention_table.select("doc"), suffix_rule=False).select("chunk_id", "doc")
    held = mention_table.where("doc is not null and id is not null").groupBy("doc").agg(F.collect_set("id").alias("ids"))
    inside = linked.join(held, "doc").select("chunk_id", "ids")
    both = F.array_contains("ids", F.col("src")) & F.array_contains("ids", F.col("dst"))
    return wanted.join(pairs, "item").join(inside, "chunk_id").where(both).select("chunk_id", "item").distinct()


def coverage(mentioned: DataFrame, covered: DataFrame) -> DataFrame:
    """(chunks, coverage): mean share of each chunk's mentioned items that are covered; 0 where nothing is mentioned.

    Both: (chunk_id, item), items normalised by the caller.
    """
    m = mentioned.where("item is not null").select("chunk_id", "item").distinct()
    c = covered.select("chunk_id", "item", F.lit(1).alias("hit")).distinct()
    share = m.join(c, ["chunk_id", "item"], "left").groupBy("chunk_id").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return share.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.round(F.avg("share"), 6), F.lit(0.0)).alias("coverage"))


def entity_key(column: F.Column) -> F.Column:
    """An entity as coverage compares it."""
    return F.lower(F.trim(column))


def relation_key(src: F.Column, rel: F.Column, dst: F.Column) -> F.Column:
    """A relation as coverage compares it."""
    return F.concat_ws("\x1f", F.lower(F.trim(src)), F.upper(F.trim(rel)), F.lower(F.trim(dst)))


def hashed_sample(rows: DataFrame, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """A repeatable random sample of ``n`` rows: those of the least MD5 of seed and columns. This is the operator's purpose."""
    return rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))).orderBy("_h", *columns).limit(n).drop("_h")
