"""Deeply nested JSON lines into related flat tables by Merkle subtree identities.

One Arrow pass parses each line, canonicalises its objects bottom-up and hashes every object over
its role, all its scalars and its children's hashes. It yields two tables:

* ``objects``: every distinct object once, by hash (kind, id, type, key, value, all further scalar
  ``fields`` as JSON, child hashes with the field or place they stand at);
* ``bridge``: every occurrence of an object with its parent occurrence, its role, field and ordinal.

Documents, nodes, relationships, endpoints, sources and metadata entries are kinds of their own;
whatever else a record holds (unknown fields, nested metadata values, what wraps the documents of a
line) is stored as kinds ``object`` and ``array``, so that no part of a line is lost and objects that
differ anywhere have different identities.

Arbitrarily deep recursion has no built-in expression, hence Python; the joins that flatten the two
tables stay in the JVM. Tasks forget repeated objects locally before the shuffle, so a hot object
costs one row per task; on the bridge side the occurrences of a hot object are salted.

Layouts understood: one document per line; ``{"graph": {...}, "source": ...}``;
``{"documents": [...]}`` and top-level arrays of documents; any of them encoded twice. Metadata may
be an array of ``{key, value}``, one such object, or a plain map; an endpoint may be a bare id. The
shape metadata was written in is no part of an identity.

Defined results: null, blank and broken lines give nothing; nesting of any depth is read; null array
elements take their place in the count but make no row; a missing, null or empty array gives no rows;
an entry without a key is no entry, one without a value has a null value; repeated lines keep their
own bridge rows and share objects; numbers are kept as written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.operators.jsonvalue import canonical_text, literal, nested as is_nested, parse_line, places
from graphloom.operators.skew import hot_keys, salted_join
from graphloom.storage import materialize
from graphloom.tables import wide_enough

SHRED_SCHEMA = (
    "part string, line_id bigint, occ int, parent_occ int, role string, field string, doc_pos int, owner string, owner_pos int, "
    "ordinal int, key_ordinal int, hash string, id string, type string, meta_key string, meta_value string, fields string, children array<string>"
)
_ARROW = pa.schema(
    [(n, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (f.split() for f in SHRED_SCHEMA.split(", "))]
)
_content = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode
#: Hashes a task remembers to drop repeats before the shuffle; beyond it the memory starts anew.
REMEMBERED = 100_000


def _documents(value) -> tuple[list[tuple[int, dict, object]], dict]:
    """[(place, document, source)] of a parsed line, and the fields that stand around its documents."""
    around: dict = {}
    if isinstance(value, dict) and isinstance(value.get("documents"), list) and "nodes" not in value:
        around = {k: v for k, v in value.items() if k != "documents"}
        value = value["documents"]
    many = isinstance(value, list)
    out, stray = [], []
    for pos, doc in enumerate(value if many else [value]):
        if not isinstance(doc, dict):
            if many and doc is not None:
                stray.append(doc)
            continue
        source = doc.get("source")
        if isinstance(doc.get("graph"), dict):
            source = source if "source" in doc else doc["graph"].get("source")
            rest = {k: v for k, v in doc.items() if k not in ("graph", "source")}
            doc = {**rest, **doc["graph"]} if rest else doc["graph"]
        out.append((pos, doc, source))
    if stray:
        around["documents"] = stray
    return out, around


def _entries(metadata) -> tuple[list[tuple[int, str, object, dict]], list]:
    """[(place, key, value, further fields)] of each metadata entry, whatever its shape, and the elements that are none."""
    if isinstance(metadata, dict):
        if type(metadata.get("key")) is str and set(metadata) <= {"key", "value"}:
            metadata = [metadata]
        else:
            return [(pos, key, value, {}) for pos, (key, value) in enumerate(metadata.items())], []
    if not isinstance(metadata, list):
        return [], [] if metadata is None else [metadata]
    out, stray = [], []
    for pos, item in enumerate(metadata):
        if isinstance(item, dict) and item.get("key") is not None:
            key = item["key"]
            out.append((pos, _text(key), item.get("value"), {k: v for k, v in item.items() if k not in ("key", "value")} if len(item) > 2 else {}))
        elif item is not None:
            stray.append(item)
    return out, stray


def _text(value) -> str | None:
    """A scalar as text, anything else as canonical JSON; lone surrogates become question marks."""
    if value is None:
        return None
    text = value if isinstance(value, str) else canonical_text(value)
    return str(text) if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


_OWN = {"node": {"id", "type", "metadata"}, "endpoint": {"id", "type", "metadata"}, "source": {"source_id", "source_type", "metadata"}, "relationship": {"source", "target", "type"}, "document": {"nodes", "relationships", "source"}}


class _Shredder:
    """Rows of one task; objects it has seen are dropped again."""

    def __init__(self) -> None:
        self.objects: list[tuple] = []
        self.bridge: list[tuple] = []
        self.seen: dict[tuple, str] = {}

    def obj(self, kind: str, id_=None, type_=None, key=None, value=None, fields: str | None = None, children=(), literals=()) -> str:
        """Store an object; ``literals`` tell apart what the texts do not (the number 1 and the text "1")."""
        content = (kind, id_, type_, key, value, fields, tuple(children), *literals)
        digest = self.seen.get(content)
        if digest is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            digest = self.seen[content] = blake2b(_content(content).encode("utf-8", "replace"), digest_size=16).hexdigest()
            self.objects.append((kind, digest, id_, type_, key, value, fields, list(content[6])))
        return digest

    def subtree(self, value) -> list[tuple]:
        """Store an object or array with all it holds; [(place of its holder in this list or -1, field, ordinal, hash)], holders first."""
        every = places(value)
        held: list[list[tuple]] = [[] for _ in every]
        digests = [""] * len(every)
        for at in range(len(every) - 1, -1, -1):
            above, field, ordinal, it = every[at]
            children = [f"{f if f is not None else o}:{h}" for o, f, h in reversed(held[at])]
            keyed = isinstance(it, dict)
            scalars = {str(k): v for k, v in (it.items() if keyed else enumerate(it)) if not is_nested(v)}
            if keyed:
                children.sort()
            digests[at] = self.obj("object" if keyed else "array", fields=_text(canonical_text(scalars)), children=[_text(c) for c in children])
            if above >= 0:
                held[above].append((ordinal, field, digests[at]))
        return [(above, _text(field), ordinal, digests[at]) for at, (above, field, ordinal, _) in enumerate(every)]

    def rest(self, things: dict) -> tuple[str | None, list[tuple[str, list]]]:
        """(JSON of the scalars, [(field, subtree)] of the others) of fields that have no column of their own."""
        if not things:
            return None, []
        scalars = {k: v for k, v in things.items() if not is_nested(v)}
        return (_text(canonical_text(scalars)) if scalars else None), [(_text(k), self.subtree(v)) for k, v in things.items() if is_nested(v)]

    def owned(self, thing, kind: str, id_field: str, type_field: str):
        """(hash, entries, subtrees) of a node, endpoint or source; null where there is none."""
        if type(thing) is str:
            thing = {id_field: thing}
        elif not isinstance(thing, dict):
            return None
        counted: dict[str, int] = {}
        entries = []
        found, stray = _entries(thing.get("metadata"))
        for pos, key, value, more in found:
            key = _text(key)
            counted[key] = counted.get(key, -1) + 1
            fields, below = self.rest(more)
            if is_nested(value):
                below = [("value", self.subtree(value)), *below]
            entries.append((pos, counted[key], self.obj("metadata", key=key, value=_text(value), fields=fields, children=_kids(below), literals=(None if value is None or is_nested(value) else _text(literal(value)),)), below))
        own = _OWN[kind]
        more = {k: v for k, v in thing.items() if k not in own} if len(thing) > 3 or not thing.keys() <= own else {}
        if stray:
            more["metadata"] = stray
        fields, below = self.rest(more)
        id_, type_ = thing.get(id_field), thing.get(type_field)
        digest = self.obj(kind, _text(id_), _text(type_), fields=fields, children=[*(h for _, _, h, _ in entries), *_kids(below)], literals=[_text(canonical_text(x)) for x in (id_, type_) if x is not None and type(x) is not str])
        return digest, entries, below

    def line(self, line_id: int, value) -> None:
        occ, add = 0, self.bridge.append

        def emit(parent: int, role: str, doc_pos: int, owner: str | None, owner_pos: int, ordinal: int, key_ordinal: int, digest: str, field: str | None = None) -> int:
            nonlocal occ
            occ += 1
            add((line_id, occ, parent, role, field, doc_pos, owner, owner_pos, ordinal, key_ordinal, digest))
            return occ

        def emit_below(parent: int, doc_pos: int, owner: str | None, owner_pos: int, below) -> None:
            for field, tree in below:
                at: list[int] = []
                for above, name, ordinal, digest in tree:
                    at.append(emit(parent if above < 0 else at[above], "field", doc_pos, owner, owner_pos, ordinal, 0, digest, field if above < 0 else name))

        def emit_owned(parent: int, role: str, doc_pos: int, owner: str, owner_pos: int, ordinal: int, made) -> None:
            digest, entries, below = made
            at = emit(parent, role, doc_pos, owner, owner_pos, ordinal, 0, digest)
            for place, again, child, under in entries:
                entry = emit(at, "metadata", doc_pos, owner, owner_pos, place, again, child)
                if under:
                    emit_below(entry, doc_pos, owner, owner_pos, under)
            if below:
                emit_below(at, doc_pos, owner, owner_pos, below)

        documents, around = _documents(value)
        root = 0
        if around:
            fields, below = self.rest(around)
            root = emit(0, "line", 0, None, 0, 0, 0, self.obj("line", fields=fields, children=_kids(below)))
            emit_below(root, 0, None, 0, below)
        for doc_pos, doc, source in documents:
            # bottom-up: children are hashed before the document that holds them
            more = {k: v for k, v in doc.items() if k not in _OWN["document"]} if not doc.keys() <= _OWN["document"] else {}

            def each(field: str, more=more, doc=doc):
                held = doc.get(field)
                many = held if isinstance(held, list) else [held]
                stray = [x for x in many if x is not None and not isinstance(x, dict)]
                if stray:
                    more[field] = stray
                return [(pos, x) for pos, x in enumerate(many) if isinstance(x, dict)]

            nodes = [(pos, self.owned(node, "node", "id", "type")) for pos, node in each("nodes")]
            rels = []
            for pos, rel in each("relationships"):
                ends, others = [], {k: v for k, v in rel.items() if k not in _OWN["relationship"]} if not rel.keys() <= _OWN["relationship"] else {}
                for role, end in (("rel_source", "source"), ("rel_target", "target")):
                    if made := self.owned(rel.get(end), "endpoint", "id", "type"):
                        ends.append((role, made))
                    elif rel.get(end) is not None:
                        others[end] = rel[end]
                fields, below = self.rest(others)
                type_ = rel.get("type")
                digest = self.obj("relationship", type_=_text(type_), fields=fields, children=[*(f"{role}:{made[0]}" for role, made in ends), *_kids(below)], literals=[_text(canonical_text(type_))] if type_ is not None and type(type_) is not str else ())
                rels.append((pos, digest, ends, below))
            origin = self.owned(source, "source", "source_id", "source_type")
            if origin is None and source is not None:
                more["source"] = source
            fields, below = self.rest(more)
            children = [*(f"nodes/{p}:{made[0]}" for p, made in nodes), *(f"relationships/{p}:{h}" for p, h, _, _ in rels), *([f"source:{origin[0]}"] if origin else []), *_kids(below)]
            top = emit(root, "document", doc_pos, None, doc_pos, doc_pos, 0, self.obj("document", fields=fields, children=children))
            if below:
                emit_below(top, doc_pos, None, doc_pos, below)
            for pos, made in nodes:
                emit_owned(top, "node", doc_pos, "node", pos, pos, made)
            for pos, digest, ends, below in rels:
                at = emit(top, "relationship", doc_pos, None, pos, pos, 0, digest)
                if below:
                    emit_below(at, doc_pos, None, pos, below)
                for role, made in ends:
                    emit_owned(at, role, doc_pos, role, pos, 0, made)
            if origin:
                emit_owned(top, "source", doc_pos, "source", 0, 0, origin)


def _kids(below: list[tuple[str, list]]) -> list[str]:
    """Subtrees as children of the object that holds them."""
    return sorted(f"{field}:{tree[0][3]}" for field, tree in below)


_OBJECT = ["role", "hash", "id", "type", "meta_key", "meta_value", "fields", "children"]
_BRIDGE = ["line_id", "occ", "parent_occ", "role", "field", "doc_pos", "owner", "owner_pos", "ordinal", "key_ordinal", "hash"]


def _batch(part: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    held = dict(zip(names, zip(*rows)))
    columns = [pa.array([part] * len(rows), f.type) if f.name == "part" else pa.array(held[f.name], f.type) if f.name in held else pa.nulls(len(rows), f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shredder = _Shredder()

    def flush() -> Iterator[pa.RecordBatch]:
        for part, names, rows in (("object", _OBJECT, shredder.objects), ("bridge", _BRIDGE, shredder.bridge)):
            yield _batch(part, names, rows)
            rows.clear()

    for batch in batches:
        for line_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                shredder.line(line_id, parse_line(line))
            except ValueError:
                continue
            if len(shredder.bridge) >= 20_000:
                yield from flush()
        yield from flush()


def shred(lines: DataFrame, id_column: str = "line_id", text_column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(objects, bridge) of a table of JSON lines; the pass over the lines runs once and is written."""
    raw = wide_enough(lines.select(F.col(id_column).cast("bigint").alias("line_id"), F.col(text_column).alias("line"))).mapInArrow(_shred_batches, SHRED_SCHEMA)
    written = materialize(raw, "shred", ["part"])
    objects = (
        written.where("part = 'object'")
        .groupBy("hash")
        .agg(*[F.first(c).alias(n) for c, n in (("role", "kind"), ("id", "id"), ("type", "type"), ("meta_key", "meta_key"), ("meta_value", "meta_value"), ("fields", "fields"), ("children", "children"))])
    )
    bridge = written.where("part = 'bridge'").select("line_id", "occ", "parent_occ", "role", "field", "doc_pos", "owner", "owner_pos", "ordinal", "key_ordinal", "hash")
    return objects, bridge


def _attached(occurrences: DataFrame, held: DataFrame) -> DataFrame:
    """Occurrences joined to their stored objects; those of a hot object are spread over tasks."""
    counted = occurrences.groupBy("hash").agg(F.count(F.lit(1)).alias("count"))
    return salted_join(occurrences, held, "hash", hot_keys(counted, "hash"), F.col("line_id"))


def metadata_entries(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every metadata entry of every owner, with its ordinal and how often its key came before in the owner."""
    held = objects.where("kind = 'metadata'").select("hash", "meta_key", "meta_value")
    return _attached(bridge.where("role = 'metadata'"), held).select("line_id", "doc_pos", "owner", "owner_pos", "ordinal", "key_ordinal", "meta_key", "meta_value", "parent_occ")


def nodes(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every node of every document."""
    held = objects.where("kind = 'node'").select("hash", F.col("id").alias("node_id"), F.col("type").alias("node_type"), F.size(F.filter("children", lambda c: ~F.contains(c, F.lit(":")))).alias("entries"))  # entries stand without a field
    return _attached(bridge.where("role = 'node'"), held).select("line_id", "doc_pos", F.col("owner_pos").alias("node_pos"), "node_id", "node_type", "entries", "hash")


def relationships(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every relationship with both endpoints (null where absent)."""
    kind = objects.where("kind = 'relationship'").select("hash", F.col("type").alias("rel_type"))
    ends = objects.where("kind = 'endpoint'").select("hash", F.struct("id", "type").alias("end"))
    rel = _attached(bridge.where("role = 'relationship'"), kind).select("line_id", "occ", "doc_pos", F.col("owner_pos").alias("rel_pos"), "rel_type")
    sides = (
        _attached(bridge.where(F.col("role").isin("rel_source", "rel_target")), ends)
        .groupBy("line_id", F.col("parent_occ").alias("occ"))
        .agg(*[F.first(F.when(F.col("role") == r, F.col("end")), ignorenulls=True).alias(r) for r in ("rel_source", "rel_target")])
    )
    return rel.join(sides, ["line_id", "occ"], "left").select(
        "line_id", "doc_pos", "rel_pos", "rel_type", F.col("rel_source.id").alias("source_id"), F.col("rel_source.type").alias("source_type"), F.col("rel_target.id").alias("target_id"), F.col("rel_target.type").alias("target_type")
    )


def documents(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every document with its source and the number of its parts."""
    source = objects.where("kind = 'source'").select("hash", F.col("id").alias("source_id"), F.col("type").alias("source_type"))
    named = _attached(bridge.where("role = 'source'"), source).select("line_id", "doc_pos", "role", "hash", "source_id", "source_type")
    parts = bridge.where(F.col("role").isin("document", "node", "relationship")).select("line_id", "doc_pos", "role", "hash").unionByName(named, allowMissingColumns=True)
    return parts.groupBy("line_id", "doc_pos").agg(
        F.max("source_id").alias("source_id"),
        F.max("source_type").alias("source_type"),
        F.count(F.when(F.col("role") == "node", 1)).alias("nodes"),
        F.count(F.when(F.col("role") == "relationship", 1)).alias("relationships"),
        F.max(F.when(F.col("role") == "document", F.col("hash"))).alias("doc_hash"),
    )


def object_use(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every stored object with the number of its occurrences and of the lines it occurs in."""
    by_line = bridge.groupBy("hash", "line_id").agg(F.count(F.lit(1)).alias("n"))
    counted = by_line.groupBy("hash").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("lines"))
    return objects.join(counted, "hash").select("hash", "kind", "id", "type", "meta_key", "meta_value", "fields", "occurrences", "lines")


def occurrences(objects: DataFrame, bridge: DataFrame) -> DataFrame:
    """Every occurrence of every object with its parent, whatever its kind: the whole line can be put together from it."""
    held = objects.select("hash", "kind", "id", "type", "meta_key", "meta_value", "fields")
    return _attached(bridge, held).select("line_id", "occ", "parent_occ", "role", "field", "ordinal", "kind", "id", "type", "meta_key", "meta_value", "fields", "hash")
