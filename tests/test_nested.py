"""Nested lines into flat tables: against a plain brute-force walk, and shape by shape."""

import json

from graphloom.operators import nested
from graphloom.tables import table

SCHEMA = "line_id bigint, line string, part string, hash string"


def brute(line):
    """(doc_pos, owner, owner_pos, key) of the metadata entries of a line, written independently of the operator."""
    try:
        v = json.loads(line)
        v = json.loads(v) if isinstance(v, str) else v
    except (ValueError, TypeError):
        return set()
    out = set()
    docs = v if isinstance(v, list) else v["documents"] if isinstance(v, dict) and "documents" in v else [v]

    def keys(m):
        if isinstance(m, dict) and "key" in m and not set(m) - {"key", "value"}:
            return [m["key"]]
        if isinstance(m, dict):
            return list(m)
        return [e["key"] for e in m or [] if isinstance(e, dict) and e.get("key") is not None]

    for pos, doc in enumerate(docs):
        if not isinstance(doc, dict):
            continue
        body = doc.get("graph") or doc
        source = doc.get("source") or body.get("source")
        for i, n in enumerate(body.get("nodes") or []):
            out |= {(pos, "node", i, k) for k in keys((n or {}).get("metadata"))}
        for i, r in enumerate(body.get("relationships") or []):
            for end in ("source", "target"):
                e = (r or {}).get(end)
                if isinstance(e, dict):
                    out |= {(pos, f"rel_{end}", i, k) for k in keys(e.get("metadata"))}
        if isinstance(source, dict):
            out |= {(pos, "source", 0, k) for k in keys(source.get("metadata"))}
    return out


def entries(spark, lines):
    df = spark.createDataFrame([(i, s, "p", "h") for i, s in enumerate(lines)], SCHEMA)
    rows = nested.metadata_entries(*nested.shred(df)).where("key_ordinal = 0").collect()
    return [(r.line_id, r.doc_pos, r.owner, r.owner_pos, r.meta_key) for r in rows]


def test_shapes(spark):
    doc = {
        "nodes": [None, {"id": "a", "metadata": [None, {"key": "k"}, {"key": "k", "value": 2}, {"value": 3}, {"key": "m", "value": None}]}, {"id": "b", "metadata": {"x": 1, "y": None}}, {"id": "c", "metadata": {"key": "z", "value": 1}}],
        "relationships": [{"source": "a", "target": {"id": "b", "metadata": [{"key": "t"}]}, "type": "R"}, None],
        "source": {"source_id": "s", "metadata": {"key": "q"}},
    }
    lines = [
        json.dumps(doc), json.dumps(json.dumps(doc)), "  " + json.dumps({"graph": {"nodes": doc["nodes"]}, "source": doc["source"]}), json.dumps({"batch_index": 0, "documents": [None, doc, {}]}), json.dumps([doc, doc]),
        "", None, "null", "{broken", json.dumps("{broken"), "5", "[]", "NaN", json.dumps({"nodes": None, "relationships": [], "source": None}), json.dumps({"nodes": {"id": "solo", "metadata": {"w": 1}}}), "[" * 5000,
        json.dumps({"nodes": [{"id": "bad \ud800", "metadata": {"k\ud800": 1}}]}),
    ]
    got = entries(spark, lines)
    assert len(got) == len(set(got))
    for i, line in enumerate(lines):
        if i in (14, 16):
            continue
        assert {g[1:] for g in got if g[0] == i} == (brute(line) if i != 15 else set()), line
    assert (14, 0, "node", 0, "w") in got


def test_against_brute_force_on_the_table(spark, data):
    df = table(spark, data, "graph_jsonl")
    rows = nested.metadata_entries(*nested.shred(df)).where("key_ordinal = 0").collect()
    got = sorted((r.line_id, r.doc_pos, r.owner, r.owner_pos, r.meta_key) for r in rows)
    want = sorted((r.line_id, *e) for r in df.select("line_id", "line").collect() for e in brute(r.line))
    assert got == want


def test_objects_are_stored_once_and_children_link_to_parents(spark):
    doc = {"nodes": [{"id": "a", "type": "T", "metadata": [{"key": "k", "value": "v"}]}] * 3, "relationships": [{"source": {"id": "a", "type": "T"}, "target": "b", "type": "R"}], "source": {"source_id": "s"}}
    df = spark.createDataFrame([(1, json.dumps(doc), "", ""), (2, json.dumps(doc), "", "")], SCHEMA)
    objects, bridge = nested.shred(df)
    assert objects.where("kind = 'node'").count() == 1 and objects.where("kind = 'document'").count() == 1
    assert bridge.where("role = 'node'").count() == 6
    orphans = bridge.where("parent_occ > 0").join(bridge.selectExpr("line_id", "occ as parent_occ"), ["line_id", "parent_occ"], "left_anti")
    assert orphans.count() == 0
    rel = nested.relationships(objects, bridge).collect()
    assert {(r.source_id, r.source_type, r.target_id, r.target_type, r.rel_type) for r in rel} == {("a", "T", "b", None, "R")} and len(rel) == 2
    docs = nested.documents(objects, bridge).collect()
    assert {(r.line_id, r.source_id, r.nodes, r.relationships) for r in docs} == {(1, "s", 3, 1), (2, "s", 3, 1)}
    assert len({r.doc_hash for r in docs}) == 1
    assert nested.nodes(objects, bridge).count() == 6
    assert nested.object_use(objects, bridge).where("kind = 'metadata'").first().occurrences == 6


def test_empty_table(spark):
    objects, bridge = nested.shred(spark.createDataFrame([], SCHEMA))
    assert objects.count() == 0 and bridge.count() == 0


def shredded(line):
    """(object rows by hash, bridge rows) of one line, straight from the shredder."""
    s = nested._Shredder()
    s.line(1, nested.parse_line(line))
    return {r["hash"]: r for r in (dict(zip(nested._OBJECT, o)) for o in s.objects)}, [dict(zip(nested._BRIDGE, b)) for b in s.bridge]


def node_hash(node):
    _, bridge = shredded(json.dumps({"nodes": [node]}))
    return next(r["hash"] for r in bridge if r["role"] == "node")


def test_identity_covers_every_field():
    base = {"id": "a", "type": "T", "weight": 0.5, "tags": ["x", "y"], "deep": {"l": [{"k": 1}]}}
    assert node_hash(base) == node_hash(dict(reversed(base.items())))
    for change in ({"weight": 0.6}, {"weight": "0.5"}, {"tags": ["y", "x"]}, {"tags": None}, {"deep": {"l": [{"k": 2}]}}, {"id": None}, {"type": 5}, {"metadata": [{"key": "k"}]}, {"metadata": ["no entry"]}):
        assert node_hash({**base, **change}) != node_hash(base), change
    one, text = ({"id": "a", "metadata": [{"key": "k", "value": v}]} for v in (1, "1"))
    assert node_hash(one) != node_hash(text)


def test_nothing_of_a_line_is_lost():
    doc = {"nodes": [{"id": "n", "original_chunk_ids": ["c1", {"c": 2}], "metadata": [{"key": "k", "value": {"in": [1, {"deep": True}]}, "unit": "mm"}, "stray"]}, "odd"], "relationships": [{"source": 5, "target": "n", "type": "R", "metadata": {"w": [1]}}], "source": "plain", "run": {"at": "x"}}
    objects, bridge = shredded(json.dumps({"batch": 7, "meta": {"a": {"b": "leaf"}}, "documents": [doc, "loose"]}))
    everything = json.dumps([list(o.values()) for o in objects.values()])
    for word in ("c1", "deep", "mm", "stray", "odd", "leaf", "loose", "plain", '"w:', "batch", '\\"at\\"'):
        assert word in everything, word
    by_occ = {r["occ"]: r for r in bridge}
    for r in bridge:  # every child hash is a child of its parent's object
        if r["parent_occ"]:
            assert any(c.endswith(r["hash"]) for c in objects[by_occ[r["parent_occ"]]["hash"]]["children"]) or by_occ[r["parent_occ"]]["role"] == "line"
    assert {r["role"] for r in bridge} == {"line", "document", "node", "metadata", "field", "relationship", "rel_target", "source"}


def test_any_depth(spark):
    deep = "[" * 30_000 + "1" + "]" * 30_000
    line = '{"nodes": [{"id": "a", "metadata": [{"key": "k", "value": ' + deep + "}]}]}"
    assert entries(spark, [line, json.dumps(line)]) == [(0, 0, "node", 0, "k"), (1, 0, "node", 0, "k")]


def test_deep_decoder_reads_what_the_standard_one_reads():
    from graphloom.operators import jsonvalue

    good = ['{"a":[1,-2.50e+3,{"b":null,"c":[]}],"d":{},"e":"x\\u00e9\\"y","a":true}', " [ ] ", "0", '"s"', "[[],{},[{}]]", '{"a" : 1 , "b":[ 2 , 3 ]}']
    bad = ["", "[", "[1,]", "{,}", '{"a"}', '{"a":1,}', "[1 2]", "01", "1.", "nul", '"\n"', "[1]]", '{"a":1]', "NaN", "{1:2}", "-", "tru e"]
    for text in good:
        assert jsonvalue._decode_deep(text) == jsonvalue._decode(text)
    for text in bad:
        for read in (jsonvalue._decode_deep, jsonvalue._decode):
            try:
                read(text)
            except ValueError:
                continue
            raise AssertionError((read, text))
    assert jsonvalue.canonical_text(jsonvalue.decode(good[0])) == '{"a":true,"d":{},"e":"xé\\"y"}'
