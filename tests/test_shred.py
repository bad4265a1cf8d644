import json
import random

import pytest

from kelpie.functions.jsontext import NotJson, denoted, parse
from kelpie.operators.shred import levels, nested_objects, objects, shred
from kelpie.sources.ingest import DOCUMENTS


def pointers(tree):
    out = {}

    def walk(v, path, parent):
        if isinstance(v, dict):
            out[path] = parent
            for k, x in v.items():
                walk(x, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", parent)

    walk(tree, "", "")
    return out


def leaves(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, path + "/" + k.replace("~", "~0").replace("/", "~1"))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}/{i}")
    elif v is not None:
        yield path, v


def test_round_trip_of_random_trees():
    rng = random.Random(3)

    def made(depth):
        r = rng.random()
        if depth == 0 or r < 0.25:
            return rng.choice([None, 1, "x", True, ""])
        if r < 0.6:
            return {rng.choice(["a", "b", "/", "~", "0", ""]): made(depth - 1) for _ in range(rng.randint(0, 3))}
        return [made(depth - 1) for _ in range(rng.randint(0, 3))]

    for _ in range(3000):
        tree = {"r": made(6)}
        found = objects(shred(tree))
        assert {k: v[1] for k, v in found.items()} == pointers(tree)
        assert {k + p: x for k, v in found.items() for p, x in v[2].items()} == dict(leaves(tree))


def test_levels_of_the_textbook_record():
    tree = {"links": {"forward": [20, 40, 60]}, "names": [{"langs": [{"code": "en-us"}, {"code": "en"}]}, None, {"langs": []}, {"langs": [{"code": "en-gb"}]}]}
    columns = {tuple("*" if s is None else s for s in path): [(r, d) for r, d, _ in entries] for path, _, entries in shred(tree)}
    # 1 the record, 2 and 3 the slot of names and its element, 4 the object, 5 and 6 the slot of langs, 7 the object, 8 the value
    assert columns[("names", "*", "langs", "*", "code")] == [(0, 8), (2, 8), (1, 3), (1, 5), (1, 8)]
    assert columns[("links", "forward", "*")] == [(0, 5), (1, 5), (1, 5)]


def test_json_text():
    assert denoted('"{\\"a\\": [1]}"') == {"a": ["1"]}
    assert denoted('"\\"[]\\""') == []
    for bad in ("", "{", "nope", "NaN", '{"a": 1,}', '"plain"', None):
        assert denoted(bad) is None
    assert parse("[1e400, 123456789012345678901234567890]") == ["1e400", "123456789012345678901234567890"]
    deep = denoted("[" * 20000 + '{"a": {}}' + "]" * 20000)
    assert len(objects(shred({"m": deep}))) == 3
    with pytest.raises(NotJson):
        parse("[" * 20000 + "}" + "]" * 20000)


CASES = [
    (1, None),
    (2, []),
    (3, [None, {"doc_id": None, "summary": None, "chunks": None}]),
    (4, [{"doc_id": "d", "summary": {"text": None, "vector": None, "metadata": None}, "chunks": [None, {"id": "c", "position": None, "text": "t", "vector": [0.0], "metadata": '{"a/b": [null, {"~": {}}], "a/b": [{}, {"x": "\\ud800"}]}'}]}]),
    (5, [{"doc_id": "e", "summary": {"text": "x", "vector": None, "metadata": json.dumps(json.dumps({"k": {"v": 1}}))}, "chunks": []}]),
    (6, [{"doc_id": "f", "summary": {"text": "x", "vector": None, "metadata": "{broken"}, "chunks": []}]),
    (None, [{"doc_id": "g", "summary": None, "chunks": []}]),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"ingest_id bigint, documents {DOCUMENTS}, path string, levels int")


def test_nested_objects(spark):
    df = frame(spark, [(*c, "clash", 1) for c in CASES + CASES[3:4]])
    rows = {(r.ingest_id, r.path, r.parent_path) for r in nested_objects(df, with_fields=False).collect()}
    m = "/documents/0/chunks/1/metadata"
    assert rows == {
        (3, "/documents/1", ""),
        (4, "/documents/0", ""), (4, "/documents/0/summary", "/documents/0"), (4, "/documents/0/chunks/1", "/documents/0"),
        (4, m, "/documents/0/chunks/1"), (4, m + "/a~1b/0", m), (4, m + "/a~1b/1", m),
        (5, "/documents/0", ""), (5, "/documents/0/summary", "/documents/0"), (5, "/documents/0/summary/metadata", "/documents/0/summary"),
        (5, "/documents/0/summary/metadata/k", "/documents/0/summary/metadata"),
        (6, "/documents/0", ""), (6, "/documents/0/summary", "/documents/0"),
        (None, "/documents/0", ""),
    }
    full = {(r.ingest_id, r.path): (r.table_path, r.fields) for r in nested_objects(df).collect()}
    assert full[(5, "/documents/0/summary/metadata/k")] == ("/documents/*/summary/metadata/k", {"/v": "1"})
    assert full[(4, m + "/a~1b/1")][1] == {"/x": '"�"'} or full[(4, m + "/a~1b/1")][1] == {"/x": '"\\ud800"'}
    assert full[(4, "/documents/0/chunks/1")][1]["/text"] == '"t"'
    assert levels(df).where("ingest_id = 5 and column_path like '%/k/v'").first().value == "1"


def test_empty_table(spark):
    df = frame(spark, [])
    assert nested_objects(df).count() == 0 and levels(df).count() == 0


def test_flat_tables_are_typed(spark):
    from kelpie.operators.shred import flat_columns, flat_table
    from kelpie.sources.ingest import DOCUMENTS

    meta = ['{"n": 1, "ok": true, "tags": ["a", null, "b"], "path": "x", "who": {"age": 1.5}}', '{"n": 2.5, "tags": [], "a/b": "q\\"", "N": "z"}', None]
    chunks = [{"id": f"c{k}", "position": k, "text": "t", "vector": None, "metadata": m} for k, m in enumerate(meta)]
    df = spark.createDataFrame([(1, [{"doc_id": "d", "summary": None, "chunks": chunks}])], f"ingest_id bigint, documents {DOCUMENTS}")
    found = nested_objects(df).cache()
    rows = flat_table(found, "/documents/*/chunks/*/metadata").orderBy("path").collect()
    assert [(r.ok, r.tags, r["|path"], r["a/b"], r.N, r["|n"]) for r in rows] == [(True, ["a", "b"], "x", None, None, 1.0), (None, None, None, 'q"', "z", 2.5)]
    assert rows[0].parent_path == "/documents/0/chunks/0" and rows[0].path == "/documents/0/chunks/0/metadata"
    who = flat_table(found, "/documents/*/chunks/*/metadata/who").collect()
    assert [(r.age, r.parent_path) for r in who] == [(1.5, "/documents/0/chunks/0/metadata")]
    assert flat_table(found, "/nowhere").count() == 0 and {r.kind for r in flat_columns(found).where("name = 'position'").collect()} == {"integer"}
    assert [r.position for r in flat_table(found, "/documents/*/chunks/*").orderBy("path").collect()] == [0, 1, 2]
