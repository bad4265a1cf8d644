"""Columnar shredding of deeply nested records, and flat tables read off the level sequences.

A record is a tree of objects, arrays and scalars in which everything is optional. ``shred`` turns it into one column
for each leaf path. A column has an entry for every slot its path has in the record, with two levels:

* the *definition level* counts how much of the path exists at this slot: each object on it adds one, each array one
  for not being absent and one for having an element there, the value at the end one. So null elements and empty
  arrays keep their place;
* the *repetition level* tells at which array of the path the entry continues; 0 starts the record.

``objects`` rebuilds, from the levels alone, one flat table for each path that holds objects: an object stands where
the definition level of a column below it reaches the object's own level and the repetition level isn't deeper than
its last array. The positions in the arrays follow from counting repetition levels. So every object gets its pointer
and that of the object which holds it, and leaf values join their nearest object.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.jsontext import Number, denoted

#: A step of a path: a key, or ITEM for the elements of an array.
ITEM = None
_GONE = object()


class _Node:
    """A path of a record's own schema, and the kinds of value that were seen there."""

    __slots__ = ("step", "keys", "item", "is_object", "has_scalar")

    def __init__(self, step):
        self.step, self.keys, self.item, self.is_object, self.has_scalar = step, {}, ITEM, False, False


def schema_of(tree) -> _Node:
    """The paths that occur in a record, without recursion."""
    root = _Node("")
    todo = [(root, tree)]
    while todo:
        node, value = todo.pop()
        if isinstance(value, dict):
            node.is_object = True
            for key, child in value.items():
                if child is not None:
                    to = node.keys.get(key)
                    if to is None:
                        to = node.keys[key] = _Node(key)
                    todo.append((to, child))
        elif isinstance(value, list):
            if node.item is ITEM:
                node.item = _Node(ITEM)
            todo.extend((node.item, x) for x in value if x is not None)
        elif value is not None:
            node.has_scalar = True
    return root


def shred(tree) -> Iterator[tuple[tuple, bool, list[tuple[int, int, object]]]]:
    """(path, it ends in an object, entries) of each column; an entry is (repetition level, definition level, value).

    A path that ends in an object is the column of an object without any key, which else would leave no trace.
    """
    root = schema_of(tree)
    # entries: (value or _GONE, repetition level, definition level); depth counts the arrays of the path
    todo = [(root, (), 0, [(tree, 0, 0)])]
    while todo:
        node, path, depth, entries = todo.pop()
        if node.has_scalar:
            yield path, False, [(r, d + 1, v) if v is not _GONE and not isinstance(v, (dict, list)) else (r, d, None) for v, r, d in entries]
        if node.is_object:
            inside = [(v, r, d + 1) if isinstance(v, dict) else (_GONE, r, d) for v, r, d in entries]
            if not node.keys:
                yield path, True, [(r, d, None) for _, r, d in inside]
            for key, child in node.keys.items():
                todo.append((child, (*path, key), depth, [(x, r, d) if v is not _GONE and (x := v.get(key)) is not None else (_GONE, r, d) for v, r, d in inside]))
        if node.item is not ITEM:
            below: list = []
            for v, r, d in entries:
                if not isinstance(v, list):
                    below.append((_GONE, r, d))
                elif not v:
                    below.append((_GONE, r, d + 1))
                else:
                    for i, x in enumerate(v):
                        below.append((_GONE if x is None else x, r if i == 0 else depth + 1, d + 2))
            if node.item.has_scalar or node.item.is_object or node.item.item is not ITEM:
                todo.append((node.item, (*path, ITEM), depth + 1, below))
            else:
                yield (*path, ITEM), False, [(r, d, None) for _, r, d in below]


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def clean(text: str) -> str:
    """Unpaired surrogates can't be stored as UTF-8; each becomes U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def objects(columns: Iterable[tuple[tuple, bool, list]], with_fields: bool = True) -> dict[str, tuple[str, str, dict]]:
    """pointer -> (template, pointer of the holding object, {relative pointer: value}) from the level sequences.

    template is the pointer with ``*`` for positions: it names the flat table. The root object's pointer is empty.
    """
    found: dict[str, tuple[str, str, dict]] = {}
    seen: set[tuple] = set()
    for path, ends_in_object, entries in columns:
        # levels of the path's prefixes: definition level at which a prefix is an object, and its number of arrays
        holders = []
        level = depth = 0
        for k, step in enumerate(path):
            if step is ITEM:
                level, depth = level + 2, depth + 1
            else:
                level += 1
                holders.append((k, level, depth))
        if ends_in_object:
            holders.append((len(path), level + 1, depth))
        fresh = [h for h in holders if path[: h[0]] not in seen]
        seen.update(path[: h[0]] for h in fresh)
        own = holders[-1] if holders else None
        if not fresh and not (with_fields and own and not ends_in_object):
            continue
        parts = ["" if s is ITEM else "/" + _token(s) for s in path]
        template = ["/*" if s is ITEM else p for s, p in zip(path, parts)]
        at = [0] * (depth + 1)
        need = {h[0]: j for j, h in enumerate(holders)}
        fresh_set = {h[0] for h in fresh}
        full = level + 1  # definition level of a scalar at the end
        for rep, deep, value in entries:
            if rep:
                at[rep] += 1
                for r in range(rep + 1, depth + 1):
                    at[r] = 0
            else:
                at = [0] * (depth + 1)
            has_value = with_fields and own and not ends_in_object and deep == full
            if not has_value and not any(deep >= h[1] and rep <= h[2] for h in fresh):
                continue
            pointer, parent, arrays = "", "", 0
            for k in range(len(path) + 1):
                j = need.get(k)
                if j is not None:
                    if deep < holders[j][1]:
                        break
                    if k in fresh_set and rep <= holders[j][2]:
                        found.setdefault(pointer, ("".join(template[:k]), parent, {}))
                    parent = pointer
                if k < len(path):
                    if path[k] is ITEM:
                        arrays += 1
                        pointer += f"/{at[arrays]}"
                    else:
                        pointer += parts[k]
            if has_value and parent in found:
                found[parent][2][pointer[len(parent) :]] = value
    return found


def literal(value) -> str:
    """A scalar as JSON text, numbers as they were written."""
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def payload_tree(documents: list | None) -> dict:
    """The tree of a payload: its documents, with each metadata text replaced by the value it denotes."""
    for document in documents or ():
        if document:
            for record in (document.get("summary"), *(document.get("chunks") or ())):
                if record and record.get("metadata") is not None:
                    record["metadata"] = denoted(record["metadata"])
    return {"documents": documents}


def _slim(documents, texts: bool):
    """The documents without their vectors (and without texts and ids, where only structure is asked for)."""

    def record(r, *ids):
        kept = [r["metadata"].alias("metadata")] + [r[x].alias(x) for x in (*ids, "text") if texts]
        return F.when(r.isNotNull(), F.struct(*kept))

    def document(d):
        kept = [record(d["summary"], *[]).alias("summary"), F.transform(d["chunks"], lambda c: record(c, "id", "position")).alias("chunks")]
        return F.when(d.isNotNull(), F.struct(*kept, *([d["doc_id"].alias("doc_id")] if texts else [])))

    return F.transform(documents, document)


def nested_objects(payloads: DataFrame, with_fields: bool = True) -> DataFrame:
    """One row for each object of each payload: (ingest_id, table_path, path, parent_path[, fields]).

    ``payloads`` needs the columns ingest_id and documents; others are ignored. path is the object's JSON Pointer from
    the payload's root, parent_path that of the nearest object around it (empty for a document), table_path the path
    with ``*`` for positions, which names the flat table the object belongs to. fields maps the relative pointer of
    every scalar, and of scalars in arrays, to its JSON text.

    Null payloads, documents, summaries, chunks and metadata give no rows, nor do metadata that aren't valid JSON; an
    object with only null fields, or none, gives its row. Equal keys of one object: the last counts. A repeated payload
    row gives each object once: rows are made distinct after a partial aggregation on the map side. A null ingest_id
    stays null. Unpaired surrogates in keys become U+FFFD.
    """
    fields = ", fields map<string,string>" if with_fields else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), ([], [], [], [], [])
            for i in range(batch.num_rows):
                tree = payload_tree(batch.column(1)[i].as_py())
                ingest = ids[i].as_py()
                for pointer, (template, parent, values) in objects(shred(tree), with_fields).items():
                    if pointer:
                        out[0].append(ingest)
                        out[1].append(clean(template))
                        out[2].append(clean(pointer))
                        out[3].append(clean(parent))
                        if with_fields:
                            out[4].append([(clean(k), clean(literal(v))) for k, v in values.items()])
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays(arrays(out), schema=schema)
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(arrays(out), schema=schema)

    types = [pa.int64(), pa.string(), pa.string(), pa.string()] + ([pa.map_(pa.string(), pa.string())] if with_fields else [])
    schema = pa.schema(list(zip(["ingest_id", "table_path", "path", "parent_path", "fields"], types)))

    def arrays(out):
        return [pa.array(x, t) for x, t in zip(out, types)]

    found = payloads.select("ingest_id", _slim(F.col("documents"), with_fields).alias("documents")).mapInArrow(
        run, "ingest_id bigint, table_path string, path string, parent_path string" + fields
    )
    return found.dropDuplicates(["ingest_id", "path"]) if with_fields else found.distinct()


def levels(payloads: DataFrame) -> DataFrame:
    """The shredded columns themselves: (ingest_id, column_path, seq, rep_level, def_level, value as JSON text).

    column_path has ``*`` for array elements. Null and empty payloads give the columns of an empty record: none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ingest = batch.column(0)[i].as_py()
                rows = [
                    (ingest, clean("".join("/*" if s is ITEM else "/" + _token(s) for s in path)), k, r, d, None if v is None else clean(literal(v)))
                    for path, _, entries in shred(payload_tree(batch.column(1)[i].as_py()))
                    for k, (r, d, v) in enumerate(entries)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["ingest_id", "column_path", "seq", "rep_level", "def_level", "value"])

    return payloads.select("ingest_id", _slim(F.col("documents"), True).alias("documents")).mapInArrow(
        run, "ingest_id bigint, column_path string, seq bigint, rep_level int, def_level int, value string"
    )


#: Columns a flat table may have.
MOST_COLUMNS = 5000
_ITEM_OF = {"integer": "bigint", "number": "double", "boolean": "boolean"}


def flat_columns(found: DataFrame) -> DataFrame:
    """(table_path, name, kind, is_array): the columns of every flat table of ``nested_objects``, one row each.

    kind is integer, number or boolean where all values of a field are, else string. A field below an object is a
    scalar or an array of scalars: objects inside are tables of their own.
    """
    entries = found.select("table_path", F.explode("fields").alias("at", "value"))
    steps = F.split(F.substring("at", 2, 2**31 - 1), "/")
    kind = F.when(F.col("value").rlike("^-?[0-9]{1,18}$"), 1).when(F.col("value").rlike("^-?[0-9]"), 2).when(F.col("value").isin("true", "false"), 4).otherwise(8)
    own = entries.select("table_path", F.get(steps, F.lit(0)).alias("name"), kind.alias("kind"), (F.size(steps) > 1).alias("is_array"))
    seen = own.groupBy("table_path", "name").agg(F.bit_or("kind").alias("k"), F.max("is_array").alias("is_array"))
    of = F.when(F.col("k") == 1, "integer").when(F.col("k").isin(2, 3), "number").when(F.col("k") == 4, "boolean").otherwise("string")
    return seen.select("table_path", "name", of.alias("kind"), "is_array")


def _entries_of(name: str):
    """The entries of the map of fields that belong to a field, in the order of their positions."""

    def own(entry):
        return F.get(F.split(F.substring(entry["key"], 2, 2**31 - 1), "/"), F.lit(0)) == F.lit(name)

    return F.filter(F.map_entries("fields"), own)


def _reader(kind: str):
    def read(entry):
        v = entry["value"]
        return v.cast(_ITEM_OF[kind]) if kind in _ITEM_OF else F.coalesce(F.get_json_object(F.concat(F.lit("["), v, F.lit("]")), "$[0]"), v)

    return read


def flat_table(found: DataFrame, table_path: str) -> DataFrame:
    """One flat table with typed columns: ingest_id, path, parent_path, then a column for each field of its objects.

    Arrays of scalars are array columns, null elements left out. Column names are the field names, with a bar before
    names that clash with the first three or with one that differs only in case. An unknown path gives no rows.
    ValueError beyond MOST_COLUMNS columns.
    """
    own = found.where(F.col("table_path") == table_path)
    columns = flat_columns(own).orderBy("name").limit(MOST_COLUMNS + 1).collect()
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{table_path} has more than {MOST_COLUMNS} columns")
    taken, out = {"ingest_id", "path", "parent_path"}, []
    for c in columns:
        name = c.name.replace("~1", "/").replace("~0", "~")
        while name.casefold() in taken:
            name = "|" + name
        taken.add(name.casefold())
        entries = _entries_of(c.name)
        value = F.transform(entries, _reader(c.kind))
        out_value = F.when(F.size(entries) > 0, value) if c.is_array else F.get(value, F.lit(0))
        out.append(out_value.alias(name))
    return own.select("ingest_id", "path", "parent_path", *out)
