import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import metadata as meta
from kelpie.functions import scalars, text, vectors
from kelpie.functions.metadata import patched, suffix_of
from kelpie.operators import filters


def test_tokens():
    assert text.fold_tokens("Café_au-lait ＡＢ ﬁn Σίσυφος") == ["cafe", "au", "lait", "ab", "fin", "σισυφος"]
    assert text.fold_tokens(None) == [] == text.fold_tokens("") == text.fold_tokens(" _ ")


def test_substring_count_and_trigrams(spark):
    df = spark.createDataFrame([("aaaa", "aaa"), (None, "abc"), ("ab", "abc"), ("xABCabc", "abc"), ("abc", "ab")], "t string, s string")
    got = df.select(text.substring_count(F.col("t"), F.col("s")).alias("n"), F.size(text.trigrams(F.col("t"))).alias("g")).collect()
    assert [(r.n, r.g) for r in got] == [(2, 2), (0, 0), (0, 0), (2, 5), (0, 1)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.l2norm(F.col("a")).alias("u"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[0].c == pytest.approx(0.96) and got[1].c == -1
    with pytest.raises(Exception, match="zero vector"):
        spark.createDataFrame([([0.0, 0.0],)], "a array<float>").select(vectors.l2norm(F.col("a"))).collect()
    bad = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), ([1.0],), ([1.0, 2.0],)], "v array<float>")
    assert [r[0] for r in bad.select(vectors.usable(F.col("v"), 2)).collect()] == [False] * 7 + [True]
    x = np.random.default_rng(0).standard_normal((1, 64)).astype(np.float32)
    x /= np.linalg.norm(x)
    row = spark.createDataFrame([(x[0].tolist(),)], "v array<float>").select(vectors.fp16("v").alias("h"), vectors.quantize(4)("v").alias("q")).first()
    assert np.linalg.norm(row.h) == pytest.approx(1, abs=1e-6)
    back = vectors.dequantised(row.q, 4, 64)
    assert len(row.q) == 8 + 32 and np.abs(back - x[0]).max() <= (x.max() - x.min()) / 30 + 1e-6


def test_suffix():
    keys = ["title", "a.b", "flag", "x", "tags", "bad", "obj", "none"]
    m = {"title": "T", "a.b": 1, "flag": True, "x": 1e-20, "tags": ["p", None, 2.0], "bad": [[1]], "obj": {}, "none": None}
    assert suffix_of(json.dumps(m), keys) == "\nT\n1\nTrue\n1e-20\np 2.0"
    assert suffix_of(None, keys) == suffix_of("[1]", keys) == suffix_of("{", keys) == ""


def test_merge_patch():
    assert patched({"a": 1, "b": {"x": 1, "y": 2}}, {"a": None, "b": {"x": None, "z": 3}}) == {"b": {"y": 2, "z": 3}}
    assert patched({"a": [1]}, {"a": {"b": None}}) == {"a": {}} and patched("x", [1]) == [1]


def test_scalars():
    assert [scalars.auto_nlist(n) for n in (0, 8192, 2_549_119, 10**9)] == [16, 16, 256, 1024]
    assert scalars.rescore_depth(10, 10**6) == 50 and scalars.rescore_depth(10, 10**6, 2) == 200 and scalars.rescore_depth(5000, 10**6) == 2000 and scalars.rescore_depth(10, 7) == 7


METADATA = ['{"k": 1}', '{"k": 1.0}', '{"k": true}', '{"k": "1"}', '{"k": null}', "{}", None, '{"k": [1,2]}', '{"k": {"a": 1}}', '{"k": "É"}', '{"k": "Abc 100%_"}', '{"k": 10}', '{"k": -2.5}', '{"k": false}', '{"a": {"b": "deep"}, "k": ""}', '{"k": "a"}']
FILTERS = [
    {"k": 1}, {"k": True}, {"k": "1"}, {"k": {"gte": 2}}, {"k": {"lt": "a"}}, {"k": {"lte": 1}}, {"k": {"gt": 1, "lt": 11}}, {"k": {"gte": "a"}}, {"k": [1, None]},
    {"k": {"in": ["1", 10]}}, {"k": {"contains": "1"}}, {"k": {"contains": ""}}, {"k": {"contains": "ABC"}}, {"k": {"contains": "é"}}, {"k": {"contains": "%_"}},
    {"k": {"contains_any": ["abc", 2]}}, {"a.b": "deep"}, {"k": {}}, {"k": {"eq": 1}}, {"doc_id": "3"}, {"doc_id": [3, "5"]}, {"k": None},
]


def sqlite_rows(filt):
    """The same filter by a database with dynamic types."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE r (id INTEGER, doc_id TEXT, metadata TEXT)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", [(i, str(i), m) for i, m in enumerate(METADATA)])
    where, bound = ["1"], []
    for key, wanted in filt.items():
        ops = wanted if isinstance(wanted, dict) else {"in": wanted} if isinstance(wanted, list) else {"eq": wanted}
        x = "doc_id" if key == "doc_id" else f"json_extract(metadata, '$.{key}')"
        fold = f"replace(lower({x}), char(0), '')"
        for op, b in ops.items():
            if op in ("eq", "gt", "gte", "lt", "lte"):
                where.append(f"{x} {dict(eq='=', gt='>', gte='>=', lt='<', lte='<=')[op]} ?")
                bound.append(b)
            elif op == "in":
                where.append(f"{x} IN ({','.join('?' * len(b))})")
                bound += b
            else:
                alternatives = b if op == "contains_any" else [b]
                where.append("(" + " OR ".join(f"instr({fold}, lower(?)) > 0" for _ in alternatives) + ")")
                bound += [str(v) for v in alternatives]
    return [r[0] for r in con.execute(f"SELECT id FROM r WHERE {' AND '.join(where)} ORDER BY id", bound)]


@pytest.mark.parametrize("filt", FILTERS, ids=str)
def test_filters_compare_like_dynamic_types(spark, filt):
    df = spark.createDataFrame([(i, str(i), m) for i, m in enumerate(METADATA)], "id int, doc_id string, metadata string")
    assert [r.id for r in df.where(filters.compile_filter(filt)).orderBy("id").collect()] == sqlite_rows(filt)


@pytest.mark.parametrize("filt", [{"k": {"like": 1}}, {"k": []}, {"k": [[1]]}, {"k": {"in": 1}}, {"k": {"contains_any": ["x"] * 257}}, {"doc_id": {"gt": 1}}, {"": 1}, {"a[": 1}, {'a"b': 1}], ids=str)
def test_filters_refuse(spark, filt):
    with pytest.raises(ValueError):
        filters.compile_filter(filt)


def test_sort_order(spark):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(METADATA)], "id int, metadata string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE r (id INTEGER, metadata TEXT)")
    con.executemany("INSERT INTO r VALUES (?, ?)", list(enumerate(METADATA)))
    for descending in (False, True):
        mine = [r.id for r in df.orderBy(*meta.sort_columns(F.col("metadata"), "k", descending), "id").collect()]
        assert mine == [r[0] for r in con.execute(f"SELECT id FROM r ORDER BY json_extract(metadata, '$.k') {'DESC' if descending else 'ASC'}, id")]


def test_idf_floor(spark):
    row = spark.range(1).select(scalars.idf(F.lit(900), F.lit(1000)).alias("a"), scalars.idf(F.lit(2000), F.lit(1000)).alias("b"), scalars.idf(F.lit(1), F.lit(1000)).alias("c")).first()
    assert row.a == row.b == 1e-6 and row.c == pytest.approx(math.log(999.5 / 1.5))
