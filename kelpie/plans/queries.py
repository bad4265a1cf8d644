"""The queries of the core operators, and the SQL that gives the same rows.

Searches take every record whose id is divisible by 100 as a query, against all records. Scores come out rounded to 6
decimals; ranks are by the score rounded to 9, then by id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import metadata as meta
from kelpie.functions import scalars, text, vectors
from kelpie.operators import bm25, corpus, expand, filters, fusion, ivf, listing, shred, vector, writes
from kelpie.operators import search as front
from kelpie.plans import sqlparts as S
from kelpie.session import written
from kelpie.sources import embed, ingest
from kelpie.sources.tables import table
from kelpie.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIM = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- the tables as the operators read them


def records(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Records once each: a repeated row is equal in every column."""
    return table(spark, root, "records", *columns).dropDuplicates(["id"])


def vecs(spark: SparkSession, root: str) -> DataFrame:
    return vector.unit_rows(table(spark, root, "vecs", "id", "vec"), "id", "vec", DIM)


def asked(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) % 100 == 0)


def vector_queries(spark: SparkSession, root: str) -> DataFrame:
    return asked(vecs(spark, root)).select(F.col("id").alias("qid"), "vec")


def text_queries(spark: SparkSession, root: str) -> DataFrame:
    return asked(records(spark, root, "id", "text")).select(F.col("id").alias("qid"), F.coalesce("text", F.lit(" ")).alias("qtext"))


def tokenised(spark: SparkSession, root: str) -> DataFrame:
    """The token table, folded and cut once and read back: operators scan it several times."""
    return written(bm25.tokenised(records(spark, root, "id", "text")), "tokens")


def lists_of(v: DataFrame) -> np.ndarray:
    """Centroids of 32 lists, of fewer for a collection too small to be given an index."""
    return ivf.train(v, max(1, min(32, v.count() // 32)), DIM, least=1)


def scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), "rank", *more)


# --- problem 1

_P1 = r"""WITH RECURSIVE i AS (SELECT DISTINCT * FROM ingest_in), d AS (SELECT ingest_id, unnest(documents) AS d, unnest(range(len(documents))) AS a FROM i),
c AS (SELECT ingest_id, a, unnest(d.chunks) AS c, unnest(range(len(d.chunks))) AS b FROM d WHERE d IS NOT NULL),
o AS (SELECT ingest_id, '/documents/' || a || '/summary' AS path, '/documents/' || a AS parent_path, d.summary.metadata AS m FROM d WHERE d IS NOT NULL AND d.summary IS NOT NULL
 UNION ALL SELECT ingest_id, '/documents/' || a || '/chunks/' || b, '/documents/' || a, c.metadata FROM c WHERE c IS NOT NULL),
s AS (SELECT ingest_id, path, CASE WHEN json_valid(m) THEN m END AS m FROM o
 UNION ALL SELECT ingest_id, path, CASE WHEN json_valid(json_extract_string(m, '$')) THEN json_extract_string(m, '$') END FROM s WHERE json_type(m) = 'VARCHAR'),
t AS (SELECT s.ingest_id, s.path AS base, t.id, t.parent, t.key, t.type FROM s, json_tree(s.m) t WHERE json_type(s.m) IN ('OBJECT', 'ARRAY')),
p AS (SELECT ingest_id, base, id, type, base || '/metadata' AS path, base AS parent_path FROM t WHERE parent IS NULL
 UNION ALL SELECT t.ingest_id, t.base, t.id, t.type, p.path || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), CASE WHEN p.type = 'OBJECT' THEN p.path ELSE p.parent_path END FROM p JOIN t ON t.ingest_id = p.ingest_id AND t.base = p.base AND t.parent = p.id)
SELECT ingest_id, '/documents/' || a AS path, '' AS parent_path FROM d WHERE d IS NOT NULL UNION SELECT ingest_id, path, parent_path FROM o UNION SELECT ingest_id, path, parent_path FROM p WHERE type = 'OBJECT'"""


@query(_P1)
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return shred.nested_objects(table(spark, root, "ingest_in", "ingest_id", "documents"), with_fields=False).select("ingest_id", "path", "parent_path")


@query()
def p1_tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each flat table: one for each path that holds objects."""
    found = shred.nested_objects(table(spark, root, "ingest_in", "ingest_id", "documents"))
    return found.groupBy("table_path").agg(F.count("*").alias("objects"), F.sum(F.size("fields")).alias("fields"))


@query()
def p1_levels(spark: SparkSession, root: str) -> DataFrame:
    """The shredded columns: of each leaf path its entries, its values and its deepest levels."""
    found = shred.levels(table(spark, root, "ingest_in", "ingest_id", "documents"))
    return found.groupBy("column_path").agg(F.count("*").alias("entries"), F.count("value").alias("present"), F.max("rep_level").alias("rep_level"), F.max("def_level").alias("def_level"))


@query(_P1.split(",\no AS (")[0].replace("WITH RECURSIVE", "WITH") + " SELECT DISTINCT ingest_id, '/documents/' || a || '/chunks/' || b AS path, '/documents/' || a AS parent_path, c.id AS id, c.position::BIGINT AS position, c.text AS text FROM c WHERE c IS NOT NULL")
def p1_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The flat table of the chunks, typed, with the link to the document that holds each."""
    found = shred.nested_objects(table(spark, root, "ingest_in", "ingest_id", "documents"))
    return shred.flat_table(written(found, "objects"), "/documents/*/chunks/*").select("ingest_id", "path", "parent_path", "id", "position", "text")


# --- sources and sinks


@query(
    """WITH d AS (SELECT DISTINCT * FROM ingest_in), x AS (SELECT ingest_id, unnest(documents) AS d, unnest(range(len(documents))) AS d_at FROM d),
c AS (SELECT ingest_id, d.doc_id AS doc_id, d_at, unnest(d.chunks) AS c, unnest(range(len(d.chunks))) AS c_at FROM x WHERE d IS NOT NULL),
a AS (SELECT ingest_id, d.doc_id AS external_id, d.doc_id AS doc_id, 'summary' AS type, NULL::INT AS position, d.summary.text AS text, d.summary.metadata AS metadata, d_at, -1 AS c_at FROM x WHERE d.summary IS NOT NULL
 UNION ALL SELECT ingest_id, c.id, doc_id, 'chunk', coalesce(c.position, c_at), c.text, c.metadata, d_at, c_at FROM c WHERE c IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY ingest_id, external_id ORDER BY d_at DESC, c_at DESC) AS n, min(d_at * 1000000 + c_at) OVER (PARTITION BY ingest_id, external_id) AS place FROM a WHERE external_id IS NOT NULL)
SELECT ingest_id, external_id, doc_id, type, position, text, coalesce(metadata, '{}') AS metadata, place FROM n WHERE n = 1"""
)
def src_flatten(spark: SparkSession, root: str) -> DataFrame:
    flat = ingest.flatten(table(spark, root, "ingest_in"))
    return flat.select("ingest_id", "external_id", "doc_id", "type", "position", "text", "metadata", (F.col("place.d_at").cast("bigint") * 1000000 + F.col("place.c_at")).alias("place"))


@query(f"WITH {S.R} SELECT id, external_id, doc_id, type, position, text FROM r WHERE indexed = 1")
def src_records(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "indexed").where("indexed = 1").drop("indexed")


@query(f"WITH {S.R}, {S.U} SELECT u.id, round(u.vec[1], 6) AS first, round(list_sum(u.vec), 6) AS total FROM u JOIN r USING (id)")
def src_vecs_stream(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root).join(records(spark, root, "id"), "id").withColumn("vec", vectors.l2norm(F.col("vec")))
    return v.select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {S.V} SELECT id FROM v ORDER BY md5('0/' || id), id LIMIT 100")
def src_sample(spark: SparkSession, root: str) -> DataFrame:
    return ivf.sample(vecs(spark, root), 100).select("id")


@query()
def src_embed(spark: SparkSession, root: str) -> DataFrame:
    lacking = ivf.missing(records(spark, root, "id", "text"), vecs(spark, root))
    return embed.embedded(lacking, embed.hashed(DIM)).select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query("SELECT coll_name, count(*) AS n, count(text) AS texts FROM documents GROUP BY coll_name")
def src_parquet(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "coll_name", "text").groupBy("coll_name").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query(f"WITH {S.R}, {S.U} SELECT r.id, external_id, round(u.vec[1], 6) AS first FROM r LEFT JOIN u USING (id) WHERE indexed = 1")
def snk_export(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root).withColumn("vec", vectors.l2norm(F.col("vec")))
    return listing.export(records(spark, root, "id", "external_id", "doc_id", "type", "metadata", "indexed"), v).select("id", "external_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


# --- scalar functions


@query(f"WITH {S.U} SELECT id, round(sqrt({S.DOT.format(a='vec', b='vec')}), 9) AS length, round(vec[64], 6) AS last FROM u")
def fn_l2norm(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root).withColumn("vec", vectors.l2norm(F.col("vec")))
    return v.select("id", F.round(vectors.norm(F.col("vec")), 9).alias("length"), F.round(F.element_at("vec", -1), 6).alias("last"))


@query()
def fn_fp16(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root).withColumn("vec", vectors.fp16(vectors.l2norm(F.col("vec")).cast("array<float>")))
    return v.select("id", F.round(vectors.norm(F.col("vec")), 3).alias("length"))


@query(f"WITH {S.U} SELECT a.id, round(list_dot_product(a.vec, b.vec), 6) AS cosine FROM u a JOIN u b ON b.id = a.id + 1")
def fn_cosine(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return v.join(after, "id").select("id", F.round(vectors.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query(f"WITH {S.R} SELECT id, {S.fold('text')} AS folded FROM r")
def fn_fold(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "text").select("id", text.fold("text").alias("folded"))


@query(f"WITH {S.R}, {S.tok()} SELECT id, dl AS n, array_to_string(t, ' ') AS tokens FROM tok")
def fn_tokens(spark: SparkSession, root: str) -> DataFrame:
    return tokenised(spark, root).select("id", F.col("dl").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {S.R} SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i, 3))) AS gram FROM r WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\x7F]*')) GROUP BY gram")
def fn_trigram(spark: SparkSession, root: str) -> DataFrame:
    own = records(spark, root, "id", "text").where(F.col("text").rlike(r"(?s)\A[\x00-\x7F]*\z"))
    return own.select(F.explode(text.trigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query()
def fn_trigram_all(spark: SparkSession, root: str) -> DataFrame:
    """Trigrams of all texts, whatever their characters; fn_trigram and its SQL have those of ASCII texts only."""
    return text.trigram_counts(records(spark, root, "id", "text"))


@query(f"WITH {S.R}, m AS (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM r) SELECT id, coalesce(chr(10) || json_extract_string(m, '$.title'), '') || coalesce(chr(10) || array_to_string(list_filter(json_extract_string(m, '$.tags[*]'), lambda x: x IS NOT NULL), ' '), '') AS suffix FROM (SELECT id, m FROM m WHERE coalesce(json_type(m, '$.tags'), 'ARRAY') = 'ARRAY' AND json_exists(m, '$.tags')) UNION ALL SELECT id, coalesce(chr(10) || json_extract_string(m, '$.title'), '') FROM m WHERE m IS NULL OR NOT json_exists(m, '$.tags')")
def fn_ftsmeta(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "metadata").select("id", meta.fts_suffix(["title", "tags"])(F.col("metadata")).alias("suffix"))


_TITLE = "CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.title') END"


@query(f"WITH {S.R} SELECT id, coalesce(text, '') || coalesce(chr(10) || {_TITLE}, '') AS ranked FROM r")
def fn_bm25text(spark: SparkSession, root: str) -> DataFrame:
    own = records(spark, root, "id", "text", "metadata")
    return own.select("id", text.bm25_text(F.col("text"), meta.fts_suffix(["title"])(F.col("metadata"))).alias("ranked"))


@query(f"WITH {S.R} SELECT id, {S.typed('n')[0]} AS num, {S.typed('n')[1]} AS txt, {S.typed('tags')[1]} AS tags FROM r")
def fn_jsonpath(spark: SparkSession, root: str) -> DataFrame:
    own = records(spark, root, "id", "metadata")
    n, tags = meta.Value(F.col("metadata"), "n"), meta.Value(F.col("metadata"), "tags")
    return own.select("id", n.num.alias("num"), n.txt.alias("txt"), tags.txt.alias("tags"))


_PATCH = '{"lang": null, "seen": {"by": "import", "n": 2}, "src": "patched"}'


@query(f"WITH {S.R}, p AS (SELECT id, json_merge_patch(CASE WHEN json_valid(metadata) THEN metadata ELSE '{{}}' END, '{_PATCH}') AS m FROM r) SELECT id, json_extract_string(m, '$.src') AS src, json_extract_string(m, '$.lang') AS lang, json_extract_string(m, '$.seen.by') AS seen_by, json_extract_string(m, '$.title') AS title, len(json_keys(m)) AS keys FROM p")
def fn_mergepatch(spark: SparkSession, root: str) -> DataFrame:
    own = records(spark, root, "id", "metadata").select("id", meta.merge_patch(F.col("metadata"), F.lit(_PATCH)).alias("m"))
    at = [F.get_json_object("m", f"$.{p}").alias(n) for n, p in (("src", "src"), ("lang", "lang"), ("seen_by", "seen.by"), ("title", "title"))]
    return own.select("id", *at, F.size(F.json_object_keys("m")).cast("bigint").alias("keys"))


@query(f"WITH {S.R} SELECT id, sha256(external_id) AS hash FROM r")
def fn_sha256(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "external_id").select("id", scalars.sha256(F.col("external_id")).alias("hash"))


@query(f"WITH {S.index()} SELECT term, df, round({S.IDF}, 6) AS idf FROM df, stats")
def fn_idf(spark: SparkSession, root: str) -> DataFrame:
    t = tokenised(spark, root)
    joined = bm25.document_frequencies(t).join(F.broadcast(bm25.corpus_stats(t)))
    return joined.select("term", "df", F.round(scalars.idf(F.col("df"), F.col("total")), 6).alias("idf"))


_ANY = ["sensor", "pipeline"]
_MATCH = "WITH {0}, {1} SELECT id FROM tok WHERE {2}"


@query(_MATCH.format(S.R, S.tok(), "list_has_any(t, ['sensor', 'pipeline'])"))
def flt_match_or(spark: SparkSession, root: str) -> DataFrame:
    return tokenised(spark, root).where(F.arrays_overlap("tokens", F.array(*map(F.lit, _ANY)))).select("id")


@query(_MATCH.format(S.R, S.tok(), "list_has_all(t, ['sensor', 'pipeline'])"))
def flt_match_and(spark: SparkSession, root: str) -> DataFrame:
    return tokenised(spark, root).where(F.size(F.array_except(F.array(*map(F.lit, _ANY)), F.col("tokens"))) == 0).select("id")


@query(_MATCH.format(S.R, S.tok(), "list_has_any(t, ['sensor', 'pipeline'])").replace("SELECT id FROM tok", "SELECT id, len(list_filter(t, lambda x: x = 'sensor' OR x = 'pipeline')) AS n FROM tok"))
def fn_matchexpr(spark: SparkSession, root: str) -> DataFrame:
    own = tokenised(spark, root).where(F.arrays_overlap("tokens", F.array(*map(F.lit, _ANY))))
    return own.select("id", F.size(F.filter("tokens", lambda t: t.isin(_ANY))).alias("n"))


@query()
def fn_quantize(spark: SparkSession, root: str) -> DataFrame:
    return scored(vector.quantised_search(vector_queries(spark, root), vecs(spark, root), 10, DIM))


@query("SELECT coll_name, count(DISTINCT id) AS n, least(greatest(pow(2, round(log2(greatest(count(DISTINCT id), 1) / 8192.0::DOUBLE))), 16), 1024)::BIGINT AS nlist, greatest(1, least(greatest(50, 20), 2000, count(DISTINCT id)))::BIGINT AS depth FROM records GROUP BY coll_name")
def fn_autonlist(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "records", "coll_name", "id").groupBy("coll_name").agg(F.countDistinct("id").alias("n"))
    lists, depth = F.udf(scalars.auto_nlist, "bigint"), F.udf(lambda n: scalars.rescore_depth(10, n), "bigint")  # a row for each collection
    return own.select("coll_name", "n", lists("n").alias("nlist"), depth("n").alias("depth"))


# --- filters


def _filtered(name: str, filt: dict, condition: str, scope: str = "both") -> None:
    kind = {"both": "", "chunks": " AND type = 'chunk'", "summaries": " AND type = 'summary'"}[scope]

    def run(spark: SparkSession, root: str) -> DataFrame:
        return records(spark, root, "id", "doc_id", "type", "metadata", "indexed").where(filters.in_scope(scope, filt)).select("id")

    run.__name__ = name
    query(f"WITH {S.R} SELECT id FROM r WHERE indexed = 1{kind} AND coalesce({condition}, false)")(run)


_n, _src, _date, _title, _tags = (S.typed(k) for k in ("n", "src", "date", "title", "tags"))
_filtered("flt_indexed", {}, "true")
_filtered("flt_scope", {}, "true", "summaries")
_filtered("flt_eq", {"src": "wiki"}, f"{_src[1]} = 'wiki'", "chunks")
_filtered("flt_eq_number", {"n": {"eq": 434}}, f"{_n[0]} = 434")
_filtered("flt_range", {"date": {"gte": "2027-01-01", "lt": "2029-01-01"}}, f"{_date[1]} >= '2027-01-01' AND ({_date[1]} < '2029-01-01' OR {_date[0]} IS NOT NULL)")
_filtered("flt_range_number", {"n": {"gt": 500}}, f"({_n[0]} > 500 OR {_n[1]} IS NOT NULL)")
_filtered("flt_in", {"src": ["wiki", "blog", 3]}, f"{_src[1]} IN ('wiki', 'blog')")
_filtered("flt_contains", {"title": {"contains": "ARCHIVE"}}, f"contains({S.ascii_lower(_title[2])}, 'archive')")
_filtered("flt_contains_number", {"n": {"contains": 4}}, f"contains({_n[2]}, '4')")
_filtered("flt_contains_any", {"tags": {"contains_any": ["glaun", "dan", "X"]}}, f"(contains({S.ascii_lower(_tags[2])}, 'glaun') OR contains({S.ascii_lower(_tags[2])}, 'dan') OR contains({S.ascii_lower(_tags[2])}, 'x'))")
_filtered("flt_docid", {"doc_id": ["mail/archive-2031", "ticket/2028/00000001"]}, "doc_id IN ('mail/archive-2031', 'ticket/2028/00000001')", "chunks")
_filtered("flt_and", {"src": {"in": ["wiki", "mail"]}, "date": {"gt": "2028-01-01"}, "lang": "en"}, f"{_src[1]} IN ('wiki', 'mail') AND {_date[1]} > '2028-01-01' AND {S.typed('lang')[1]} = 'en'")


# --- joins


@query(f"WITH {S.R}, {S.V} SELECT r.id, doc_id, len(vec) AS dim FROM r JOIN v USING (id)")
def jn_rec_vec(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "doc_id").join(vecs(spark, root), "id").select("id", "doc_id", F.size("vec").cast("bigint").alias("dim"))


@query(f"WITH {S.R}, {S.V} SELECT id FROM r WHERE id NOT IN (SELECT id FROM v)")
def jn_vec_missing(spark: SparkSession, root: str) -> DataFrame:
    return ivf.missing(records(spark, root, "id"), vecs(spark, root)).select("id")


@query(f"WITH {S.R}, {S.V} SELECT id FROM v WHERE id IN (SELECT id FROM r)")
def jn_live_guard(spark: SparkSession, root: str) -> DataFrame:
    return vecs(spark, root).join(records(spark, root, "id"), "id", "left_semi").select("id")


@query(f"WITH {S.R}, {S.V} SELECT id FROM v WHERE id NOT IN (SELECT id FROM r)")
def jn_ghosts(spark: SparkSession, root: str) -> DataFrame:
    return ivf.ghosts(vecs(spark, root), records(spark, root, "id"))


@query(f"WITH {S.R} SELECT a.id AS hit, b.id AS sibling FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.type = 'chunk' AND a.external_id <> b.external_id WHERE a.id % 100 = 0")
def jn_siblings(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "metadata")
    hits = asked(r).select(F.col("id").alias("qid"), "id")
    return expand.siblings(hits, r).select(F.col("id").alias("hit"), F.col("sid").alias("sibling"))


@query(f"WITH {S.R} SELECT a.id, s.sid FROM r a LEFT JOIN (SELECT doc_id, min(id) AS sid FROM r WHERE type = 'summary' GROUP BY doc_id) s USING (doc_id) WHERE a.type <> 'summary'")
def jn_summary(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "metadata")
    return expand.summaries(r.select(F.col("id").alias("qid"), "id"), r).select("id", "sid")


# --- aggregates


@query(f"WITH {S.R} SELECT type, count(*) AS n FROM r WHERE indexed = 1 GROUP BY type")
def ag_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return listing.type_counts(records(spark, root, "id", "type", "indexed"))


@query(f"WITH {S.R} SELECT coll_name, count(DISTINCT doc_id) AS docs, count(*) FILTER (type = 'chunk') AS chunks, count(*) FILTER (type = 'summary') AS summaries FROM r GROUP BY coll_name")
def ag_stats(spark: SparkSession, root: str) -> DataFrame:
    return listing.stats(records(spark, root, "id", "doc_id", "type", "coll_name"), "coll_name")


@query(f"WITH {S.R} SELECT count(*) AS total FROM r WHERE indexed = 1 AND coalesce({_src[1]} = 'mail', false)")
def ag_total(spark: SparkSession, root: str) -> DataFrame:
    return listing.listed(records(spark, root), filt={"src": "mail"})[1]


@query(f"WITH {S.R}, {S.tok()}, {S.POST}, {S.DF} SELECT term, df FROM df")
def ag_df(spark: SparkSession, root: str) -> DataFrame:
    return bm25.document_frequencies(tokenised(spark, root))


@query(f"WITH {S.R}, {S.tok()}, {S.POST} SELECT id, term, tf FROM post")
def ag_tf(spark: SparkSession, root: str) -> DataFrame:
    return bm25.postings(tokenised(spark, root)).select("id", "term", "tf")


@query(f"WITH {S.R}, {S.tok()}, g AS (SELECT unnest(list_transform(range(1, dl), lambda i: t[i] || ' ' || t[i + 1])) AS pair FROM tok WHERE dl > 1) SELECT pair, count(*) AS n FROM g GROUP BY pair")
def ag_bigram(spark: SparkSession, root: str) -> DataFrame:
    pairs = bm25._pairs_of(F.col("tokens"))
    own = tokenised(spark, root).select(F.explode(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))).alias("pair"))
    return own.groupBy("pair").agg(F.count("*").alias("n"))


@query(f"WITH {S.R}, {S.tok()}, {S.STATS} SELECT total, round(avgdl, 6) AS avgdl FROM stats")
def ag_avgdl_exact(spark: SparkSession, root: str) -> DataFrame:
    return bm25.corpus_stats(tokenised(spark, root)).select("total", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {S.R}, {S.tok()}, {S.STATS} SELECT total, round(filled, 6) AS avgdl FROM stats")
def ag_avgdl_filled(spark: SparkSession, root: str) -> DataFrame:
    return bm25.filled_stats(tokenised(spark, root)).select("total", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT coalesce(max(id), 0) + 1 AS next_id FROM records")
def ag_maxid(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "records", "id").agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


@query("SELECT coll_name, count(DISTINCT id) AS n FROM jobs WHERE lower(status) IN ('pending', 'processing') GROUP BY coll_name")
def ag_jobs(spark: SparkSession, root: str) -> DataFrame:
    from kelpie.streaming.ingest import open_jobs

    return open_jobs(table(spark, root, "jobs", "id", "coll_name", "status"))


# --- retrieval by vector


@query(f"WITH {S.R}, {S.U}, l AS (SELECT u.* FROM u JOIN r USING (id) WHERE indexed = 1) {S.top(S.cosines('l'))}")
def rv_flat(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "records", "id", "type", "metadata", "doc_id", "indexed")
    return scored(vector.search(vector_queries(spark, root), r, vecs(spark, root), 10, filters.in_scope("both"), DIM))


def _vector_scope(name: str, scope: str, filt: dict, condition: str) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        r = table(spark, root, "records", "id", "type", "metadata", "doc_id", "indexed")
        return scored(vector.search(vector_queries(spark, root), r, vecs(spark, root), 10, filters.in_scope(scope, filt), DIM))

    run.__name__ = name
    query(f"WITH {S.R}, {S.U}, l AS (SELECT u.* FROM u JOIN r USING (id) WHERE indexed = 1 AND coalesce({condition}, false)) {S.top(S.cosines('l'))}")(run)


_vector_scope("rv_scope", "summaries", {}, "type = 'summary'")
_vector_scope("rv_filter", "chunks", {"src": "wiki", "date": {"gte": "2028-01-01"}}, f"type = 'chunk' AND {_src[1]} = 'wiki' AND {_date[1]} >= '2028-01-01'")
_vector_scope("rv_docid", "chunks", {"doc_id": "mail/archive-2031"}, "type = 'chunk' AND doc_id = 'mail/archive-2031'")


_GIVEN = f"""{S.U}, e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt({S.DOT.format(a='embedding', b='embedding')})) AS vec, label FROM embeddings), m AS (SELECT label, i, avg(vec[i]) AS x FROM e, range(1, 65) t(i) GROUP BY label, i),
cc AS (SELECT label AS list_id, list(x ORDER BY i) AS c FROM m GROUP BY label), sc AS (SELECT u.id, list_id, list_dot_product(u.vec, c) / sqrt(list_dot_product(c, c)) AS s FROM u, cc),
own AS (SELECT id, list_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, list_id) AS n FROM sc) WHERE n = 1),
pb AS (SELECT id AS qid, list_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, list_id) AS n FROM sc WHERE id % 100 = 0) WHERE n <= 3)"""


def _given_lists(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(vectors in lists, centroids): the lists around the mean directions of the labelled embeddings."""
    e = table(spark, root, "embeddings", "embedding", "label").select(vectors.l2norm(F.col("embedding")).alias("vec"), F.col("label").alias("list_id"))
    means = e.select("list_id", F.posexplode("vec").alias("i", "x")).groupBy("list_id", "i").agg(F.avg("x").alias("x"))
    rows = means.groupBy("list_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid")).orderBy("list_id").collect()  # a row for each label
    c = np.array([r.centroid for r in rows])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    of = [r.list_id for r in rows]
    v = vecs(spark, root)
    named = F.create_map(*[F.lit(x) for pair in enumerate(of) for x in pair])
    return ivf.assign(v, c, DIM).withColumn("list_id", named[F.col("list_id")]), ivf.centroid_table(v, c).withColumn("list_id", named[F.col("list_id")])


@query(f"WITH {_GIVEN} {S.top('(SELECT pb.qid, u.id, list_dot_product(q.vec, u.vec) AS score FROM pb JOIN own USING (list_id) JOIN u USING (id) JOIN u q ON q.id = pb.qid)')}")
def rv_ivf(spark: SparkSession, root: str) -> DataFrame:
    """The three nearest of given lists."""
    return scored(ivf.search(vector_queries(spark, root), *_given_lists(spark, root), 10, 3))


@query()
def rv_ivf_trained(spark: SparkSession, root: str) -> DataFrame:
    """Lists trained on the vectors, a quarter of them probed."""
    v = vecs(spark, root)
    centroids = lists_of(v)
    return scored(ivf.search(vector_queries(spark, root), ivf.assign(v, centroids, DIM), ivf.centroid_table(v, centroids), 10, max(1, len(centroids) // 4)))


_FEW = "SELECT id FROM r WHERE doc_id = 'ticket/2028/00000001'"


@query(f"WITH {S.R}, {S.U} {S.top(S.cosines(where=f'x.id IN ({_FEW})'))}")
def rv_ivf_tiny(spark: SparkSession, root: str) -> DataFrame:
    v = vecs(spark, root)
    few = records(spark, root, "id", "doc_id").where("doc_id = 'ticket/2028/00000001'").select("id")
    return scored(ivf.search_few(vector_queries(spark, root), ivf.assign(v, lists_of(v), DIM), few, 10))


@query(f"WITH {S.R}, {S.U}, e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt({S.DOT.format(a='embedding', b='embedding')})) AS vec FROM embeddings) {S.top('(SELECT a.id AS qid, b.id, list_dot_product(a.vec, b.vec) AS score FROM e a, e b WHERE a.id % 100 = 0 AND a.id <> b.id)')}")
def rv_embeddings(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return scored(vector.top_k(asked(e).select(F.col("id").alias("qid"), "vec"), e, 10, DIM, but_itself=True))


# --- retrieval by text


@query(f"WITH {S.index()} {S.top(S.single())}")
def rt_single(spark: SparkSession, root: str) -> DataFrame:
    return scored(bm25.single_stage(text_queries(spark, root), tokenised(spark, root)))


_PRUNE = """, qd AS (SELECT qid, term, pos, coalesce(df, 0) AS df FROM q LEFT JOIN df USING (term)),
pr AS (SELECT qid, term, pos, df, (df = 0 OR nth = 1 OR so_far <= greatest(1000, floor(0.02::DOUBLE * total))) AS kept FROM
 (SELECT *, sum(df) OVER w AS so_far, count(*) FILTER (df > 0) OVER w AS nth FROM qd WINDOW w AS (PARTITION BY qid ORDER BY df, pos ROWS UNBOUNDED PRECEDING)), stats)"""


@query(f"WITH {S.index()}{_PRUNE} SELECT qid, term, pos::INT AS pos, df, kept FROM pr")
def rt_prune(spark: SparkSession, root: str) -> DataFrame:
    return bm25.pruned_terms(text_queries(spark, root), tokenised(spark, root))


def _full(members: str) -> str:
    """The full score of members (qid, id)."""
    single = f"SELECT m.qid, m.id, sum({S.IDF} * {S.sat('p.tf', 'greatest(1, p.dl)', 'filled')}) AS s FROM {members} m JOIN q USING (qid) JOIN df USING (term) JOIN post p ON p.id = m.id AND p.term = q.term, stats GROUP BY m.qid, m.id"
    double = f"""SELECT m.qid, m.id, 0.2::DOUBLE * sum((wa.w + wb.w) / 2 * {S.sat('g.n', 'greatest(1, g.dl)', 'filled')}) AS s FROM {members} m JOIN qp USING (qid)
 JOIN w wa ON wa.term = qp.a JOIN w wb ON wb.term = qp.b JOIN big g ON g.id = m.id AND g.a = qp.a AND g.b = qp.b, stats GROUP BY m.qid, m.id"""
    return f"(SELECT m.qid, m.id, coalesce(x.s, 0) + coalesce(y.s, 0) AS score FROM {members} m LEFT JOIN ({single}) x USING (qid, id) LEFT JOIN ({double}) y USING (qid, id))"


_PAIRS = f""", w AS (SELECT term, {S.IDF} AS w FROM df, stats), bg AS (SELECT id, dl, t, unnest(range(1, dl)) AS i FROM tok WHERE dl > 1),
big AS (SELECT id, t[i] AS a, t[i + 1] AS b, count(*) AS n, any_value(dl) AS dl FROM bg GROUP BY id, t[i], t[i + 1]),
qp AS (SELECT DISTINCT id AS qid, t[i] AS a, t[i + 1] AS b FROM bg WHERE id % 100 = 0 AND i < 100 AND t[i] <> t[i + 1])"""
_SAME_DOC = "mem AS (SELECT a.id AS qid, b.id FROM r a JOIN r b USING (doc_id) WHERE a.id % 100 = 0)"


@query(f"WITH {S.index()}, {_SAME_DOC}{_PAIRS} {S.top(_full('mem'))}")
def rt_stage2(spark: SparkSession, root: str) -> DataFrame:
    return scored(bm25.full_score(text_queries(spark, root), _same_document(spark, root), tokenised(spark, root)))


@query(f"WITH {S.index()}, {_SAME_DOC}{_PAIRS} {S.top('(SELECT * FROM ' + _full('mem') + ' WHERE score > 0)')}")
def rt_direct(spark: SparkSession, root: str) -> DataFrame:
    return scored(bm25.direct(text_queries(spark, root), tokenised(spark, root), _same_document(spark, root)))


def _same_document(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root, "id", "doc_id")
    return asked(r).select(F.col("id").alias("qid"), "doc_id").join(r, "doc_id").select("qid", "id")


def _candidates(allowed: str = "") -> str:
    among = f"WHERE id IN ({allowed})" if allowed else ""
    return f"""{_PRUNE}, kq AS (SELECT qid, term, 1 AS qtf FROM pr WHERE kept),
c1 AS (SELECT qid, id FROM ({S.top(S.single(allowed, q='kq'), 500)})),
c2 AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS n FROM (SELECT qid, id FROM (SELECT qid, post.id, count(*) AS has FROM post JOIN q USING (term) {among} GROUP BY qid, post.id) JOIN (SELECT qid, count(*) AS need FROM q GROUP BY qid) USING (qid) WHERE has = need)) WHERE n <= 1000),
cand AS (SELECT * FROM c1 UNION SELECT * FROM c2)"""


_CANDIDATES = _candidates()


@query(f"WITH {S.index()}{_CANDIDATES} SELECT qid, id FROM cand")
def st_cand_union(spark: SparkSession, root: str) -> DataFrame:
    return bm25.candidates(text_queries(spark, root), tokenised(spark, root))


@query(f"WITH {S.index()}{_CANDIDATES}{_PAIRS} {S.top(_full('cand'))}")
def rt_two(spark: SparkSession, root: str) -> DataFrame:
    return scored(bm25.two_stage(text_queries(spark, root), tokenised(spark, root)))


_SUB = "sub AS (SELECT * FROM (VALUES (1, 'eclip'), (2, 'ensor'), (3, 'pipe'), (4, 'ab')) s(qid, token)), own AS (SELECT id, lower(coalesce(text, '')) AS low, greatest(length(coalesce(text, '')) - 2, 0) AS dl FROM r)"


@query(
    f"""WITH {S.R}, {_SUB}, st AS (SELECT count(*) AS total, avg(dl) AS avgdl FROM own),
hit AS (SELECT qid, id, dl, len(list_filter(range(1, length(low) - length(token) + 2), lambda i: substr(low, i, length(token)) = token)) AS tf FROM own JOIN sub ON contains(low, token) AND length(token) >= 3),
d AS (SELECT qid, count(*) AS df FROM hit GROUP BY qid)
{S.top(f"(SELECT qid, id, {S.IDF} * {S.sat('tf', 'dl', 'avgdl')} AS score FROM hit JOIN d USING (qid), st)", 20)}"""
)
def rt_trigram(spark: SparkSession, root: str) -> DataFrame:
    wanted = spark.createDataFrame([(1, "eclip"), (2, "ensor"), (3, "pipe"), (4, "ab")], "qid int, token string")
    return scored(bm25.trigram(wanted, records(spark, root, "id", "text"), 20))


@query()
def rt_trigram_texts(spark: SparkSession, root: str) -> DataFrame:
    """Substring search for all tokens of the query texts; rt_trigram and its SQL have four given tokens."""
    return scored(bm25.trigram(bm25.trigram_tokens(text_queries(spark, root)), records(spark, root, "id", "text"), 20))


@query(f"WITH {S.R.replace('SELECT DISTINCT * FROM records', 'SELECT DISTINCT * REPLACE (coalesce(text, ' + chr(39) * 2 + ') || coalesce(chr(10) || ' + _TITLE + ', ' + chr(39) * 2 + ') AS text) FROM records')}, {S.tok()}, {S.POST}, {S.DF}, {S.STATS}, {S.Q} {S.top(S.single())}")
def rt_metakeys(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root, "id", "text", "metadata")
    own = r.withColumn("text", text.bm25_text(F.col("text"), meta.fts_suffix(["title"])(F.col("metadata"))))
    asks = asked(own).select(F.col("id").alias("qid"), F.col("text").alias("qtext"))
    return scored(bm25.single_stage(asks, written(bm25.with_metadata(r, ["title"]), "tokens")))


# --- hybrid retrieval


def _legs(spark: SparkSession, root: str, depth: int = 100) -> tuple[DataFrame, DataFrame]:
    v = vector.top_k(vector_queries(spark, root), vecs(spark, root), depth, DIM)
    return v, bm25.single_stage(text_queries(spark, root), tokenised(spark, root), depth)


_LEGS = f"WITH {S.index()}, {S.U}, vl AS ({S.top(S.cosines(), 100, score='score')}), tl AS ({S.top(S.single(), 100, score='score')})"


def _fused(legs: str, score: str, k: int = 10) -> str:
    return f"{legs} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vrank NULLS LAST, trank NULLS LAST) AS rank FROM (SELECT qid, id, {score} AS score, a.rank AS vrank, b.rank AS trank FROM vl a FULL JOIN tl b USING (qid, id))) WHERE rank <= {k}"


@query(_fused(_LEGS, "coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0)"))
def rh_rrf(spark: SparkSession, root: str) -> DataFrame:
    return scored(fusion.reciprocal_rank(*_legs(spark, root)))


def _norm(leg: str) -> str:
    return f"(SELECT qid, id, rank, CASE WHEN max(score) OVER (PARTITION BY qid) > min(score) OVER (PARTITION BY qid) THEN (score - min(score) OVER (PARTITION BY qid)) / (max(score) OVER (PARTITION BY qid) - min(score) OVER (PARTITION BY qid)) ELSE 1 END AS score FROM {leg})"


@query(_fused(f"{_LEGS}", "0.3::DOUBLE * coalesce(a.score, 0) + 0.7::DOUBLE * coalesce(b.score, 0)").replace("FROM vl a FULL JOIN tl b", f"FROM {_norm('vl')} a FULL JOIN {_norm('tl')} b"))
def rh_relative(spark: SparkSession, root: str) -> DataFrame:
    return scored(fusion.relative(*_legs(spark, root), alpha=0.3))


# --- searches under a scope and a filter

_LATE = {"src": ["wiki", "mail"], "date": {"gte": "2027-06-01"}}
_ALLOWED = f"al AS (SELECT id FROM r WHERE indexed = 1 AND type = 'chunk' AND coalesce({_src[1]} IN ('wiki', 'mail') AND ({_date[1]} >= '2027-06-01'), false))"
_TEXT_LEG = f"""{S.index()}, {_ALLOWED}{_candidates('SELECT id FROM al')}{_PAIRS}, whole AS (SELECT qid, bool_and(kept) AS whole FROM pr GROUP BY qid),
tx AS (SELECT * FROM {S.single('SELECT id FROM al')} WHERE qid IN (SELECT qid FROM whole WHERE whole) UNION ALL SELECT * FROM {_full('cand')} WHERE qid IN (SELECT qid FROM whole WHERE NOT whole))"""


def _asks(spark: SparkSession, root: str, with_vectors: bool) -> DataFrame:
    t = text_queries(spark, root).where(F.size(text.tokens(F.col("qtext"))) > 0)
    if not with_vectors:
        return t.withColumn("vec", F.lit(None).cast("array<double>"))
    return t.join(vector_queries(spark, root), "qid")


def _searched(spark: SparkSession, root: str, request: front.Request, with_vectors: bool) -> DataFrame:
    r = records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "metadata", "indexed")
    return front.search(_asks(spark, root, with_vectors), r, vecs(spark, root), request, tokenised(spark, root), DIM)


@query(f"WITH {_TEXT_LEG} {S.top('tx')}")
def rt_filter(spark: SparkSession, root: str) -> DataFrame:
    """Text search in the chunks that a metadata filter allows; each query in one stage or two, as its tokens need."""
    return scored(_searched(spark, root, front.Request("text", scope="chunks", filter=_LATE), False))


@query(
    _fused(
        f"WITH {_TEXT_LEG}, {S.U}, both_of AS (SELECT DISTINCT q.qid FROM q JOIN u ON u.id = q.qid), l AS (SELECT * FROM u WHERE id IN (SELECT id FROM al)), vl AS (SELECT * FROM ({S.top(S.cosines('l'), 100, score='score')}) WHERE qid IN (SELECT qid FROM both_of)), tl AS (SELECT * FROM ({S.top('tx', 100, score='score')}) WHERE qid IN (SELECT qid FROM both_of))",
        "coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0)",
    )
)
def rh_filter(spark: SparkSession, root: str) -> DataFrame:
    """Hybrid search under the same scope and filter on both legs."""
    return scored(_searched(spark, root, front.Request("hybrid", scope="chunks", filter=_LATE), True))


# --- expansion


def _hits(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "metadata", "indexed")
    return vector.search(vector_queries(spark, root), r, vecs(spark, root), 3, filters.in_scope("both"), DIM).select("qid", "id"), r


_HITS = f"{S.R}, {S.U}, l AS (SELECT u.* FROM u JOIN r USING (id) WHERE indexed = 1), hits AS ({S.top(S.cosines('l'), 3)}), sib AS (SELECT h.qid, h.id, b.id AS sid, b.position FROM hits h JOIN r a ON a.id = h.id JOIN r b ON b.doc_id = a.doc_id AND b.type = 'chunk' AND b.external_id <> a.external_id)"


@query(f"WITH {_HITS} SELECT qid, id, sid, row_number() OVER (PARTITION BY qid, id ORDER BY position NULLS FIRST, sid)::INT AS place FROM sib")
def rx_sib_all(spark: SparkSession, root: str) -> DataFrame:
    return expand.all_siblings(*_hits(spark, root))


@query(f"WITH {_HITS} SELECT qid, id, sid, round(score, 6) AS score, place FROM (SELECT s.qid, s.id, s.sid, list_dot_product(q.vec, x.vec) AS score, row_number() OVER (PARTITION BY s.qid, s.id ORDER BY round(list_dot_product(q.vec, x.vec), 9) DESC, sid)::INT AS place FROM sib s JOIN u q ON q.id = s.qid JOIN u x ON x.id = s.sid) WHERE place <= 2")
def rx_sib_vec(spark: SparkSession, root: str) -> DataFrame:
    hits, r = _hits(spark, root)
    out = expand.nearest_siblings(hits, vector_queries(spark, root), r, vecs(spark, root), 2)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {_HITS}, {S.tok()}, {S.POST}, {S.DF}, {S.STATS}, {S.Q}{_PRUNE}, kq AS (SELECT qid, term, 1 AS qtf FROM pr WHERE kept), ts AS {S.single(q='kq')} SELECT qid, id, sid, round(score, 6) AS score, place FROM (SELECT s.qid, s.id, s.sid, score, row_number() OVER (PARTITION BY s.qid, s.id ORDER BY round(score, 9) DESC, sid)::INT AS place FROM sib s JOIN ts ON ts.qid = s.qid AND ts.id = s.sid) WHERE place <= 2")
def rx_sib_text(spark: SparkSession, root: str) -> DataFrame:
    hits, r = _hits(spark, root)
    t = tokenised(spark, root)
    kept = bm25.pruned_terms(text_queries(spark, root), t).where("kept").groupBy("qid").agg(F.array_join(F.collect_list("term"), " ").alias("qtext"))
    own = expand.siblings(hits, r).select("qid", F.col("sid").alias("id"))
    scores = bm25.member_scores(kept, own, t)
    return expand.matching_siblings(hits, scores, r, 2).withColumn("score", F.round("score", 6))


@query(f"WITH {_HITS} SELECT h.qid, h.id, s.sid FROM hits h JOIN r a ON a.id = h.id LEFT JOIN (SELECT doc_id, min(id) AS sid FROM r WHERE type = 'summary' GROUP BY doc_id) s ON s.doc_id = a.doc_id WHERE a.type <> 'summary'")
def rx_summary(spark: SparkSession, root: str) -> DataFrame:
    return expand.summaries(*_hits(spark, root))


@query(f"WITH {_HITS} SELECT h.qid, h.id, a.doc_id, a.type, a.position, a.text FROM hits h JOIN r a ON a.id = h.id")
def jn_hydrate(spark: SparkSession, root: str) -> DataFrame:
    return expand.hydrate(*_hits(spark, root)).select("qid", "id", "doc_id", "type", "position", "text")


@query(f"WITH {_HITS} SELECT h.qid, a.doc_id, count(*) AS n FROM hits h JOIN r a ON a.id = h.id GROUP BY h.qid, a.doc_id HAVING count(*) > 1")
def ag_repeat_docs(spark: SparkSession, root: str) -> DataFrame:
    return expand.hydrate(*_hits(spark, root)).groupBy("qid", "doc_id").agg(F.count("*").alias("n")).where("n > 1")


# --- listing


@query(f"WITH {S.R} SELECT id, {_n[0]} AS n, {_n[1]} AS t FROM r WHERE indexed = 1 AND coalesce({_src[1]} = 'wiki', false) ORDER BY CASE WHEN {_n[0]} IS NOT NULL THEN 1 WHEN {_n[1]} IS NOT NULL THEN 2 END DESC NULLS LAST, {_n[0]} DESC NULLS LAST, {_n[1]} DESC NULLS LAST, id LIMIT 50 OFFSET 20")
def ls_list(spark: SparkSession, root: str) -> DataFrame:
    page, _ = listing.listed(records(spark, root), "both", {"src": "wiki"}, "-n", 50, 20)
    v = meta.Value(F.col("metadata"), "n")
    return page.select("id", v.num.alias("n"), v.txt.alias("t"))


@query(f"WITH {S.R} SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY type DESC, position NULLS FIRST, id) AS ids FROM r WHERE doc_id IS NOT NULL GROUP BY doc_id")
def ls_doc(spark: SparkSession, root: str) -> DataFrame:
    found = listing.document(records(spark, root, "id", "doc_id", "type", "position", "text", "metadata"))
    return found.select("doc_id", F.array_join(F.transform("records", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query(f"WITH {S.R} SELECT count(DISTINCT doc_id) AS docs, count(*) FILTER (type = 'chunk') AS chunks, count(*) FILTER (type = 'summary') AS summaries FROM r")
def ls_stats(spark: SparkSession, root: str) -> DataFrame:
    return listing.stats(records(spark, root, "id", "doc_id", "type"))


# --- writes

_NEW = _SQL["src_flatten"].split("SELECT ingest_id, external_id, doc_id, type, position, text, coalesce")[0]


@query(
    _NEW
    + f""", f AS (SELECT * FROM n WHERE n = 1), g AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY ingest_id DESC, place DESC) AS m FROM f), z AS (SELECT * FROM g WHERE m = 1), {S.R}
SELECT id, external_id, doc_id, type, position, text, metadata FROM r WHERE external_id IS NULL OR external_id NOT IN (SELECT external_id FROM z)
UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY ingest_id, place, external_id), external_id, doc_id, type, position, text, coalesce(metadata, '{{}}') FROM z"""
)
def wr_upsert(spark: SparkSession, root: str) -> DataFrame:
    old = records(spark, root, "id", "external_id", "doc_id", "type", "position", "text", "metadata")
    return writes.upsert(old, ingest.flatten(table(spark, root, "ingest_in")), ["ingest_id", "place", "external_id"])


@query(f"WITH {S.R} SELECT id FROM r WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM r WHERE id % 100 = 0 AND doc_id IS NOT NULL)")
def wr_delete_doc(spark: SparkSession, root: str) -> DataFrame:
    r = records(spark, root, "id", "doc_id")
    return writes.delete_documents(r, asked(r).select("doc_id")).select("id")


@query(f"WITH {S.R}, p AS (SELECT id, CASE WHEN doc_id = 'mail/archive-2031' THEN json_merge_patch(CASE WHEN json_valid(metadata) THEN metadata ELSE '{{}}' END, '{_PATCH}') ELSE metadata END AS m FROM r) SELECT id, CASE WHEN json_valid(m) THEN json_extract_string(m, '$.src') END AS src, CASE WHEN json_valid(m) THEN json_extract_string(m, '$.lang') END AS lang FROM p")
def wr_patch(spark: SparkSession, root: str) -> DataFrame:
    import json

    r = records(spark, root, "id", "doc_id", "type", "metadata")
    out = writes.patch(r, json.loads(_PATCH), writes.of_document("mail/archive-2031"))
    return out.select("id", F.get_json_object("metadata", "$.src").alias("src"), F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT name, dim, bit_width, coalesce(json_extract_string(index_config, '$.nlist')::INT, 0) AS nlist, len(coalesce(fts_keys, [])) AS keys FROM collection_catalog")
def wr_listcol(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "collection_catalog", "name", "dim", "bit_width", "index_config", "fts_keys")
    nlist = F.coalesce(F.get_json_object("index_config", "$.nlist").cast("int"), F.lit(0))
    return c.select("name", "dim", "bit_width", nlist.alias("nlist"), F.when(F.col("fts_keys").isNull(), 0).otherwise(F.size("fts_keys")).cast("bigint").alias("keys"))


@query(f"WITH {_GIVEN} SELECT id, list_id FROM own")
def ix_assign(spark: SparkSession, root: str) -> DataFrame:
    return _given_lists(spark, root)[0].select("id", "list_id")


# --- set operations


@query(f"WITH {S.R}, {S.V} SELECT id FROM r EXCEPT SELECT id FROM v")
def st_except(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id").select("id").exceptAll(vecs(spark, root).select("id"))


@query(f"WITH {S.R}, {S.V} SELECT id FROM r WHERE type = 'chunk' INTERSECT SELECT id FROM v")
def st_intersect(spark: SparkSession, root: str) -> DataFrame:
    return records(spark, root, "id", "type").where("type = 'chunk'").select("id").intersect(vecs(spark, root).select("id"))


@query("SELECT DISTINCT id FROM vecs WHERE id IS NOT NULL")
def st_unique(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "vecs", "id").where("id is not null").distinct()


# --- measures and corpus shaping


@query()
def ev_recall(spark: SparkSession, root: str) -> DataFrame:
    v, asks = vecs(spark, root), vector_queries(spark, root)
    centroids = lists_of(v)
    hits = ivf.search(asks, ivf.assign(v, centroids, DIM), ivf.centroid_table(v, centroids), 10, 8)
    return corpus.recall(hits, vector.top_k(asks, v, 10, DIM)).select(F.round("recall", 6).alias("recall"))


@query(f"WITH {S.index()}, h AS ({S.top(S.single())}) SELECT round(avg((t.qid IN (SELECT qid FROM h WHERE h.id = h.qid))::INT), 6) AS rate FROM (SELECT DISTINCT qid FROM q) t")
def ev_texthit(spark: SparkSession, root: str) -> DataFrame:
    asks = text_queries(spark, root)
    t = tokenised(spark, root)
    targets = bm25.query_terms(asks).select("qid").distinct().withColumn("target", F.col("qid"))
    return corpus.target_rate(bm25.single_stage(asks, t), targets).select(F.round("rate", 6).alias("rate"))


@query("SELECT event_type, median(value) AS median, max(value) - min(value) AS band FROM events GROUP BY event_type")
def ev_band(spark: SparkSession, root: str) -> DataFrame:
    return corpus.band(table(spark, root, "events", "event_type", "value"), "value", "event_type")


@query(
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT *, greatest(1, least(floor((n + 1) * 95 / 100.0::DOUBLE), n - 1)) AS lo FROM o)
SELECT event_type, round(sum(CASE WHEN n = 1 THEN value WHEN i = lo THEN value * (1 - ((n + 1) * 95 - lo * 100) / 100.0::DOUBLE) WHEN i = lo + 1 THEN value * (((n + 1) * 95 - lo * 100) / 100.0::DOUBLE) ELSE 0 END), 6) AS value FROM p GROUP BY event_type"""
)
def ev_percentile(spark: SparkSession, root: str) -> DataFrame:
    found = corpus.exclusive_percentile(table(spark, root, "events", "event_type", "value"), "value", 95, "event_type")
    return found.select("event_type", F.round("value", 6).alias("value"))


_W = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_W}+'), lambda w: w <> '')"


_CLOSING = "('.', '!', '?', ':', ';', ',', '\"', '”', ')', chr(39), ']')"
_LINES = f"""ln AS (SELECT doc_id, i, line, len({_words('line')}) <= 10 AND right(line, 1) NOT IN {_CLOSING} AS heading FROM
 (SELECT doc_id, i, regexp_replace(line, '^{_W}+|{_W}+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)) WHERE line <> '')"""
# a line's block is told by the number of plain lines before it; its headings have the same number
_SPLIT = f"""{_LINES}, hd AS (SELECT doc_id, min(i) AS first FROM ln WHERE heading GROUP BY doc_id),
bk AS (SELECT *, count(*) FILTER (NOT heading) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ln LEFT JOIN hd USING (doc_id)),
le AS (SELECT doc_id, i, line FROM bk WHERE first IS NULL OR i < first),
bo AS (SELECT doc_id, b, string_agg(line, chr(10) ORDER BY i) AS block FROM bk WHERE first IS NOT NULL GROUP BY doc_id, b HAVING count(*) FILTER (NOT heading AND i > first) > 0)"""


@query(f"SELECT doc_id, array_to_string({_words('text')}[1:300], ' ') AS summary FROM documents")
def dp_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", corpus.lead_summary(F.col("text")).alias("summary"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (heading) AS headings FROM ln GROUP BY doc_id")
def dp_headings(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.explode(corpus.lines(F.col("text"))).alias("line"))
    return own.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(corpus.is_heading(F.col("line")).cast("bigint")).alias("headings"))


@query(f"WITH {_SPLIT} SELECT doc_id, 'lead' AS part, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS place, line AS block FROM le UNION ALL SELECT doc_id, 'body', row_number() OVER (PARTITION BY doc_id ORDER BY b)::INT, block FROM bo")
def dp_split(spark: SparkSession, root: str) -> DataFrame:
    lead, body = corpus.lead_and_body(F.col("text"))
    own = table(spark, root, "documents", "doc_id", "text").select("doc_id", lead.alias("lead"), body.alias("body"))
    parts = [own.select("doc_id", F.lit(p).alias("part"), F.posexplode(p).alias("place", "block")) for p in ("lead", "body")]
    return parts[0].unionByName(parts[1]).select("doc_id", "part", (F.col("place") + 1).alias("place"), "block")


#: The shape of the articles in the test tables: a twentieth of the usual sizes, since their longest text has some 370 words.
SMALL = {"lead": 3, "body": 120, "close": 40, "tail": 10}


def _windows(close: int, tail: int) -> str:
    """The greedy windows of the body blocks, block by block."""
    return f"""{_SPLIT}, nb AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS n, len({_words('block')}) AS w, block FROM bo),
wi AS (SELECT doc_id, n, 0 AS win, w AS so_far FROM nb WHERE n = 1 UNION ALL SELECT nb.doc_id, nb.n, CASE WHEN so_far >= {close} THEN win + 1 ELSE win END, CASE WHEN so_far >= {close} THEN w ELSE so_far + w END FROM wi JOIN nb ON nb.doc_id = wi.doc_id AND nb.n = wi.n + 1),
wt AS (SELECT doc_id, win, sum(w)::BIGINT AS words, string_agg(block, chr(10) || chr(10) ORDER BY n) AS text FROM wi JOIN nb USING (doc_id, n) GROUP BY doc_id, win),
wl AS (SELECT *, max(win) OVER (PARTITION BY doc_id) AS last FROM wt),
wm AS (SELECT doc_id, CASE WHEN win = last AND win > 0 AND words < {tail} THEN win - 1 ELSE win END AS win, win AS part, words, text FROM wl),
ch AS (SELECT doc_id, win, sum(words)::BIGINT AS words, string_agg(text, chr(10) || chr(10) ORDER BY part) AS text FROM wm GROUP BY doc_id, win)"""


@query(f"WITH RECURSIVE {_windows(SMALL['close'], SMALL['tail'])} SELECT doc_id, win::INT AS n, words, text AS chunk FROM ch")
def dp_chunks(spark: SparkSession, root: str) -> DataFrame:
    """All windows of every body, none left out."""
    _, body = corpus.lead_and_body(F.col("text"))
    own = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.posexplode(corpus.windows(body, SMALL["close"], SMALL["tail"], None)).alias("n", "chunk"))
    return own.select("doc_id", "n", F.size(corpus.words(F.col("chunk"))).cast("bigint").alias("words"), "chunk")


_SHAPED = f"""WITH RECURSIVE {_windows(SMALL['close'], SMALL['tail'])}, lw AS (SELECT doc_id, sum(len({_words('line')})) AS n, string_agg(line, ' ' ORDER BY i) AS lead FROM le GROUP BY doc_id), bw AS (SELECT doc_id, sum(w) AS n FROM nb GROUP BY doc_id),
ti AS (SELECT doc_id, arg_min(line, i) AS title FROM ln GROUP BY doc_id), nw AS (SELECT doc_id FROM ch GROUP BY doc_id HAVING count(*) >= 2),
el AS (SELECT doc_id, title, lead FROM lw JOIN bw USING (doc_id) JOIN ti USING (doc_id) JOIN nw USING (doc_id) WHERE lw.n >= {SMALL['lead']} AND bw.n >= {SMALL['body']} AND NOT starts_with(title, 'List of')),
sh AS (SELECT 'w' || doc_id AS id, doc_id, 'summary' AS kind, title, array_to_string({_words('lead')}[1:300], ' ') AS text FROM el UNION ALL SELECT 'w' || doc_id || '#' || win, doc_id, 'chunk', title, text FROM el JOIN ch USING (doc_id) WHERE win < 10)"""


def _articles(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "documents", "doc_id", "text")
    return corpus.shaped(own.select("doc_id", "text", F.get(corpus.lines(F.col("text")), F.lit(0)).alias("title")), **SMALL)


@query(f"{_SHAPED} SELECT * FROM sh")
def dp_shape(spark: SparkSession, root: str) -> DataFrame:
    """The records of the documents that make an article; a document's title is its first line."""
    return _articles(spark, root)


@query(
    f"""{_SHAPED}, en AS (SELECT doc_id FROM sh WHERE kind = 'chunk' GROUP BY doc_id HAVING count(*) >= 3),
pa AS (SELECT doc_id, id, unnest(string_split(text, chr(10))) AS p FROM sh WHERE kind = 'chunk' AND doc_id IN (SELECT doc_id FROM en)),
se AS (SELECT doc_id, id AS target, unnest(string_split(regexp_replace(p, '([.!?]){_W}+', '\\1' || chr(10), 'g'), chr(10))) AS qtext FROM pa WHERE p = '' OR len({_words('p')}) > 10 OR right(p, 1) IN {_CLOSING})
SELECT 'summary' AS kind, doc_id, id AS target, title AS qtext FROM sh WHERE kind = 'summary'
UNION ALL SELECT 'indoc', doc_id, target, qtext FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(target || '/' || qtext), target, qtext) AS n FROM se WHERE len({_words('qtext')}) BETWEEN 8 AND 40) WHERE n = 1"""
)
def dp_queries(spark: SparkSession, root: str) -> DataFrame:
    """Titles aimed at summaries, and sentences aimed at the chunk they stand in."""
    return corpus.made_queries(written(_articles(spark, root), "articles"))


@query(f"WITH {S.R} SELECT external_id, id FROM (SELECT id, trim(external_id) AS external_id, row_number() OVER (PARTITION BY trim(external_id) ORDER BY id) AS n FROM r WHERE trim(external_id) <> '' AND regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]')) WHERE n = 1")
def dp_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Of records delivered again under the same key the first with a text."""
    return corpus.first_by_key(table(spark, root, "records", "id", "external_id", "text"), "external_id", "id", "text").select("external_id", "id")


@query(
    f"""WITH RECURSIVE {S.R}, c AS (SELECT coll_name, doc_id, count(*) AS n, row_number() OVER (PARTITION BY coll_name ORDER BY doc_id NULLS FIRST) AS i FROM r GROUP BY coll_name, doc_id),
b AS (SELECT coll_name, doc_id, i, n AS held, 0 AS batch FROM c WHERE i = 1
 UNION ALL SELECT c.coll_name, c.doc_id, c.i, CASE WHEN held >= 250 THEN n ELSE held + n END, CASE WHEN held >= 250 THEN batch + 1 ELSE batch END FROM b JOIN c ON c.coll_name = b.coll_name AND c.i = b.i + 1)
SELECT coll_name, doc_id, batch::BIGINT AS batch FROM b"""
)
def dp_batch_docs(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "records", "id", "coll_name", "doc_id").distinct().groupBy("coll_name", "doc_id").agg(F.count("*").alias("n"))
    return corpus.batches(counts, "coll_name", "doc_id")


# --- rankings


@query(f"{_LEGS} SELECT qid, id, rank FROM tl")
def wn_rank_leg(spark: SparkSession, root: str) -> DataFrame:
    return bm25.single_stage(text_queries(spark, root), tokenised(spark, root), 100).select("qid", "id", "rank")


@query(f"{_LEGS} SELECT qid, id, round(score, 6) AS score FROM {_norm('tl')}")
def wn_minmax(spark: SparkSession, root: str) -> DataFrame:
    leg = bm25.single_stage(text_queries(spark, root), tokenised(spark, root), 100)
    return fusion.normalised(leg).select("qid", "id", F.round("score", 6).alias("score"))


@query(f"WITH {S.U}, e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt({S.DOT.format(a='embedding', b='embedding')})) AS vec, label FROM embeddings), m AS (SELECT label, i, avg(vec[i]) AS x FROM e, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label) SELECT qid, list_id FROM (SELECT u.id AS qid, label AS list_id, row_number() OVER (PARTITION BY u.id ORDER BY round(list_dot_product(u.vec, c) / sqrt(list_dot_product(c, c)), 9) DESC, label) AS n FROM u, c WHERE u.id % 100 = 0) WHERE n <= 3")
def wn_nprobe(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings", "embedding", "label").select(vectors.l2norm(F.col("embedding")).alias("vec"), F.col("label").alias("list_id"))
    means = e.select("list_id", F.posexplode("vec").alias("i", "x")).groupBy("list_id", "i").agg(F.avg("x").alias("x"))
    centroids = means.groupBy("list_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return ivf.probed(vector_queries(spark, root), centroids, 3)


@query(f"WITH {S.index()}{_PRUNE} SELECT qid, count(*) FILTER (kept) AS kept, count(*) AS terms FROM pr GROUP BY qid")
def wn_budget(spark: SparkSession, root: str) -> DataFrame:
    found = bm25.pruned_terms(text_queries(spark, root), tokenised(spark, root))
    return found.groupBy("qid").agg(F.sum(F.col("kept").cast("bigint")).alias("kept"), F.count("*").alias("terms"))


@query(
    """WITH j AS (SELECT DISTINCT id, coll_name, CASE WHEN coalesce(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.op') IN ('attach_index', 'detach_index'), false) THEN 1 ELSE 0 END AS b FROM jobs WHERE lower(status) IN ('pending', 'processing')),
s AS (SELECT *, 2 * sum(b) OVER (PARTITION BY coll_name ORDER BY id ROWS UNBOUNDED PRECEDING) - b AS run FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY coll_name, run ORDER BY id) - 1 AS nth FROM s)
SELECT id, coll_name, dense_rank() OVER (PARTITION BY coll_name ORDER BY run, nth // 8)::INT AS turn, (nth % 8 + 1)::INT AS place FROM n"""
)
def wr_job(spark: SparkSession, root: str) -> DataFrame:
    """The batches in which open jobs are worked off: by id, index jobs alone."""
    own = table(spark, root, "jobs", "id", "coll_name", "status", "payload")
    return jobs.turns(own, F.get_json_object("payload", "$.op").isin(*jobs.INDEX_JOBS))
