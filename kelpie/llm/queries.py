"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import distinctive, leaks, lookalike, nearcopies, neighbours, sentences, tokens
from kelpie.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, root, "vecs", "id", "vec"), table(spark, root, "ingest_in", "documents"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return nearcopies.near_copy_pairs(table(spark, root, "records", "id", "text"))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row for each record with a near copy: its group and its number of links."""
    return nearcopies.near_copy_groups(table(spark, root, "records", "id", "text"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return distinctive.standing_out(table(spark, root, "records", "id", "text"))


def p4_scores(spark: SparkSession, root: str) -> DataFrame:
    """All repeated terms that belong to their elite, by the posterior alone."""
    found = distinctive.scored_terms(table(spark, root, "records", "id", "text"), least_tf=2, least_chars=3)
    return found.where("score >= 0.5").withColumn("score", F.round("score", 6))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.look_same(table(spark, root, "records", "id", "text"))


def p5_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row for each record that looks like others: its class and how many records are spelled otherwise."""
    return lookalike.look_classes(table(spark, root, "records", "id", "text"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents", "doc_id", "text"))


def p6_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Of each document the number of its tokens, of the characters they cover, and of tokens that share a character with the one before."""
    spans = tokens.encode(table(spark, root, "documents", "doc_id", "text"), offsets=True)
    shared = F.zip_with(F.slice("starts", 2, 2**31 - 1), "ends", lambda start, end: (start < end).cast("int"))
    return spans.select("doc_id", F.size("ids").alias("tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("chars"), F.aggregate(shared, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))).alias("split"))


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """Each document's text as its ids give it back."""
    return tokens.decode(tokens.encode(table(spark, root, "documents", "doc_id", "text")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text", "lang"))


def p7_edited(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold exact, edited or partly reworded copies of items, by alignment score."""
    found = leaks.edited_copies(table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text", "lang"))
    return found.select("doc_id", "item_id", "score", F.round("share", 6).alias("share"), "longest_run")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(table(spark, root, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p3_groups, p4_found, p4_scores, p5_found, p5_classes, p6_ids, p6_offsets, p6_texts, p7_found, p7_edited, p8_found)}


_P2 = r"""WITH i AS (SELECT unnest(documents) AS d FROM ingest_in), c AS (SELECT unnest(d.chunks) AS c FROM i),
a AS (SELECT id::VARCHAR AS key, vec FROM vecs UNION ALL SELECT d.doc_id, d.summary.vector FROM i UNION ALL SELECT c.id, c.vector FROM c),
v AS (SELECT key, any_value(vec::DOUBLE[]) AS vec FROM a WHERE key IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY key),
u AS (SELECT key, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))::DOUBLE[64] AS vec FROM v),
s AS (SELECT q.key, x.key AS other, round(array_inner_product(q.vec, x.vec), 6) AS s FROM u q, u x WHERE q.key <> x.key),
k AS (SELECT key, unnest(min_by(other, (-s, other), 5)) AS other FROM s GROUP BY key)
SELECT DISTINCT least(key, other) AS key_a, greatest(key, other) AS key_b FROM k"""

_P3 = r"""WITH r AS (SELECT DISTINCT id, text FROM records WHERE length(text) >= 200), w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM r),
t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) > 2), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 2 * s >= x.n + y.n - s"""

_P4 = r"""WITH r AS (SELECT DISTINCT id, text FROM records WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}]')), n AS (SELECT count(DISTINCT id) AS n FROM r),
t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+')) AS term FROM r) GROUP BY id, term), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
SELECT id, term FROM t JOIN d USING (term), n WHERE tf >= 2 AND length(term) >= 3 AND (1 + ln(tf)) * ln(n / df) >= (1 + ln(3)) * ln(n / 5.5::DOUBLE) - 1e-9"""


def oracle_sql() -> dict[str, str]:
    """SQL that compares all vectors, all pairs with a common triple, and all terms; for the others SQL lacks the means."""
    return {"p2_found": _P2, "p3_found": _P3, "p4_found": _P4, "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
