"""Ingest payloads: their schema, validation, and the records they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "text string, vector array<float>, metadata string"
DOCUMENTS = f"array<struct<doc_id: string, summary: struct<text: string, vector: array<float>, metadata: string>, chunks: array<struct<id: string, position: int, text: string, vector: array<float>, metadata: string>>>>"
PAYLOAD = f"documents {DOCUMENTS}"


class BadPayload(ValueError):
    pass


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one JSON object each or one a line; metadata objects are kept as JSON text."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def flatten(payloads: DataFrame, order: str = "ingest_id") -> DataFrame:
    """(order, external_id, doc_id, type, position, text, vector, metadata, place): the records of each payload.

    A chunk's key is its id, its position defaults to its place in the array; a summary's key is the document's id, its
    position is null. Of records with one key in a payload the last counts, at the place of the first. Null documents,
    summaries and chunks, and records without a key, give nothing; null metadata is an empty object. Repeated payload
    rows count once, because each key of a payload comes once.
    """
    documents = payloads.select(order, F.posexplode("documents").alias("d_at", "d")).where("d is not null")
    summary = documents.where("d.summary is not null").select(
        order, F.col("d.doc_id").alias("external_id"), F.col("d.doc_id").alias("doc_id"), F.lit("summary").alias("type"), F.lit(None).cast("int").alias("position"),
        F.col("d.summary.text").alias("text"), F.col("d.summary.vector").alias("vector"), F.col("d.summary.metadata").alias("metadata"), "d_at", F.lit(-1).alias("c_at"),
    )
    chunk = documents.select(order, "d_at", F.col("d.doc_id").alias("doc_id"), F.posexplode("d.chunks").alias("c_at", "c")).where("c is not null").select(
        order, F.col("c.id").alias("external_id"), "doc_id", F.lit("chunk").alias("type"), F.coalesce("c.position", "c_at").alias("position"),
        F.col("c.text").alias("text"), F.col("c.vector").alias("vector"), F.col("c.metadata").alias("metadata"), "d_at", "c_at",
    )
    rows = summary.unionByName(chunk).where("external_id is not null")
    w = Window.partitionBy(order, "external_id")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy(F.desc("d_at"), F.desc("c_at")))).withColumn("place", F.min(F.struct("d_at", "c_at")).over(w))
    return rows.where("n = 1").withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).drop("n", "d_at", "c_at")


def problem(dim: int) -> Column:
    """What is wrong with a flattened record, or null: it needs a text or a vector, and a vector needs ``dim`` numbers, not all zero."""
    none = F.coalesce(F.size("vector") <= 0, F.lit(True))
    return (
        F.when(F.col("text").isNull() & none, "needs a text or a vector")
        .when(~none & (F.size("vector") != dim), "vector of another length")
        .when(~none & ~F.exists("vector", lambda x: x != 0), "zero vector")
    )


def validated(records: DataFrame, dim: int) -> DataFrame:
    """The records themselves; BadPayload names the first bad one. An action."""
    bad = records.withColumn("problem", problem(dim)).where("problem is not null").select("external_id", "problem").orderBy("external_id").first()
    if bad:
        raise BadPayload(f"{bad.external_id}: {bad.problem}")
    return records
