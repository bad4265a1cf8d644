"""Listing, documents and collection figures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.metadata import sort_columns
from kelpie.operators.filters import in_scope

_SORT = re.compile(r"-?[\w.]+")


def listed(records: DataFrame, scope: str = "both", filt: dict | None = None, sort: str | None = None, limit: int = 20, offset: int = 0, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page of records, one row with the total under the filter).

    Order: by id, or by a metadata key (``-key`` descending) with id ascending among equals; nulls come first
    ascending and last descending, numbers before texts. ValueError for other sort keys and limits beyond 1..1000.
    """
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit lies between 1 and 1000, offset isn't negative")
    found = records.where(in_scope(scope, filt))
    order = [F.col("id").asc()]
    if sort:
        if not _SORT.fullmatch(sort):
            raise ValueError(f"not a sort key: {sort!r}")
        order = [*sort_columns(F.col("metadata"), sort.lstrip("-"), sort.startswith("-")), *order]
    page = found.orderBy(*order).offset(offset).limit(limit)
    if vectors is not None:
        page = page.join(vectors.select("id", "vec"), "id", "left")
    return page, found.agg(F.count("*").alias("total"))


def export(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """All indexed records with their vectors, null where there is none."""
    return records.where(in_scope("both")).join(vectors.select("id", "vec"), "id", "left")


def document(records: DataFrame, doc_id: str | None = None) -> DataFrame:
    """(doc_id, records): documents as arrays of their records, the summary first, then chunks by position and id."""
    own = records.where(F.col("doc_id") == doc_id) if doc_id is not None else records.where("doc_id is not null")
    entry = F.struct((F.col("type") != "summary").cast("int").alias("after"), "position", "id", "text", "metadata")
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("records"))


def stats(records: DataFrame, *by: str) -> DataFrame:
    """Documents, chunks and summaries, over all records (by collection, say)."""
    return records.groupBy(*by).agg(
        F.countDistinct("doc_id").alias("docs"),
        F.coalesce(F.sum((F.col("type") == "chunk").cast("bigint")), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum((F.col("type") == "summary").cast("bigint")), F.lit(0)).alias("summaries"),
    )


def type_counts(records: DataFrame) -> DataFrame:
    """Indexed records by type: tells whether a scope excludes anything."""
    return records.where(F.col("indexed").cast("int") == 1).groupBy("type").agg(F.count("*").alias("n"))
