"""Changes to a collection's records, as new versions of its tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpie.functions.metadata import fts_suffix, merge_patch
from kelpie.session import written


def upsert(records: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The records after an upsert by external_id.

    Records with a key of ``new`` are replaced; all others stay, also chunks of the same document which the payload
    doesn't name. Of several new rows with one key the last by ``order`` counts. New ids follow the greatest so far, in
    ``order``. Records without a key stay; new rows without one are left out.
    """
    top = records.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    incoming = fresh(new, order, top)
    kept = records.join(incoming.select("external_id"), "external_id", "left_anti")
    return kept.unionByName(incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(records.schema[c].dataType).alias(c) for c in records.columns]))


def fresh(new: DataFrame, order: list[str], top: int) -> DataFrame:
    """The last row by ``order`` of each external_id of ``new``, with ids from ``top`` + 1 on in ``order``."""
    last = Window.partitionBy("external_id").orderBy(*[F.col(c).desc() for c in order])
    incoming = new.where("external_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return numbered_by(incoming, order).withColumn("id", F.lit(top) + F.col("_row")).drop("_row")


def numbered_by(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with _row = 1, 2, ... in ``order``: range-partitioned, ranked within, shifted by the counts before.

    The partition number and the rank within it are written with the rows once; counts are taken from what was written,
    so both sides of the shift mean the same partitions, whatever the optimiser does and however often a row is read.
    """
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    local = written(placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "numbered")
    counts = local.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each partition
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(F.broadcast(before), "_p").withColumn("_row", F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def delete_documents(records: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The records without those of the given documents (doc_id)."""
    return records.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*records.columns)


def of_document(doc_id: str, apply_to_chunks: bool = True) -> Column:
    own = F.col("doc_id") == doc_id
    return own if apply_to_chunks else own & (F.col("type") == "summary")


def patch(records: DataFrame, patch: dict, which: Column, keys: list[str] | None = None) -> DataFrame:
    """The records with a merge patch applied to the metadata of those that match.

    Where ``keys`` (the ranked metadata keys) and fts_metadata exist and the patch touches one of the keys, the ranked
    suffix is made anew.
    """
    which = F.coalesce(which, F.lit(False))
    text = json.dumps(patch, ensure_ascii=False)
    out = records.withColumn("metadata", F.when(which, merge_patch(F.col("metadata"), F.lit(text))).otherwise(F.col("metadata")))
    if keys and set(keys) & set(patch) and "fts_metadata" in records.columns:
        out = out.withColumn("fts_metadata", F.when(which, fts_suffix(keys)(F.col("metadata"))).otherwise(F.col("fts_metadata")))
    return out

