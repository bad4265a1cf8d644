"""Reading the Parquet tables of a store directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``; with ``columns``, only these are scanned.

    Clashing or extra columns of the file never reach a plan that names its columns.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
