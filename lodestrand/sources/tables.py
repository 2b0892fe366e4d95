"""The tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters reach the scan as usual."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
