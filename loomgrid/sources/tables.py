"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table, a file or a folder, of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
