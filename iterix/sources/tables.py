"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """folder/name.parquet, a file or a folder of files in any store that Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
