"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import share_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table stored as <folder>/<name>.parquet (a file or a folder of part files)."""
    share_path(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
