"""Problem 8: all document texts into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import CAPACITY, pack
from millrace.sources.tables import table


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The container and place of each text, or of each part of a text longer than a container."""
    return pack(table(spark, folder, "documents").select("doc_id", "text"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers are used, and the share of their space that holds text."""
    used = F.sum("tokens") / (F.count_distinct("container") * F.lit(CAPACITY))
    return p8_packing(spark, folder).agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"), used.alias("fill"))


QUERIES = {"p8_packing": p8_packing, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
