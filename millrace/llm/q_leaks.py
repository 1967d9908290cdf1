"""Problem 9: passages of held-out items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.leaks import find_leaks
from millrace.sources.tables import table


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the items it leaks and the length of the longest passage."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, folder, "eval_items").select("item_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 20 consecutive words of an item, up to one in ten replaced."""
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item, and the longest passage of it."""
    return p9_leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items}
ORACLES: dict[str, str] = {}
