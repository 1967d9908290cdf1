"""Problem 2: languages of the items of postings whose label is missing, wrong or covers only part of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.languages import item_languages
from millrace.sources.tables import table


def p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every item, and of every part of an item that mixes several, with a confidence."""
    rows = table(spark, folder, "postings").select("posting_row", "must_have", "language", "geo_country", "company_id")
    return item_languages(rows, "posting_row", "must_have", "language", "geo_country", "company_id").withColumnRenamed("row", "posting_row")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each language in which an item is written and which the row's label does not name."""
    found = p2_languages(spark, folder).filter(F.col("declared").isNull() | (F.col("declared") != F.col("lang")))
    return found.select("posting_row", "item_idx", "lang").distinct()


QUERIES = {"p2_found": p2_found, "p2_languages": p2_languages}
ORACLES: dict[str, str] = {}
