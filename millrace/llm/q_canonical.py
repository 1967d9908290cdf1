"""Problem 7: typed titles and requirements mapped to the reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.canonical import NONE, PhraseMatcher, TitleMatcher, match_reference
from millrace.sources.tables import table


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every unmapped title and requirement with what it means and how far it is spelt from it."""
    titles = table(spark, folder, "titles").filter(_blank("title_key")).select(F.col("title_id").alias("row_id"), F.col("title").alias("value")).distinct()
    atoms = table(spark, folder, "requirements").filter(_blank("match_status")).select(F.col("req_id").alias("row_id"), F.col("atom_norm").alias("value")).distinct()
    keys, cores = table(spark, folder, "title_dictionary"), table(spark, folder, "req_cores")
    title = match_reference(titles, "value", keys, ["title_key", "title_group"], TitleMatcher)
    atom = match_reference(atoms, "value", cores, ["req_core", "n"], PhraseMatcher)
    out = None
    for field, rows, found in (("title", titles, title), ("atom_norm", atoms, atom)):
        part = rows.join(found.withColumnRenamed("value", "v"), rows["value"].eqNullSafe(F.col("v")), "left")
        part = part.select(F.lit(field).alias("field"), F.col("row_id").cast("string").alias("row_id"), "value", F.coalesce("canon", F.lit(NONE)).alias("canon"), "distance")
        out = part if out is None else out.unionByName(part)
    return out


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every unmapped title and requirement with the entry meant, or 'nuovo'."""
    return p7_matches(spark, folder).select("field", "row_id", "canon").distinct()


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of values that no entry explains, with the number of rows."""
    new = p7_matches(spark, folder).filter(F.col("canon") == NONE)
    return new.groupBy("field", "value").agg(F.count_distinct("row_id").alias("rows"))


QUERIES = {"p7_found": p7_found, "p7_matches": p7_matches, "p7_unmatched": p7_unmatched}
ORACLES: dict[str, str] = {}
