"""Problem 5: phrases that ask for the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.clusters import cluster_phrases, describe, pairs_of
from millrace.sources.tables import table


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_phrases(table(spark, folder, "phrases").select("phrase_id", "atom_norm", "head_group"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of phrases of one head group that ask for the same product and use: all pairs of each cluster.

    A phrase made of common words alone is paired with those of the same words; one of frame words alone names nothing.
    """
    members = _members(spark, folder).filter("subject <> '' OR use <> ''").select("id", "cluster")
    return pairs_of(members).select(F.col("a").alias("phrase_a"), F.col("b").alias("phrase_b"))


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster of two or more phrases with its size and three most typical members."""
    return describe(_members(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
ORACLES: dict[str, str] = {}
