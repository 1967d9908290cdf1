"""Problem 1: groups of requirements that postings ask for together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.cooccur import pair_counts
from millrace.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of groups asked for by at least three postings, one posting in 500, and three times as often as by chance."""
    rows = table(spark, folder, "requirements").select("posting_id", "req_group")
    pairs = pair_counts(rows, "posting_id", "req_group", min_joint=3, min_share=1 / 500)
    ok = F.col("joint") * F.col("records") >= 3 * F.col("n_a") * F.col("n_b")
    return pairs.filter(ok).select(F.col("item_a").alias("group_a"), F.col("item_b").alias("group_b"))


def p1_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Joint count and lift of every pair of groups that a posting asks for together."""
    rows = table(spark, folder, "requirements").select("posting_id", "req_group")
    pairs = pair_counts(rows, "posting_id", "req_group", min_joint=1)
    return pairs.select(F.col("item_a").alias("group_a"), F.col("item_b").alias("group_b"), "joint", "n_a", "n_b", F.round("lift", 6).alias("lift"))


QUERIES = {"p1_found": p1_found, "p1_lift": p1_lift}

_BASE = """
WITH p AS (SELECT DISTINCT posting_id, req_group FROM requirements WHERE trim(req_group) <> '' AND trim(posting_id) <> ''),
t AS (SELECT count(DISTINCT posting_id) AS t FROM p),
n AS (SELECT req_group, count(*) AS n FROM p GROUP BY 1),
j AS (SELECT a.req_group AS group_a, b.req_group AS group_b, count(*) AS joint
      FROM p a JOIN p b ON a.posting_id = b.posting_id AND a.req_group < b.req_group GROUP BY 1, 2)
"""

ORACLES = {
    "p1_found": _BASE
    + """SELECT group_a, group_b FROM j JOIN n x ON x.req_group = group_a JOIN n y ON y.req_group = group_b, t
WHERE joint >= 3 AND 500 * joint >= t AND joint * t >= 3 * x.n * y.n""",
    "p1_lift": _BASE
    + """SELECT group_a, group_b, joint, x.n AS n_a, y.n AS n_b,
round(joint::DOUBLE * t / (x.n::DOUBLE * y.n), 6) AS lift
FROM j JOIN n x ON x.req_group = group_a JOIN n y ON y.req_group = group_b, t""",
}
