"""Problem 3: the most similar phrase vectors of every phrase vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.neighbours import nearest, nearest_exact
from millrace.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of cosine 0.90 or more, each among the ten most similar of the other."""
    near = nearest(table(spark, folder, "phrase_vectors").select("vec_id", "embedding"), k=10, least=0.9)
    both = near.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"))
    return both.groupBy("vec_a", "vec_b").count().filter("count = 2").select("vec_a", "vec_b")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For every phrase whose id is divisible by 20, its ten most similar phrases, however far, with their cosine."""
    rows = table(spark, folder, "phrase_vectors").select("vec_id", "atom_norm", "embedding")
    near = nearest_exact(rows, rows.filter("vec_id % 20 = 0").select("vec_id"), k=10)
    names = rows.groupBy("vec_id").agg(F.min("atom_norm").alias("atom_norm"))
    out = near.join(names.withColumnsRenamed({"vec_id": "a", "atom_norm": "phrase"}), "a")
    out = out.join(names.withColumnsRenamed({"vec_id": "b", "atom_norm": "via"}), "b")
    return out.select(F.col("a").alias("vec_id"), "phrase", "rank", "via", F.round("cosine", 4).alias("cosine"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}

ORACLES = {
    "p3_found": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
           FROM phrase_vectors WHERE len(embedding) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS e FROM v WHERE n > 0),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS cosine
      FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) <= 10)
SELECT x.a AS vec_a, x.b AS vec_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
}
