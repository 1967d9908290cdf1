"""Graphs: connected components, alias tables, label folding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every component of edges (a, b); nodes without an edge are absent.

    Each round takes the smallest label among the neighbours and then the label of that label, so that a chain of n nodes
    settles in about log n rounds. Labels are checkpointed every round; nothing is gathered.
    """
    both = cut(edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        step = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("next"))
        over = label.select(F.col("node").alias("next"), F.col("root").alias("over"))
        moved = cut(step.join(over, "next", "left").select("node", "was", F.least(F.coalesce("over", "next"), "next").alias("root")))
        label = moved.select("node", "root")
        if moved.filter("was <> root").isEmpty():
            return label
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def guard_sizes(components: DataFrame, most: int) -> DataFrame:
    """The components unchanged; reading them fails if one has more than `most` nodes."""
    sizes = components.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    ok = F.assert_true(F.col("size") <= most, F.concat(F.lit("component too large: "), F.col("root").cast("string")))
    return components.join(sizes.select("root", "size", ok.alias("ok")), "root").filter("ok IS NULL").select("node", "root", "size")


def representatives(components: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, target): the heaviest node of each component (ties: the smaller) that all its nodes are renamed to."""
    best = components.join(weights, "node").groupBy("root").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("node").alias("n"))).alias("b"))
    return components.join(best, "root").select("node", F.col("b.n").alias("target"))


def apply_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Rewrite a column by an alias table (node, target); values without an alias pass through."""
    named = aliases.select(F.col("node").alias(column), F.col("target").alias("__target"))
    return df.join(named, column, "left").withColumn(column, F.coalesce("__target", column)).drop("__target").select(*df.columns)


def fold_labels(df: DataFrame, node: str, label: str, weight: str) -> DataFrame:
    """(node, target): nodes that share a label go to the heaviest of them."""
    best = df.groupBy(label).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(node).alias("n"))).alias("b"))
    return df.join(best, label).select(F.col(node).alias("node"), F.col("b.n").alias("target"))


def majority(votes: list[DataFrame], key: str, vote: str) -> DataFrame:
    """Sum of yes votes of several draws per key, with majority and unanimity."""
    rows = None
    for v in votes:
        part = v.select(key, F.col(vote).cast("int").alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    n = len(votes)
    out = rows.groupBy(key).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("yes"), F.count(F.lit(1)).alias("drawn"))
    return out.withColumn("majority", F.col("yes") * 2 > n).withColumn("unanimous", F.col("yes").isin(0, n))
