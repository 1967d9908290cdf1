"""How employers shape the aggregates: concentration, repetition, weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut

from millrace.operators.profiles import uniform


def gini(counts: DataFrame, value: str) -> DataFrame:
    """(n, gini) of a column, and the share of the largest 1, 5, 10 and 25 percent.

    Equal counts are grouped first, so the running totals go over distinct counts, which are few, and not over employers.
    """
    groups = counts.groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(F.lit(1)).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    g = groups.withColumn("before", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("above", F.coalesce(F.sum("m").over(down), F.lit(0))).withColumn("n", F.sum("m").over(whole))
    # Sum over ranks i = before + 1 .. before + m of (2 i - n - 1) x.
    ranks = F.col("m") * (2 * F.col("before") + F.col("m") + 1) - F.col("m") * (F.col("n") + 1)
    parts = [F.sum(F.greatest(F.lit(0), F.least(F.col("m"), F.greatest(F.lit(1), F.ceil(F.col("n") * s / 100)) - F.col("above"))) * F.col("x")).alias(f"t{s}") for s in (1, 5, 10, 25)]
    out = g.agg(F.max("n").alias("n"), F.sum(ranks * F.col("x")).alias("g"), F.sum(F.col("m") * F.col("x")).alias("total"), *parts)
    return out.select("n", (F.col("g") / (F.col("n") * F.col("total"))).alias("gini"), *[(F.col(f"t{s}") / F.col("total")).alias(f"top_{s}_pct") for s in (1, 5, 10, 25)])


def cap_per_employer(df: DataFrame, employer: str, order: str, cap: int) -> DataFrame:
    """The first `cap` rows of each employer (the operator's own feature); one with many rows is ranked salt by salt first."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(32)))
    first = salted.withColumn("__r", F.row_number().over(Window.partitionBy(employer, "__salt").orderBy(order))).filter(F.col("__r") <= cap)
    last = first.withColumn("__r", F.row_number().over(Window.partitionBy(employer).orderBy(order))).filter(F.col("__r") <= cap)
    return last.drop("__salt", "__r")


def content_sets(df: DataFrame, employer: str, unit: str, item: str) -> DataFrame:
    """(employer, unit, items): the sorted distinct items of every advert."""
    return df.groupBy(employer, unit).agg(F.array_sort(F.collect_set(item)).alias("items"))


def dedup_exact(sets: DataFrame, employer: str, unit: str) -> DataFrame:
    """Adverts per employer after adverts with equal item sets are counted once."""
    kept = sets.groupBy(employer, "items").agg(F.min(unit).alias(unit), F.count(F.lit(1)).alias("copies"))
    return kept.groupBy(employer).agg(F.sum("copies").alias("adverts"), F.count(F.lit(1)).alias("distinct_adverts"))


def similar_sets(sets: DataFrame, employer: str, unit: str, threshold: float) -> DataFrame:
    """(employer, early, late) for sets of one employer with Jaccard similarity `threshold` or more, early < late.

    Exact prefix filter: with its items in a fixed order, a set of n items shares one of the first n - ceil(threshold n) + 1
    with every set that is similar enough; the order puts rare items first, so that an item that all have pairs few.
    """
    rows = sets.select(employer, unit, F.array_distinct("items").alias("items")).filter("size(items) > 0").withColumn("size", F.size("items"))
    items = rows.select(employer, unit, "size", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy(employer, unit).orderBy("often", "item"))
    head = items.join(often, "item").withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    left = head.select(employer, "item", F.col(unit).alias("early"), F.col("size").alias("n"))
    right = head.select(employer, "item", F.col(unit).alias("late"), F.col("size").alias("m"))
    maybe = left.join(right, [employer, "item"]).filter("early < late").filter(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9).select(employer, "early", "late").distinct()
    a = rows.select(employer, F.col(unit).alias("early"), F.col("items").alias("x"))
    b = rows.select(employer, F.col(unit).alias("late"), F.col("items").alias("y"))
    both = maybe.join(a, [employer, "early"]).join(b, [employer, "late"])
    return both.filter(F.size(F.array_intersect("x", "y")) >= threshold * F.size(F.array_union("x", "y")) - 1e-9).select(employer, "early", "late")


def dedup_leader(sets: DataFrame, employer: str, unit: str, threshold: float) -> DataFrame:
    """(employer, unit) that greedy leader clustering keeps: by id, an advert stays if it is less like every kept one.

    Equal sets are collapsed first; adverts without items stay. The order is resolved by rounds over all employers at once:
    who has no similar earlier advert left stays, whoever is like one that stays goes, and what has gone stands in nobody's
    way; as many rounds as the longest chain of adverts that wait for one another, and no group is held in one task.
    """
    once = cut(sets.groupBy(employer, "items").agg(F.min(unit).alias(unit)))
    edges = cut(similar_sets(once, employer, unit, threshold))
    gone = None
    while not edges.isEmpty():
        waits = edges.select(employer, F.col("late").alias("early")).distinct()
        stay = edges.select(employer, "early").distinct().join(waits, [employer, "early"], "left_anti")
        out = cut(edges.join(stay, [employer, "early"], "left_semi").select(employer, F.col("late").alias(unit)).distinct())
        gone = out if gone is None else gone.unionByName(out)
        # Links of those that are settled, either way, are done with.
        left = edges.join(out.withColumnRenamed(unit, "late"), [employer, "late"], "left_anti").join(out.withColumnRenamed(unit, "early"), [employer, "early"], "left_anti")
        edges = cut(left.join(stay, [employer, "early"], "left_anti"))
    kept = once.select(employer, unit)
    return kept if gone is None else kept.join(gone, [employer, unit], "left_anti")


def self_similarity(sets: DataFrame, employer: str, unit: str, pairs: int, seed: int) -> DataFrame:
    """Mean Jaccard similarity of `pairs` hash-drawn pairs of adverts per employer.

    Every advert gets a place on a ring per draw; its partner is the next one on the ring, so no pairs are enumerated.
    """
    w = Window.partitionBy(employer).orderBy("u", unit)
    salted = sets.withColumn("u", uniform(F.lit(seed), unit)).withColumn("salt", F.pmod(F.xxhash64(unit), F.lit(32)))
    # The first pairs + 1 places of each salt hold those of the whole ring, so a large employer is not sorted in one task.
    first = F.row_number().over(Window.partitionBy(employer, "salt").orderBy("u", unit))
    salted = salted.withColumn("r0", first).filter(F.col("r0") <= pairs + 1).drop("r0", "salt")
    ring = salted.withColumn("next", F.lead("items").over(w)).withColumn("r", F.row_number().over(w)).filter(F.col("next").isNotNull() & (F.col("r") <= pairs))
    j = F.size(F.array_intersect("items", "next")) / F.size(F.array_union("items", "next"))
    return ring.groupBy(employer).agg(F.count(F.lit(1)).alias("pairs"), F.avg(j).alias("similarity"))
