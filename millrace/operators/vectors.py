"""Vector operators: centroids, assignment, margins, nearest entries, one-hop grouping."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASSIGN_MIN = 0.55
TYPE_MIN, TYPE_MARGIN = 0.20, 0.02
#: Bytes of vectors that are sent to the workers at once, and of a product that is held at once.
SMALL_SIDE, TILE = 64 << 20, 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; NULL for a missing, empty or all-zero one."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(v) > 0) & (n > 0), F.transform(v, lambda x: x.cast("double") / n))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, n): the normalised mean of the unit vectors of each label, summed place by place."""
    rows = df.select(label, unit(F.col(vector)).alias("v")).filter(f"v IS NOT NULL AND {label} IS NOT NULL")
    sums = rows.select(label, F.posexplode("v").alias("at", "x")).groupBy(label, "at").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda t: t["s"]).alias("s"), F.max("n").alias("n"))
    return out.select(label, unit(F.col("s")).alias("centroid"), "n")


def best_two(df: DataFrame, key: str, vector: str, entries: DataFrame, entry: str, entry_vector: str) -> DataFrame:
    """(key, best, best_cos, second_cos): the two nearest entries by cosine; ties go to the smaller entry.

    Entries of up to SMALL_SIDE bytes are sent to the workers and scored as products of TILE bytes; a longer list is taken
    in blocks of that size and the block winners are merged.
    """
    n = entries.agg(F.sum(F.size(entry_vector).cast("bigint") * 8)).first()[0] or 0
    if n > SMALL_SIDE:
        blocks = -(-n // SMALL_SIDE)
        parts = [_best_in_block(df, key, vector, entries.filter(F.pmod(F.xxhash64(entry), F.lit(blocks)) == b), entry, entry_vector) for b in range(blocks)]
        both = reduce(DataFrame.unionByName, parts)
        top = F.array_sort(F.collect_list(F.struct((-F.col("best_cos")).alias("c"), F.col("best").alias("e"), F.col("second_cos").alias("s"))))  # one entry a block
        merged = both.groupBy(key).agg(top.alias("t"))
        return merged.select(key, F.col("t")[0]["e"].alias("best"), (-F.col("t")[0]["c"]).alias("best_cos"), F.greatest(F.col("t")[0]["s"], -F.get("t", F.lit(1))["c"]).alias("second_cos"))
    return _best_in_block(df, key, vector, entries, entry, entry_vector)


def _best_in_block(df: DataFrame, key: str, vector: str, entries: DataFrame, entry: str, entry_vector: str) -> DataFrame:
    """best_two for one block of entries."""
    spark = df.sparkSession
    rows = entries.select(entry, unit(F.col(entry_vector)).alias("v")).filter("v IS NOT NULL").orderBy(entry).collect()
    names, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)
    sent = spark.sparkContext.broadcast((names, matrix))
    given = df.select(F.col(key), unit(F.col(vector)).alias("v")).filter("v IS NOT NULL")

    def score(batches):
        names, matrix = sent.value
        for pdf in batches:
            if not len(pdf) or not names:
                continue
            step = max(1, TILE // (8 * len(names)))
            for k in range(0, len(pdf), step):
                part = pdf.iloc[k : k + step]
                c = np.round(np.stack(part["v"].to_numpy()) @ matrix.T, 9)
                first = c.argmax(axis=1)
                at = np.arange(len(c))
                top = c[at, first].copy()
                c[at, first] = -2.0
                second = c.max(axis=1) if c.shape[1] > 1 else np.full(len(c), -1.0)
                yield pd.DataFrame({key: part[key], "best": [names[i] for i in first], "best_cos": top, "second_cos": second})

    kinds = f"{key} {df.schema[key].dataType.simpleString()}, best {entries.schema[entry].dataType.simpleString()}, best_cos DOUBLE, second_cos DOUBLE"
    return given.mapInPandas(score, kinds)


def assign(best: DataFrame, least: float = ASSIGN_MIN) -> DataFrame:
    """The nearest cluster, or -1 under the least cosine; the similarity has 4 digits."""
    return best.withColumn("cluster", F.when(F.col("best_cos") >= least, F.col("best")).otherwise(-1)).withColumn("similarity", F.round("best_cos", 4))


def margin_type(best: DataFrame, least: float = TYPE_MIN, margin: float = TYPE_MARGIN) -> DataFrame:
    """The nearest type, or NULL if it is too far or too close to the second."""
    sure = (F.col("best_cos") >= least) & (F.col("best_cos") - F.col("second_cos") >= margin)
    return best.withColumn("type", F.when(sure, F.col("best")))


def hybrid_type(lexicon: Column, embedded: Column, first: tuple[str, ...] = ("language", "credential")) -> Column:
    """The lexicon's type where it is one of `first`, else the embedded one, else the lexicon's."""
    return F.when(lexicon.isin(*first), lexicon).otherwise(F.coalesce(embedded, lexicon))


def near_pairs(df: DataFrame, key: str, vector: str, block: str, least: float) -> DataFrame:
    """(block, a, b, cosine) with a < b of one block and cosine >= least: an equi-join on the block, then the cosine.

    Blocks are meant to be narrow (a space and its names); a hot block is cut into parts and every pair of parts is scored
    in a task of its own.
    """
    rows = df.select(F.col(block).alias("block"), F.col(key).alias("id"), unit(F.col(vector)).alias("v")).filter("v IS NOT NULL AND block IS NOT NULL")
    sizes = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("parts"))
    placed = rows.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("block", "id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind, bkind = df.schema[key].dataType.simpleString(), df.schema[block].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids, own = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy(), pdf["own"].to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.nonzero(own == lo)[0], np.nonzero(own == hi)[0]
        c = np.round(m[left] @ m[right].T, 9)
        r, k = np.nonzero(c >= least)
        a, b = ids[left[r]], ids[right[k]]
        ok = (a < b) if lo == hi else np.ones(len(a), bool)
        out = pd.DataFrame({"block": pdf["block"].iloc[0], "a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "cosine": c[r, k][ok]})
        return out

    return placed.groupBy("block", "lo", "hi").applyInPandas(score, f"block {bkind}, a {kind}, b {kind}, cosine DOUBLE")


def one_hop(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, target): every node joins its most frequent neighbour if that one is more frequent (ties: the smaller id), one hop.

    nodes has (id, n), pairs (a, b) once each.
    """
    both = pairs.select("a", "b").unionByName(pairs.selectExpr("b AS a", "a AS b"))
    best = both.join(nodes.selectExpr("id AS b", "n AS nb"), "b").groupBy("a").agg(F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("i"))).alias("t")).withColumnRenamed("a", "id")
    out = nodes.join(best, "id", "left")
    moves = (-F.col("t.m") > F.col("n")) | ((-F.col("t.m") == F.col("n")) & (F.col("t.i") < F.col("id")))
    return out.select("id", "n", F.when(moves, F.col("t.i")).otherwise(F.col("id")).alias("target"))


def similarity_bands(pairs: DataFrame, width: float = 0.05) -> DataFrame:
    """Pairs per band of similarity."""
    k = round(1 / width)
    return pairs.groupBy((F.floor(F.col("cosine") * k) / k).alias("band")).agg(F.count(F.lit(1)).alias("pairs"))


def separation_stats(scores: DataFrame, positive: str, score: str) -> DataFrame:
    """Cohen's d (pooled) and AUC of a score, AUC by rank sums over distinct scores."""
    stats = scores.groupBy(positive).agg(F.avg(score).alias("m"), F.var_samp(score).alias("v"), F.count(F.lit(1)).alias("n"))
    wide = stats.agg(*[F.max(F.when(F.col(positive) == b, F.col(c))).alias(f"{c}{int(b)}") for b in (True, False) for c in ("m", "v", "n")])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    # Scores are rounded to 6 digits for the ranks, which bounds the distinct ones.
    groups = scores.withColumn(score, F.round(score, 6)).groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(F.lit(1)).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = groups.withColumn("below", below).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("w"))
    return wide.join(F.broadcast(wins)).select(((F.col("m1") - F.col("m0")) / pooled).alias("cohens_d"), (F.col("w") / (F.col("n1") * F.col("n0"))).alias("auc"))  # one row each
