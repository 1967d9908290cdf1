"""Sampling and evaluation: hash-ranked draws, quotas, splits, matching, scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window


def rank_key(seed: str, *keys: str) -> Column:
    """A reproducible random order: the digest of seed and keys."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def stratum_rank(df: DataFrame, key: str, stratum: list[str], seed: str) -> DataFrame:
    """Add rank: the place of every row in the random order of its stratum, from 1.

    The digests are uniform, so their first three digits cut a stratum into 4096 even buckets; the rank is the count of the
    buckets before (a small table of counts) plus the place inside the bucket. No task sorts a whole stratum.
    """
    rows = df.withColumn("__h", rank_key(seed, key)).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*stratum, "__b").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*stratum).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 4096 rows a stratum
    inside = F.row_number().over(Window.partitionBy(*stratum, "__b").orderBy("__h", key))
    out = rows.withColumn("__r", inside).join(counts.withColumn("__before", before).drop("n"), [*stratum, "__b"])
    return out.withColumn("rank", F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__before").select(*df.columns, "rank")


def alternating_split(df: DataFrame, key: str, stratum: list[str], seed: str) -> DataFrame:
    """dev or holdout: rows of a stratum in random order, every second one to holdout."""
    out = stratum_rank(df, key, stratum, seed)
    return out.withColumn("part", F.when(F.col("rank") % 2 == 0, "holdout").otherwise("dev")).drop("rank")


def hash_split(df: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """holdout by a threshold on the digest of the key: no shuffle, any size."""
    u = F.conv(F.substring(rank_key(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(u < share, "holdout").otherwise("dev"))


def quota_sample(df: DataFrame, key: str, stratum: str, quota: dict | int, seed: str) -> DataFrame:
    """The first `quota` rows of each stratum in random order (a sampling operator: the size is its feature)."""
    most = F.lit(quota) if isinstance(quota, int) else F.coalesce(F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))])[F.col(stratum)], F.lit(0))
    # First salt by salt, then over what is left, so that a hot stratum is never ranked in one task.
    salted = df.withColumn("__h", rank_key(seed, key)).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(64)))
    first = salted.withColumn("draw", F.row_number().over(Window.partitionBy(stratum, "__s").orderBy("__h", key))).filter(F.col("draw") <= most)
    last = first.withColumn("draw", F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))).filter(F.col("draw") <= most)
    return last.drop("__h", "__s")


def proportional_quota(df: DataFrame, stratum: str, n: int, floor: int) -> DataFrame:
    """(stratum, quota, weight): a proportional share of n with a floor, and share in the pool over share in the sample."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("pool"))
    w = Window.partitionBy(F.lit(1))  # one row per stratum
    out = sizes.withColumn("quota", F.least(F.col("pool"), F.greatest(F.lit(floor), F.round(n * F.col("pool") / F.sum("pool").over(w)).cast("bigint"))))
    return out.withColumn("weight", F.round((F.col("pool") / F.sum("pool").over(w)) / (F.col("quota") / F.sum("quota").over(w)), 6))


def at_rank(df: DataFrame, value: str, rank: int) -> int:
    """The value at a rank (from 0) of a BIGINT column, exactly: counts by day, then second, then microsecond of what is left.

    No step sorts rows; the most distinct values that one step can meet are the seconds of a day or microseconds of a second.
    """
    low, inside = None, None
    for width in (86_400_000_000, 1_000_000, 1):
        rows = df if low is None else df.filter((F.col(value) >= low) & (F.col(value) < low + inside))
        counts = rows.groupBy(F.floor(F.col(value) / width).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        up_to = counts.withColumn("upto", F.sum("n").over(Window.orderBy("b")))
        hit = up_to.filter(F.col("upto") > rank).orderBy("b").first()
        low, inside, rank = hit["b"] * width, width, rank - (hit["upto"] - hit["n"])
    return low


def recent_holdout(df: DataFrame, key: str, at: str, share: float) -> DataFrame:
    """The most recent share of the rows as holdout, by the exact quantile of time (linear between ranks); no sort of all rows."""
    rows = df.withColumn("micros_", F.expr(f"unix_micros(CAST({at} AS TIMESTAMP))"))
    timed = rows.select("micros_").filter("micros_ IS NOT NULL")
    n = timed.count()
    if not n:
        return df.withColumn("part", F.lit(None).cast("string"))
    place = (n - 1) * (1 - share)
    low = at_rank(timed, "micros_", int(place))
    high = at_rank(timed, "micros_", min(n - 1, int(place) + 1)) if place > int(place) else low
    edge = low + (place - int(place)) * (high - low)
    return rows.withColumn("part", F.when(F.col("micros_") > edge, "holdout").otherwise("dev")).drop("micros_")


@F.pandas_udf(IntegerType())
def greedy_matches(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    """Predictions that find an unused truth with word Jaccard 0.6 or more, greedily in order."""
    def one(p, t):
        left, hits = [set(str(x).lower().split()) for x in (t if t is not None else [])], 0
        for x in p if p is not None else []:
            w = set(str(x).lower().split())
            scored = [(len(w & y) / len(w | y) if w | y else 0.0, -i) for i, y in enumerate(left)]
            if scored and max(scored)[0] >= 0.6:
                left.pop(-max(scored)[1])
                hits += 1
        return hits

    return pd.Series([one(p, t) for p, t in zip(predicted, truth, strict=True)], dtype="int32")


def score_splits(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Precision, recall, F1 and counts of exact, over and under splits."""
    m = df.withColumn("m", greedy_matches(predicted, truth)).withColumn("p", F.size(predicted)).withColumn("t", F.size(truth))
    s = m.agg(F.sum("m").alias("m"), F.sum("p").alias("p"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("items"), F.count_if(F.col("p") == F.col("t")).alias("exact"), F.count_if(F.col("p") > F.col("t")).alias("over"), F.count_if(F.col("p") < F.col("t")).alias("under"))
    precision, recall = F.col("m") / F.col("p"), F.col("m") / F.col("t")
    return s.select("items", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(2 * precision * recall / (precision + recall), 6).alias("f1"), "exact", "over", "under")
