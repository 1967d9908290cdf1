"""Run quality: ratios, lights, drift, error tables, event logs, agreement statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.profiles import uniform

MIN_PAIRS, REF_MIN_PAIRS, P_RED, P_YELLOW = 10, 30, 0.01, 0.05
ERROR_YELLOW, ERROR_RED = 0.03, 0.06


def run_metrics(rows: DataFrame, run: str, item: list[str]) -> DataFrame:
    """Shares of a run: per item and per requirement, by route and by match."""
    key = F.struct(*item)
    n = F.count(F.lit(1))
    return rows.groupBy(run).agg(
        n.alias("requirements"), F.count_distinct(key).alias("items"), F.round(n / F.count_distinct(key), 6).alias("per_item"),
        *[F.round(F.avg((F.col("route") == r).cast("double")), 6).alias(f"share_{r}") for r in ("rules", "single", "llm", "damaged")],
        *[F.round(F.avg((F.coalesce("match_status", F.lit("")) == m).cast("double")), 6).alias(f"match_{m}") for m in ("known", "group", "topic", "nuovo")],
    )


def reference_bands(per_posting: DataFrame, numerator: str, denominator: str, sizes: list[int], runs: int, seed: int) -> DataFrame:
    """Percentiles 1, 5, 50, 95, 99 of a ratio over `runs` random runs of each size.

    A run is the set of postings whose hash falls into one of total / size slots, one slot per run, so that no draw sorts.
    """
    total = per_posting.count()
    out = None
    for size in sizes:
        slots = max(1, total // size)
        take = min(slots, runs)
        slot = F.floor(uniform(F.lit(seed), F.lit(size), "posting_id") * slots).cast("int")
        ratios = per_posting.withColumn("slot", slot).filter(F.col("slot") < take).groupBy("slot").agg((F.sum(numerator) / F.sum(denominator)).alias("r"))
        q = ratios.agg(F.expr("percentile(r, array(0.01, 0.05, 0.5, 0.95, 0.99))").alias("q"), F.count(F.lit(1)).alias("runs"))
        part = q.select(F.lit(size).alias("size"), "runs", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((1, 5, 50, 95, 99))])
        out = part if out is None else out.unionByName(part)
    return out


def light(value: Column, size: Column, least: int, low1: float, low5: float, high5: float, high1: float, bad: str) -> Column:
    """The light of a signal: outside 1 to 99 red, outside 5 to 95 yellow, on the bad side only; too small runs are grey."""
    red = {"low": value < low1, "high": value > high1}[bad]
    yellow = {"low": value < low5, "high": value > high5}[bad]
    return F.when(size < least, "grey").when(red, "red").when(yellow, "yellow").otherwise("green")


def drift(history: DataFrame, run: str, at: str, light_: str, runs: int = 3) -> DataFrame:
    """History lines with drift = the signal was off green in each of the last `runs` lines."""
    w = Window.partitionBy(run).orderBy(at).rowsBetween(1 - runs, 0)
    bad = F.col(light_).isin("yellow", "red").cast("int")
    return history.withColumn("drift", (F.sum(bad).over(w) == runs))


def latest(events: DataFrame, key: str, at: list[str], *values: str) -> DataFrame:
    """The last event of every key: one aggregation by the largest (at, values)."""
    return events.groupBy(key).agg(F.max(F.struct(*at, *values)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in (*at, *values)])


def replay(events: DataFrame, key: str, at: list[str], status: str, keep: str, drop: str, *values: str) -> DataFrame:
    """The standing entries of an append-only log: the last `keep` or `drop` event of a key counts, `drop` removes it."""
    return latest(events.filter(F.col(status).isin(keep, drop)), key, at, status, *values).filter(F.col(status) == keep)


def error_table(rows: DataFrame, by: list[str], example: str, n: int = 3) -> DataFrame:
    """Counts by kind with their share and the n smallest examples; counting n smallest needs no full list."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    once = rows.select(*by, example).distinct()
    top = once.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(example))).filter(F.col("r") <= n)
    examples = top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(example)), " | ").alias("examples"))
    whole = Window.partitionBy(F.lit(1))  # one row per kind
    return counts.join(examples, by, "left").withColumn("share", F.round(F.col("count") / F.sum("count").over(whole), 6))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k successes of n, clipped to [0, 1], 4 digits; NULL for n = 0."""
    p, d = k / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = n > 0
    return F.when(ok, F.round(F.greatest(F.lit(0.0), middle - half), 4)), F.when(ok, F.round(F.least(F.lit(1.0), middle + half), 4))


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P(X >= k) for X ~ B(n, p), any n: the terms are summed from their logarithms, so none underflows by itself.

    The shorter and smaller side is summed: the terms from k up beyond the mean, else one less those below k.
    """

    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        def terms(n: int, i: int, end: int, p: float) -> float:
            log = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p) for x in range(i, end)]
            return math.fsum(math.exp(t) for t in log)

        def one(n: float, k: float, p: float) -> float | None:
            if any(pd.isna(x) for x in (n, k, p)):
                return None
            n, k = int(n), int(k)
            if k <= 0:
                return 1.0
            if k > n or p <= 0:
                return 0.0
            if p >= 1:
                return 1.0
            return min(1.0, terms(n, k, n + 1, p)) if k > n * p else max(0.0, 1 - terms(n, 0, k, p))

        return pd.Series([one(*x) for x in zip(n, k, p, strict=True)], dtype="float64")

    return tail(n.cast("double"), k.cast("double"), p.cast("double"))


def judge_light(flagged: Column, answered: Column, ref_flagged: Column, ref_answered: Column) -> Column:
    """One-sided test of a run's flag rate against the reference."""
    p = F.greatest(ref_flagged / ref_answered, 0.5 / ref_answered)
    tail = binomial_tail(answered, flagged, p)
    return F.when((answered < MIN_PAIRS) | (ref_answered < REF_MIN_PAIRS), "grey").when(tail < P_RED, "red").when(tail < P_YELLOW, "yellow").otherwise("green")


def kappa(rows: DataFrame, truth: str, judged: str, least_truth: int = 5, least_judged: int = 1) -> DataFrame:
    """Agreement and Cohen's kappa of two yes/no columns; NULL where a class is too small."""
    n = F.count(F.lit(1))
    s = rows.agg(n.alias("n"), F.count_if(F.col(truth) == F.col(judged)).alias("same"), F.count_if(truth).alias("t1"), F.count_if(judged).alias("j1"), F.count_if(F.col(truth) & F.col(judged)).alias("tp"))
    pe = (F.col("t1") * F.col("j1") + (F.col("n") - F.col("t1")) * (F.col("n") - F.col("j1"))) / (F.col("n") * F.col("n"))
    po = F.col("same") / F.col("n")
    ok = (F.least(F.col("t1"), F.col("n") - F.col("t1")) >= least_truth) & (F.least(F.col("j1"), F.col("n") - F.col("j1")) >= least_judged) & (pe < 1)
    return s.select("n", F.round(po, 6).alias("agreement"), F.when(ok, F.round((po - pe) / (1 - pe), 6)).alias("kappa"), F.col("tp"), (F.col("j1") - F.col("tp")).alias("fp"), (F.col("t1") - F.col("tp")).alias("fn"))


def confusion(rows: DataFrame, truth: str, judged: str) -> DataFrame:
    """(truth, judged, n, share of the truth's rows)."""
    c = rows.groupBy(truth, judged).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(truth)), 6))


def error_estimate(inspected: Column, n: Column, placed: list[tuple[Column, Column, Column]]) -> tuple[Column, Column]:
    """Share wrong = inspected / n + the sum of placed share x flagged / answered, and its light."""
    total = inspected / n
    for share, flagged, answered in placed:
        total = total + F.coalesce(share * flagged / F.nullif(answered, F.lit(0)), F.lit(0.0))
    return total, F.when(total > ERROR_RED, "red").when(total >= ERROR_YELLOW, "yellow").otherwise("green")


def pending(jobs: DataFrame, history: DataFrame, job: str, at: str, now: Column, hours: int = 24) -> DataFrame:
    """Jobs of the last hours that have no history line."""
    recent = jobs.filter((F.col(at) <= now) & (F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS")))
    return recent.join(history.select(job).distinct(), job, "left_anti")


def health(state: Column, at: Column, now: Column, minutes: int = 90) -> Column:
    """A running job without news for `minutes` has failed."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 60
    return F.when((state == "running") & (age > minutes), "failed").otherwise(state)
