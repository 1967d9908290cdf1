"""Cell profiles: shares, lift verdicts, boilerplate, distances between profiles, resampling.

A cell is a group of adverts (an industry, a nation, a level). Shares count distinct adverts (or companies). Two different
denominators are kept apart: `cell_shares` divides by all units of the cell, `cell_profiles` only by units that are left
after noise and excluded clusters went.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CORE_MIN_SHARE, CORE_MAX_DEVIATION = 0.05, 0.35
SHELL_MIN_LIFT, SHELL_MIN_SHARE, MIN_HITS = 1.75, 0.03, 20
BOILER_MIN_MEAN, BOILER_MAX_CV = 0.10, 0.60


def cell_shares(facts: DataFrame, fn: str, cell: str, cluster: str, unit: str = "posting") -> DataFrame:
    """Distinct units per (fn, cell, cluster) that ask for the cluster, over all distinct units of the cell."""
    slim = facts.select(fn, cell, cluster, unit).distinct()
    hits = slim.groupBy(fn, cell, cluster).agg(F.count(F.lit(1)).alias("hits"))
    totals = slim.select(fn, cell, unit).distinct().groupBy(fn, cell).agg(F.count(F.lit(1)).alias("total"))
    return hits.join(totals, [fn, cell]).withColumn("share", F.col("hits") / F.col("total"))


def boilerplate(shares: DataFrame, cluster: str) -> DataFrame:
    """Mean, spread and flag of each cluster's share over the cells it stands in; absent cells give no row."""
    out = shares.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("cells"), F.avg("share").alias("mean"), F.min("share").alias("low"), F.max("share").alias("high"), F.stddev_samp("share").alias("std"),
    )
    out = out.withColumn("cv", F.coalesce(F.col("std") / F.col("mean"), F.lit(0.0)))
    return out.withColumn("boilerplate", (F.col("mean") >= BOILER_MIN_MEAN) & (F.col("cv") <= BOILER_MAX_CV))


def core_shell(facts: DataFrame, fn: str, cell: str, cluster: str, unit: str = "posting", exclude: DataFrame | None = None) -> DataFrame:
    """Share, lift over the function's own share, and verdict of every cluster in every cell.

    Clusters in `exclude` (boilerplate) stay in the result but are neither core nor shell.
    """
    slim = facts.select(fn, cell, cluster, unit).distinct()
    hits = slim.groupBy(fn, cell, cluster).agg(F.count(F.lit(1)).alias("hits"))
    totals = slim.select(fn, cell, unit).distinct().groupBy(fn, cell).agg(F.count(F.lit(1)).alias("total"))
    # A unit stands in one cell, so the counts of a function are sums over its cells: no second distinct.
    fn_hits = hits.groupBy(fn, cluster).agg(F.sum("hits").alias("fn_hits"))
    fn_total = totals.groupBy(fn).agg(F.sum("total").alias("fn_total"))
    out = hits.join(totals, [fn, cell]).join(fn_hits, [fn, cluster]).join(fn_total, fn)
    share, base = F.col("hits") / F.col("total"), F.col("fn_hits") / F.col("fn_total")
    out = out.withColumn("share", share).withColumn("function_share", base).withColumn("lift", F.col("share") / F.nullif(F.col("function_share"), F.lit(0.0)))
    if exclude is None:
        out = out.withColumn("boilerplate", F.lit(False))
    else:
        out = out.join(exclude.select(cluster, F.lit(True).alias("b")), cluster, "left").withColumn("boilerplate", F.coalesce("b", F.lit(False))).drop("b")
    shell = (F.col("lift") >= SHELL_MIN_LIFT) & (F.col("share") >= SHELL_MIN_SHARE) & (F.col("hits") >= MIN_HITS)
    core = (F.col("share") >= CORE_MIN_SHARE) & (F.abs(F.col("lift") - 1) <= CORE_MAX_DEVIATION)
    verdict = F.when(F.col("boilerplate"), "neither").when(shell, "shell").when(core, "core").otherwise("neither")
    return out.withColumn("reliable", F.col("hits") >= MIN_HITS).withColumn("verdict", verdict)


def verdict_summary(verdicts: DataFrame, fn: str, cell: str, cluster: str) -> DataFrame:
    """Counts by verdict per cell, and the shell of the highest lift; ties go to the smaller cluster."""
    top = F.min(F.when(F.col("verdict") == "shell", F.struct((-F.col("lift")).alias("l"), F.col(cluster).alias("c"))))
    return verdicts.groupBy(fn, cell).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("core", "shell", "neither")], top.alias("t")).select(fn, cell, "core", "shell", "neither", F.col("t.c").alias("top_shell"), (-F.col("t.l")).alias("top_lift"))


def cell_profiles(facts: DataFrame, cell: str, cluster: str, unit: str, exclude: list | None = None) -> DataFrame:
    """Share of a cell's units that ask for each cluster; excluded clusters go before both counts."""
    kept = facts if not exclude else facts.filter(~F.col(cluster).isin(exclude))
    return cell_shares(kept.withColumn("fn_", F.lit(1)), "fn_", cell, cluster, unit).drop("fn_")


def _long(profiles: DataFrame, cell: str, cluster: str, value: str) -> DataFrame:
    return profiles.select(F.col(cell).alias("cell"), F.col(cluster).alias("k"), F.col(value).cast("double").alias("v"))


def profile_distances(profiles: DataFrame, cell: str, cluster: str, value: str = "share") -> DataFrame:
    """(cell_a, cell_b, js, cosine, overlap) for every pair of cells.

    js is the base-2 Jensen-Shannon distance of the normalised profiles, cosine is 1 - cos of the raw ones, overlap is
    1 - the sum of minima of the normalised ones. Missing clusters count 0. All three come from sums over the clusters that
    two cells share, so no cell-by-cluster matrix is filled: js = sqrt(1 + (sum of h(p, q)) / 2) over shared clusters.
    """
    long = _long(profiles, cell, cluster, value).filter("v > 0")
    totals = long.groupBy("cell").agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("n2"))
    p = long.join(totals, "cell").select("cell", "k", "v", (F.col("v") / F.col("t")).alias("p"))
    a, b = p.select(F.col("cell").alias("cell_a"), "k", F.col("v").alias("va"), F.col("p").alias("pa")), p.select(F.col("cell").alias("cell_b"), "k", F.col("v").alias("vb"), F.col("p").alias("pb"))
    shared = a.join(b, "k").filter("cell_a < cell_b")
    plus = F.col("pa") + F.col("pb")
    # p log2(p / m) + q log2(q / m) = p + q wherever only one of them is positive, so only shared clusters deviate from 2.
    term = F.col("pa") * F.log2(2 * F.col("pa") / plus) + F.col("pb") * F.log2(2 * F.col("pb") / plus) - plus
    sums = shared.groupBy("cell_a", "cell_b").agg(F.sum(term).alias("d"), F.sum(F.col("va") * F.col("vb")).alias("dot"), F.sum(F.least("pa", "pb")).alias("o"))
    names = totals.select("cell")
    pairs = names.select(F.col("cell").alias("cell_a")).join(names.select(F.col("cell").alias("cell_b")), F.col("cell_a") < F.col("cell_b"))  # cells, not rows
    out = pairs.join(sums, ["cell_a", "cell_b"], "left")
    out = out.join(totals.select(F.col("cell").alias("cell_a"), F.col("n2").alias("na")), "cell_a").join(totals.select(F.col("cell").alias("cell_b"), F.col("n2").alias("nb")), "cell_b")
    js = F.sqrt(F.greatest(F.lit(0.0), 1 + F.coalesce("d", F.lit(0.0)) / 2))
    return out.select("cell_a", "cell_b", js.alias("js"), (1 - F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"), (1 - F.coalesce("o", F.lit(0.0))).alias("overlap"))


def distance_index(distances: DataFrame, *by: str) -> DataFrame:
    """Mean, least and greatest distance over the pairs of cells."""
    return distances.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.avg("js").alias("js"), F.avg("cosine").alias("cosine"), F.min("js").alias("js_min"), F.max("js").alias("js_max"))


def overlap_kept(shares: DataFrame, cell: str, cluster: str, origin: str, target: str, floor: int) -> DataFrame:
    """How much of the target's profile the origin already covers: sum of minima over the target's sum; NULL under the floor."""
    a = shares.filter(F.col(cell) == origin).select(cluster, F.col("share").alias("a"), F.col("total").alias("ta"))
    b = shares.filter(F.col(cell) == target).select(cluster, F.col("share").alias("b"), F.col("total").alias("tb"))
    both = a.join(b, cluster, "full").agg(F.sum(F.least(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).alias("m"), F.sum("b").alias("s"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    ok = (F.col("ta") >= floor) & (F.col("tb") >= floor)
    return both.select(F.lit(origin).alias("origin"), F.lit(target).alias("target"), F.when(ok, F.col("m") / F.col("s")).alias("kept"))


def overlaps_kept(shares: DataFrame, fn: str, cell: str, cluster: str, floor: int) -> DataFrame:
    """`overlap_kept` of all ordered pairs of cells of every fn in one pass."""
    cells = shares.groupBy(fn, cell).agg(F.sum("share").alias("s"), F.max("total").alias("t"))
    pairs = cells.select(fn, F.col(cell).alias("origin"), F.col("t").alias("ta")).join(cells.select(fn, F.col(cell).alias("target"), "s", F.col("t").alias("tb")), fn).filter("origin <> target")
    a, b = (shares.select(fn, cluster, F.col(cell).alias(c), F.col("share").alias(v)) for c, v in (("origin", "a"), ("target", "b")))
    both = a.join(b, [fn, cluster]).filter("origin <> target").groupBy(fn, "origin", "target").agg(F.sum(F.least("a", "b")).alias("m"))
    ok = (F.col("ta") >= floor) & (F.col("tb") >= floor)
    return pairs.join(both, [fn, "origin", "target"], "left").select(fn, "origin", "target", F.when(ok, F.coalesce("m", F.lit(0.0)) / F.col("s")).alias("kept"))


def share_deltas(shares: DataFrame, cell: str, cluster: str, origin: str, target: str, top: int) -> DataFrame:
    """The clusters that gain and lose most share between two cells (the report's `top` of each side)."""
    a = shares.filter(F.col(cell) == origin).select(cluster, F.col("share").alias("a"))
    b = shares.filter(F.col(cell) == target).select(cluster, F.col("share").alias("b"))
    both = a.join(b, cluster, "full").select(cluster, (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))
    up = both.orderBy(F.desc(F.round("delta", 9)), cluster).limit(top).withColumn("side", F.lit("gain"))
    down = both.orderBy(F.round("delta", 9), cluster).limit(top).withColumn("side", F.lit("loss"))
    return up.unionByName(down)


def uniform(*keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the keys only, alike on every run and in every engine: 40 bits of a SHA-256."""
    text = F.concat_ws("|", *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 10), 16, 10).cast("double") / float(1 << 40)


def poisson_edges() -> list[int]:
    """The 16-bit numbers below which a Poisson(1) weight is 0, 1, 2, ...; weights of 7 and more are taken as 7."""
    total, p, out = 0.0, 0.36787944117144233, []
    for k in range(7):
        total += p
        out.append(round(total * 65536))
        p /= k + 1
    return out


def draw_weights(units: list, draws: int, seed: int) -> np.ndarray:
    """units x draws weights: draw d of a unit is a 16-bit piece of the SHA-256 of seed, unit and d // 16."""
    blocks = -(-draws // 16)
    raw = b"".join(hashlib.sha256(f"{seed}|{u}|{b}".encode()).digest() for u in units for b in range(blocks))
    return np.searchsorted(poisson_edges(), np.frombuffer(raw, dtype=">u2").reshape(len(units), blocks * 16)[:, :draws], side="right").astype(np.int32)


def _weighted_counts(rows: DataFrame, keys: list[str], unit: str, draws: int, seed: int) -> DataFrame:
    """keys and w ARRAY<INT>: for every draw, the weights of the units that stand with the keys, summed.

    Each batch draws the weights of its units once and sums them per key, so rows are not multiplied by draws.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, seen = pd.factorize(pdf[unit])
            weights = draw_weights(list(seen), draws, seed)
            groups = pdf.groupby(keys, sort=False, dropna=False).indices
            got = [(*(k if isinstance(k, tuple) else (k,)), weights[codes[at]].sum(axis=0)) for k, at in groups.items()]
            yield pd.DataFrame(got, columns=[*keys, "w"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    sums = rows.select(*keys, F.col(unit).cast("string").alias(unit)).mapInPandas(partial, f"{kinds}, w ARRAY<INT>")
    add = F.aggregate("ws", F.array_repeat(F.lit(0), draws), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return sums.groupBy(*keys).agg(F.collect_list("w").alias("ws")).select(*keys, add.alias("w"))  # one array a partition


def bootstrap_index(facts: DataFrame, fn: str, cell: str, cluster: str, unit: str, draws: int, seed: int) -> DataFrame:
    """(fn, draw, js, cosine): the distance index of `draws` resamples of the units.

    Every unit gets a Poisson(1) weight per draw from a hash, which is resampling with replacement without moving units;
    shares are weighted sums, so all draws are one pass. A cell that a draw leaves without units is no cell of that draw.
    """
    slim = facts.select(fn, cell, cluster, unit).distinct()
    hits = _weighted_counts(slim, [fn, cell, cluster], unit, draws, seed)
    totals = _weighted_counts(slim.select(fn, cell, unit).distinct(), [fn, cell], unit, draws, seed)
    both = hits.withColumnRenamed("w", "hits").join(totals.withColumnRenamed("w", "total"), [fn, cell]).select(F.col(fn).alias("fn"), F.col(cell).cast("string").alias("cell"), "hits", "total", F.col(cluster).cast("string").alias("k"))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, names = pd.factorize(pdf["cell"], sort=True)
        ks, clusters = pd.factorize(pdf["k"])
        share = np.zeros((len(names), len(clusters), draws))
        h, n = np.stack(pdf["hits"].to_numpy()).astype(float), np.stack(pdf["total"].to_numpy()).astype(float)
        share[cells, ks] = np.divide(h, n, out=np.zeros_like(h), where=n > 0)
        total = share.sum(axis=1)
        p = np.divide(share, total[:, None], out=np.zeros_like(share), where=total[:, None] > 0)
        js, cosine, pairs = np.zeros(draws), np.zeros(draws), np.zeros(draws)
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                middle = (p[a] + p[b]) / 2
                both = [np.where(x > 0, x * np.log2(np.divide(x, middle, out=np.ones_like(x), where=middle > 0), where=x > 0, out=np.zeros_like(x)), 0.0).sum(axis=0) for x in (p[a], p[b])]
                ok = (total[a] > 0) & (total[b] > 0)
                norm = np.sqrt((share[a] ** 2).sum(axis=0) * (share[b] ** 2).sum(axis=0))
                js += np.where(ok, np.sqrt(np.maximum(0.0, 0.5 * (both[0] + both[1]))), 0.0)
                cosine += np.where(ok, 1 - np.divide((share[a] * share[b]).sum(axis=0), norm, out=np.zeros(draws), where=norm > 0), 0.0)
                pairs += ok
        keep = pairs > 0
        return pd.DataFrame({"fn": pdf["fn"].iloc[0], "draw": np.arange(draws)[keep], "js": js[keep] / pairs[keep], "cosine": cosine[keep] / pairs[keep]})

    kind = facts.schema[fn].dataType.simpleString()
    return both.groupBy("fn").applyInPandas(index, f"fn {kind}, draw INT, js DOUBLE, cosine DOUBLE").withColumnRenamed("fn", fn)


def grouped_index(shares: DataFrame, by: list[str], cell: str, cluster: str) -> DataFrame:
    """The distance index of every group of profiles."""
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by])
    s = shares.withColumn("g_", key)
    long = s.select("g_", F.col(cell).alias("cell"), F.col(cluster).alias("k"), F.col("share").cast("double").alias("v")).filter("v > 0")
    totals = long.groupBy("g_", "cell").agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("n2"))
    p = long.join(totals, ["g_", "cell"]).select("g_", "cell", "k", "v", (F.col("v") / F.col("t")).alias("p"))
    a = p.select("g_", "k", F.col("cell").alias("ca"), F.col("v").alias("va"), F.col("p").alias("pa"))
    b = p.select("g_", "k", F.col("cell").alias("cb"), F.col("v").alias("vb"), F.col("p").alias("pb"))
    plus = F.col("pa") + F.col("pb")
    term = F.col("pa") * F.log2(2 * F.col("pa") / plus) + F.col("pb") * F.log2(2 * F.col("pb") / plus) - plus
    sums = a.join(b, ["g_", "k"]).filter("ca < cb").groupBy("g_", "ca", "cb").agg(F.sum(term).alias("d"), F.sum(F.col("va") * F.col("vb")).alias("dot"))
    cells = totals.select("g_", F.col("cell").alias("ca"), F.col("n2").alias("na")).join(totals.select("g_", F.col("cell").alias("cb"), F.col("n2").alias("nb")), "g_").filter("ca < cb")
    both = cells.join(sums, ["g_", "ca", "cb"], "left")
    js = F.sqrt(F.greatest(F.lit(0.0), 1 + F.coalesce("d", F.lit(0.0)) / 2))
    cosine = 1 - F.coalesce("dot", F.lit(0.0)) / F.sqrt(F.col("na") * F.col("nb"))
    out = both.groupBy("g_").agg(F.avg(js).alias("js"), F.avg(cosine).alias("cosine"), F.min(js).alias("js_min"), F.max(js).alias("js_max"))
    parts = F.split("g_", "\u0001")
    return out.select(*[parts[i].alias(c) for i, c in enumerate(by)], "js", "cosine", "js_min", "js_max")


def permutation_null(facts: DataFrame, cell: str, cluster: str, unit: str, draws: int, seed: int) -> DataFrame:
    """(draw, js): the distance index after the cells of the units were dealt out anew.

    Every unit draws a uniform number from a hash and takes the cell in whose interval it falls; the intervals are as wide
    as the cells are large, so sizes hold in expectation and no draw needs a sort of all units.
    """
    slim = facts.select(cell, cluster, unit).distinct()
    units = slim.select(unit, cell).distinct()
    sizes = units.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy(cell)  # one row per cell
    share = F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    edges = sizes.select(F.col(cell).alias("new"), share.alias("hi")).withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(1)).orderBy("new")), F.lit(0.0)))
    drawn = units.select(unit).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", uniform(F.lit(seed), unit, "draw"))
    given = drawn.join(F.broadcast(edges), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(unit, "draw", F.col("new").alias(cell))  # one row per cell
    shuffled = slim.select(unit, cluster).join(given, unit)
    hits = shuffled.groupBy("draw", cell, cluster).agg(F.count(F.lit(1)).alias("hits"))
    totals = given.groupBy("draw", cell).agg(F.count(F.lit(1)).alias("total"))
    shares = hits.join(totals, ["draw", cell]).withColumn("share", F.col("hits") / F.col("total"))
    return grouped_index(shares, ["draw"], cell, cluster).select(F.col("draw").cast("int").alias("draw"), "js")


def summarise_draws(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and the 2.5 and 97.5 percentiles (linear) over draws."""
    q = F.expr(f"percentile({value}, array(0.025, 0.975))")
    return draws.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.avg(value).alias("mean"), q.alias("q")).select(*by, "draws", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def ratio_interval(draws: DataFrame, fn: str, numerator: str, denominator: str, value: str) -> DataFrame:
    """Ratio of two functions paired by draw: mean, interval and the share of draws above 1."""
    a = draws.filter(F.col(fn) == numerator).select("draw", F.col(value).alias("a"))
    b = draws.filter(F.col(fn) == denominator).select("draw", F.col(value).alias("b"))
    r = a.join(b, "draw").select((F.col("a") / F.col("b")).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("draws"), F.avg("r").alias("mean"), F.expr("percentile(r, 0.025)").alias("low"), F.expr("percentile(r, 0.975)").alias("high"), F.avg((F.col("r") > 1).cast("double")).alias("above_one"))


def add_up(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
