"""Queries of cell profiles: shares, verdicts, distances, residuals, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import profiles as P
from millrace.plans.star import FACTS_SQL, facts

FACTORS = ["industry", "nation", "level"]
RESIDUAL_TYPES = ["PROMO", "ECONOMY"]


def _r(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def core_shell(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: verdict of every requirement group in every nation, by order status."""
    out = P.core_shell(facts(spark, folder), "fn", "nation", "cluster")
    return _r(out, "share", "function_share", "lift").select("fn", "nation", "cluster", "hits", "total", "share", "function_share", "lift", "reliable", "verdict")


def core_shell_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _r(P.verdict_summary(P.core_shell(facts(spark, folder), "fn", "nation", "cluster"), "fn", "nation", "cluster"), "top_lift")


def cell_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _r(P.cell_shares(facts(spark, folder), "fn", "industry", "cluster"), "share")


def boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    shares = P.cell_shares(facts(spark, folder), "fn", "industry", "size")
    return _r(P.boilerplate(shares, "size"), "mean", "low", "high", "std", "cv")


def cell_profiles_posting(spark: SparkSession, folder: str) -> DataFrame:
    return _r(P.cell_profiles(facts(spark, folder), "industry", "cluster", "posting", exclude=["small ring"]), "share")


def cell_profiles_company(spark: SparkSession, folder: str) -> DataFrame:
    return _r(P.cell_profiles(facts(spark, folder), "industry", "cluster", "company"), "share")


def profile_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _r(P.profile_distances(P.cell_profiles(facts(spark, folder), "nation", "brand", "posting"), "nation", "brand"), "js", "cosine", "overlap")


def js_index(spark: SparkSession, folder: str) -> DataFrame:
    """Mean distance between the nations' profiles per order status."""
    shares = P.cell_shares(facts(spark, folder), "fn", "nation", "brand")
    return _r(P.grouped_index(shares, ["fn"], "nation", "brand"), "js", "cosine", "js_min", "js_max")


def overlap_index(spark: SparkSession, folder: str) -> DataFrame:
    out = P.profile_distances(P.cell_profiles(facts(spark, folder), "industry", "cluster", "posting"), "industry", "cluster")
    near = Window.partitionBy("cell_a").orderBy(F.round("overlap", 9), "cell_b")
    return _r(out.withColumn("rank", F.row_number().over(near)), "overlap").select("cell_a", "cell_b", "overlap", "rank")


def leave_one_cell_out(spark: SparkSession, folder: str) -> DataFrame:
    """The index over the pairs that do not touch each industry: sums of all pairs less those of the cell."""
    d = P.profile_distances(P.cell_profiles(facts(spark, folder), "industry", "cluster", "posting"), "industry", "cluster")
    total = d.agg(F.sum("js").alias("s"), F.count(F.lit(1)).alias("n"))
    touching = d.select(F.explode(F.array("cell_a", "cell_b")).alias("without"), "js").groupBy("without").agg(F.sum("js").alias("ts"), F.count(F.lit(1)).alias("tn"))
    return touching.join(F.broadcast(total)).select("without", F.round((F.col("s") - F.col("ts")) / (F.col("n") - F.col("tn")), 6).alias("js"))  # one row beside one row per cell


def factor_power(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of each factor with at least 100 adverts in every function."""
    rows = facts(spark, folder).select("posting", "fn", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in FACTORS])).alias("s")).select("posting", "fn", "s.*").distinct()
    counts = rows.groupBy("factor", "level").agg(*[F.count_if(F.col("fn") == f).alias(f"n_{f}") for f in "FOP"])
    return counts.withColumn("powered", F.least("n_F", "n_O", "n_P") >= 100)


def factor_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The factors ranked by the mean distance between their levels."""
    rows = facts(spark, folder).select("posting", "cluster", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in FACTORS])).alias("s")).select("posting", "cluster", "s.*")
    index = P.grouped_index(P.cell_shares(rows, "factor", "level", "cluster"), ["factor"], "level", "cluster")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("js", 9)), "factor")  # one row per factor
    return _r(index.withColumn("rank", F.row_number().over(order)), "js").select("factor", "js", "rank")


def bootstrap_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the index per order status over 1,000 resamples."""
    draws = P.bootstrap_index(facts(spark, folder), "fn", "industry", "cluster", "posting", draws=1000, seed=20260911)
    return _r(P.summarise_draws(draws, ["fn"], "js"), "mean", "low", "high")


def bootstrap_ratio(spark: SparkSession, folder: str) -> DataFrame:
    draws = P.bootstrap_index(facts(spark, folder), "fn", "industry", "cluster", "posting", draws=1000, seed=20260911)
    return _r(P.ratio_interval(draws, "fn", "F", "O", "js"), "mean", "low", "high", "above_one")


def permutation_null(spark: SparkSession, folder: str) -> DataFrame:
    """The index that shuffled industries give (40 draws)."""
    return _r(P.permutation_null(facts(spark, folder), "industry", "cluster", "posting", draws=40, seed=7), "js")


def career_delta(spark: SparkSession, folder: str) -> DataFrame:
    shares = P.cell_profiles(facts(spark, folder), "level", "cluster", "posting")
    return _r(P.share_deltas(shares, "level", "cluster", "5-LOW", "1-URGENT", 8), "delta")


def geo_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a nation's profile that another nation covers, for all pairs of nations within every industry."""
    shares = P.cell_shares(facts(spark, folder), "industry", "nation", "cluster", "posting")
    return _r(P.overlaps_kept(shares, "industry", "nation", "cluster", 60), "kept")


def residual_by_function(spark: SparkSession, folder: str) -> DataFrame:
    """Share of requirements without an anchor, with and without small lines."""
    loose = F.col("type").isin(RESIDUAL_TYPES).cast("double")
    return facts(spark, folder).groupBy("fn").agg(F.count(F.lit(1)).alias("atoms"), F.round(F.avg(loose), 6).alias("residual"), F.round(F.avg(F.when(F.col("quantity") >= 10, loose)), 6).alias("residual_clean"))


def residual_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Why a group stays without an anchor: structural, novelty, vagueness or other, and its share per function."""
    per = facts(spark, folder).groupBy("cluster").agg(F.avg((F.col("flag") == "A").cast("double")).alias("entity"), F.avg((F.col("quantity") > 25).cast("double")).alias("consistency"), F.min("type").alias("type"))
    reason = F.when(F.col("type") == "ECONOMY", F.when(F.col("entity") >= 0.335, "structural").otherwise("other")).when((F.col("entity") >= 0.33) & (F.col("consistency") >= 0.5), "novelty").when((F.col("entity") < 0.33) & (F.col("consistency") < 0.5), "vagueness").otherwise("other")
    joined = facts(spark, folder).join(per.select("cluster", reason.alias("reason")), "cluster")
    counts = joined.groupBy("fn", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("fn", "reason", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("fn")), 6).alias("share"))


def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Shell counts of a grid of lift and share thresholds: one pass, the grid is exploded as literals."""
    out = P.core_shell(facts(spark, folder), "fn", "nation", "cluster").select("fn", "lift", "share", "hits")
    grid = F.array(*[F.struct(F.lit(l).alias("min_lift"), F.lit(s).alias("min_share")) for l in (1.25, 1.5, 1.75, 2.0, 2.25) for s in (0.02, 0.03, 0.05)])
    out = out.withColumn("g", F.explode(grid)).select("fn", "g.*", "lift", "share", "hits")
    hit = (F.col("lift") >= F.col("min_lift")) & (F.col("share") >= F.col("min_share")) & (F.col("hits") >= 20)
    return out.groupBy("min_lift", "min_share").agg(F.count_if(hit).alias("shells"), F.count_if(hit & (F.col("fn") == "F")).alias("shells_f"))


def size_grid(spark: SparkSession, folder: str) -> DataFrame:
    """How many cells pass each size threshold in every function."""
    sizes = facts(spark, folder).groupBy("nation").pivot("fn", ["F", "O", "P"]).agg(F.count_distinct("posting"))
    out = sizes.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (100, 150, 180, 200, 300)])))
    ok = F.least(*[F.coalesce(c, F.lit(0)) for c in ("F", "O", "P")]) >= F.col("threshold")
    return out.groupBy("threshold").agg(F.count_if(ok).alias("cells"))


def peak_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The nation where each group's lift is highest, per function."""
    out = P.core_shell(facts(spark, folder), "fn", "nation", "cluster")
    top = F.min(F.struct(F.round(-F.col("lift"), 9).alias("l"), F.col("nation").alias("n")))
    return out.groupBy("fn", "cluster").agg(top.alias("t")).select("fn", "cluster", F.col("t.n").alias("peak"), F.round(-F.col("t.l"), 6).alias("lift"))


def same_peak_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of groups that share their peak nation in one function."""
    peaks = peak_cells(spark, folder).select("fn", "cluster", "peak")
    other = peaks.select("fn", F.col("cluster").alias("other"), "peak")
    return peaks.join(other, ["fn", "peak"]).filter("cluster < other").select("fn", "peak", "cluster", "other")


QUERIES = {f.__name__: f for f in (
    core_shell, core_shell_summary, cell_shares, boilerplate, cell_profiles_posting, cell_profiles_company, profile_distances, js_index, overlap_index, leave_one_cell_out,
    factor_power, factor_ranking, bootstrap_summary, bootstrap_ratio, permutation_null, career_delta, geo_overlap, residual_by_function, residual_reason, threshold_grid, size_grid, peak_cells, same_peak_pairs,
)}


def _shares(fn: str, cell: str, cluster: str, unit: str = "posting", where: str = "TRUE", source: str = "facts") -> str:
    """CTEs sh(fn, cell, k, hits, total, share) over `source`."""
    return f"""s AS (SELECT DISTINCT {fn} AS fn, {cell} AS cell, {cluster} AS k, {unit} AS u FROM {source} WHERE {where}),
h AS (SELECT fn, cell, k, count(*) AS hits FROM s GROUP BY 1, 2, 3), t AS (SELECT fn, cell, count(DISTINCT u) AS total FROM s GROUP BY 1, 2),
sh AS (SELECT h.fn, h.cell, k, hits, total, hits / total AS share FROM h JOIN t ON h.fn = t.fn AND h.cell = t.cell)"""


#: Distances by the textbook formula over the union of clusters, as an independent check of the shared-cluster sums.
_DIST = """n AS (SELECT fn, cell, k, share, share / sum(share) OVER (PARTITION BY fn, cell) AS p FROM sh), c AS (SELECT DISTINCT fn, cell FROM sh), ks AS (SELECT DISTINCT fn, k FROM sh),
g AS (SELECT a.fn, a.cell AS cell_a, b.cell AS cell_b, ks.k FROM c a JOIN c b ON a.fn = b.fn AND a.cell < b.cell JOIN ks ON ks.fn = a.fn),
v AS (SELECT g.*, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q, coalesce(x.share, 0) AS sa, coalesce(y.share, 0) AS sb FROM g
LEFT JOIN n x ON x.fn = g.fn AND x.cell = cell_a AND x.k = g.k LEFT JOIN n y ON y.fn = g.fn AND y.cell = cell_b AND y.k = g.k),
d AS (SELECT fn, cell_a, cell_b, sqrt(greatest(0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS js,
1 - sum(sa * sb) / sqrt(sum(sa * sa) * sum(sb * sb)) AS cosine, 1 - sum(least(p, q)) AS overlap FROM v GROUP BY 1, 2, 3)"""

#: Shares of 1,000 resamples: the weight of a unit in draw d is read from 16 bits of a SHA-256 (profiles.draw_weights).
_EDGES = " ".join(f"WHEN u < {edge} THEN {k}" for k, edge in enumerate(P.poisson_edges()))
_DRAWS = f"""s0 AS (SELECT DISTINCT fn, industry AS cell, cluster AS k, posting AS u FROM facts), un AS (SELECT DISTINCT u FROM s0),
hx AS (SELECT un.u, b, sha256('20260911|' || un.u || '|' || b) AS h FROM un, range(0, 63) r(b)),
w AS (SELECT unit, draw, CASE {_EDGES} ELSE 7 END AS w FROM (SELECT u AS unit, b * 16 + i AS draw, ('0x' || substr(h, 1 + 4 * i::INT, 4))::INT AS u FROM hx, range(0, 16) q(i)) WHERE draw < 1000),
h AS (SELECT fn, draw, cell, k, sum(w) AS hits FROM s0 JOIN w ON unit = u WHERE w > 0 GROUP BY ALL), t AS (SELECT fn, draw, cell, sum(w) AS total FROM (SELECT DISTINCT fn, cell, u FROM s0) JOIN w ON unit = u GROUP BY ALL),
sh AS (SELECT fn || '|' || h.draw AS fn, cell, k, hits / total AS share FROM h JOIN t USING (fn, draw, cell)), {_DIST}, j AS (SELECT split_part(fn, '|', 1) AS fn, split_part(fn, '|', 2)::INT AS draw, avg(js) AS js FROM d GROUP BY ALL)"""

_CORE = f"""WITH {FACTS_SQL}, {_shares('fn', 'nation', 'cluster')},
f AS (SELECT fn, k, count(DISTINCT u) AS fh FROM s GROUP BY 1, 2), ft AS (SELECT fn, count(DISTINCT u) AS fnt FROM s GROUP BY 1),
cs AS (SELECT sh.fn, cell AS nation, sh.k AS cluster, hits, total, share, fh / fnt AS function_share, share / nullif(fh / fnt, 0) AS lift, hits >= 20 AS reliable,
CASE WHEN share / nullif(fh / fnt, 0) >= 1.75 AND share >= 0.03 AND hits >= 20 THEN 'shell' WHEN share >= 0.05 AND abs(share / nullif(fh / fnt, 0) - 1) <= 0.35 THEN 'core' ELSE 'neither' END AS verdict
FROM sh JOIN f ON sh.fn = f.fn AND sh.k = f.k JOIN ft ON sh.fn = ft.fn)"""
_LONG = "fl AS (" + " UNION ALL ".join(f"SELECT posting, fn, cluster, '{f}' AS factor, {f} AS level FROM facts" for f in FACTORS).replace("level AS level", "level") + ")"

ORACLES = {
    "core_shell": _CORE + " SELECT fn, nation, cluster, hits, total, round(share, 6) AS share, round(function_share, 6) AS function_share, round(lift, 6) AS lift, reliable, verdict FROM cs",
    "core_shell_summary": _CORE + """, a AS (SELECT fn, nation, count(*) FILTER (verdict = 'core') AS core, count(*) FILTER (verdict = 'shell') AS shell, count(*) FILTER (verdict = 'neither') AS neither FROM cs GROUP BY 1, 2),
b AS (SELECT fn, nation, cluster, lift FROM cs WHERE verdict = 'shell' QUALIFY row_number() OVER (PARTITION BY fn, nation ORDER BY lift DESC, cluster) = 1)
SELECT a.*, b.cluster AS top_shell, round(b.lift, 6) AS top_lift FROM a LEFT JOIN b ON a.fn = b.fn AND a.nation = b.nation""",
    "cell_shares": f"WITH {FACTS_SQL}, {_shares('fn', 'industry', 'cluster')} SELECT fn, cell AS industry, k AS cluster, hits, total, round(share, 6) AS share FROM sh",
    "boilerplate": f"""WITH {FACTS_SQL}, {_shares('fn', 'industry', 'size')}, b AS (SELECT k, count(*) AS cells, avg(share) AS mean, min(share) AS low, max(share) AS high, stddev_samp(share) AS std FROM sh GROUP BY 1)
SELECT k AS size, cells, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(std, 6) AS std, round(coalesce(std / mean, 0), 6) AS cv, mean >= 0.1 AND coalesce(std / mean, 0) <= 0.6 AS boilerplate FROM b""",
    "cell_profiles_posting": f"WITH {FACTS_SQL}, {_shares('1', 'industry', 'cluster', where="cluster <> 'small ring'")} SELECT cell AS industry, k AS cluster, hits, total, round(share, 6) AS share FROM sh",
    "cell_profiles_company": f"WITH {FACTS_SQL}, {_shares('1', 'industry', 'cluster', 'company')} SELECT cell AS industry, k AS cluster, hits, total, round(share, 6) AS share FROM sh",
    "profile_distances": f"WITH {FACTS_SQL}, {_shares('1', 'nation', 'brand')}, {_DIST} SELECT cell_a, cell_b, round(js, 6) AS js, round(cosine, 6) AS cosine, round(overlap, 6) AS overlap FROM d",
    "js_index": f"WITH {FACTS_SQL}, {_shares('fn', 'nation', 'brand')}, {_DIST} SELECT fn, round(avg(js), 6) AS js, round(avg(cosine), 6) AS cosine, round(min(js), 6) AS js_min, round(max(js), 6) AS js_max FROM d GROUP BY 1",
    "overlap_index": f"""WITH {FACTS_SQL}, {_shares('1', 'industry', 'cluster')}, {_DIST} SELECT cell_a, cell_b, round(overlap, 6) AS overlap,
row_number() OVER (PARTITION BY cell_a ORDER BY round(overlap, 9), cell_b) AS rank FROM d""",
    "leave_one_cell_out": f"""WITH {FACTS_SQL}, {_shares('1', 'industry', 'cluster')}, {_DIST}, n2 AS (SELECT DISTINCT cell AS x FROM sh)
SELECT x AS without, round(avg(js), 6) AS js FROM n2 JOIN d ON cell_a <> x AND cell_b <> x GROUP BY 1""",
    "factor_power": f"""WITH {FACTS_SQL}, {_LONG}, n AS (SELECT factor, level, {', '.join(f"count(DISTINCT posting) FILTER (fn = '{f}') AS n_{f}" for f in 'FOP')} FROM fl GROUP BY 1, 2)
SELECT *, least(n_F, n_O, n_P) >= 100 AS powered FROM n""",
    "factor_ranking": f"""WITH {FACTS_SQL}, {_LONG}, {_shares('factor', 'level', 'cluster', source='fl')}, {_DIST}, i AS (SELECT fn AS factor, avg(js) AS js FROM d GROUP BY 1)
SELECT factor, round(js, 6) AS js, row_number() OVER (ORDER BY round(js, 9) DESC, factor) AS rank FROM i""",
    "career_delta": f"""WITH {FACTS_SQL}, {_shares('1', 'level', 'cluster')}, ks AS (SELECT DISTINCT k FROM sh WHERE cell IN ('5-LOW', '1-URGENT')),
x AS (SELECT ks.k AS cluster, coalesce(b.share, 0) - coalesce(a.share, 0) AS delta FROM ks LEFT JOIN sh a ON a.k = ks.k AND a.cell = '5-LOW' LEFT JOIN sh b ON b.k = ks.k AND b.cell = '1-URGENT')
(SELECT cluster, round(delta, 6) AS delta, 'gain' AS side FROM x ORDER BY round(x.delta, 9) DESC, cluster LIMIT 8) UNION ALL (SELECT cluster, round(delta, 6), 'loss' FROM x ORDER BY round(x.delta, 9), cluster LIMIT 8)""",
    "geo_overlap": f"""WITH {FACTS_SQL}, {_shares('industry', 'nation', 'cluster')}, tot AS (SELECT fn, cell, max(total) AS t FROM sh GROUP BY 1, 2), q AS (SELECT a.fn, a.cell AS origin, b.cell AS target, a.t AS ta, b.t AS tb FROM tot a JOIN tot b ON a.fn = b.fn AND a.cell <> b.cell)
SELECT q.fn AS industry, origin, target, round(CASE WHEN min(ta) >= 60 AND min(tb) >= 60 THEN sum(least(coalesce(x.share, 0), y.share)) / sum(y.share) END, 6) AS kept FROM q
JOIN sh y ON y.fn = q.fn AND y.cell = target LEFT JOIN sh x ON x.fn = q.fn AND x.cell = origin AND x.k = y.k GROUP BY 1, 2, 3""",
    "bootstrap_summary": f"""WITH {FACTS_SQL}, {_DRAWS} SELECT fn, count(*) AS draws, round(avg(js), 6) AS mean, round(quantile_cont(js, 0.025), 6) AS low, round(quantile_cont(js, 0.975), 6) AS high FROM j GROUP BY 1""",
    "bootstrap_ratio": f"""WITH {FACTS_SQL}, {_DRAWS}, r AS (SELECT a.js / b.js AS r FROM j a JOIN j b ON a.draw = b.draw AND a.fn = 'F' AND b.fn = 'O')
SELECT count(*) AS draws, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, round(avg(CASE WHEN r > 1 THEN 1.0 ELSE 0.0 END), 6) AS above_one FROM r""",
    "permutation_null": f"""WITH {FACTS_SQL}, s0 AS (SELECT DISTINCT industry AS cell, cluster AS k, posting AS u FROM facts), un AS (SELECT DISTINCT u, cell FROM s0), z AS (SELECT cell, count(*) AS n FROM un GROUP BY 1),
e AS (SELECT cell AS new, sum(n) OVER (ORDER BY cell) / sum(n) OVER () AS hi, coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS lo FROM z),
pv AS (SELECT u, draw, ('0x' || substr(sha256('7|' || u || '|' || draw), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS x FROM un, range(0, 40) r(draw)), pg AS (SELECT u, draw, new AS cell FROM pv JOIN e ON x >= lo AND x < hi),
h AS (SELECT draw, pg.cell, k, count(*) AS hits FROM (SELECT DISTINCT u, k FROM s0) a JOIN pg ON a.u = pg.u GROUP BY ALL), t AS (SELECT draw, cell, count(*) AS total FROM pg GROUP BY ALL),
sh AS (SELECT draw AS fn, cell, k, hits / total AS share FROM h JOIN t USING (draw, cell)), {_DIST} SELECT fn AS draw, round(avg(js), 6) AS js FROM d GROUP BY 1""",
    "residual_by_function": f"""WITH {FACTS_SQL}, x AS (SELECT fn, quantity, CASE WHEN type IN ('PROMO', 'ECONOMY') THEN 1.0 ELSE 0.0 END AS l FROM facts)
SELECT fn, count(*) AS atoms, round(avg(l), 6) AS residual, round(avg(l) FILTER (quantity >= 10), 6) AS residual_clean FROM x GROUP BY 1""",
    "residual_reason": f"""WITH {FACTS_SQL}, p AS (SELECT cluster, avg(CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END) AS e, avg(CASE WHEN quantity > 25 THEN 1.0 ELSE 0.0 END) AS c, min(type) AS type FROM facts GROUP BY 1),
r AS (SELECT cluster, CASE WHEN type = 'ECONOMY' THEN CASE WHEN e >= 0.335 THEN 'structural' ELSE 'other' END WHEN e >= 0.33 AND c >= 0.5 THEN 'novelty' WHEN e < 0.33 AND c < 0.5 THEN 'vagueness' ELSE 'other' END AS reason FROM p),
n AS (SELECT fn, reason, count(*) AS n FROM facts JOIN r ON facts.cluster = r.cluster GROUP BY 1, 2)
SELECT fn, reason, n, round(n / sum(n) OVER (PARTITION BY fn), 6) AS share FROM n""",
    "threshold_grid": _CORE + """, g AS (SELECT l.l AS min_lift, m.m AS min_share FROM (VALUES (1.25), (1.5), (1.75), (2.0), (2.25)) l(l), (VALUES (0.02), (0.03), (0.05)) m(m))
SELECT min_lift::DOUBLE AS min_lift, min_share::DOUBLE AS min_share, count(*) FILTER (lift >= min_lift AND share >= min_share AND hits >= 20) AS shells,
count(*) FILTER (lift >= min_lift AND share >= min_share AND hits >= 20 AND fn = 'F') AS shells_f FROM cs, g GROUP BY 1, 2""",
    "size_grid": f"""WITH {FACTS_SQL}, n AS (SELECT nation, {', '.join(f"count(DISTINCT posting) FILTER (fn = '{f}') AS n_{f}" for f in 'FOP')} FROM facts GROUP BY 1)
SELECT threshold, count(*) FILTER (least(n_F, n_O, n_P) >= threshold) AS cells FROM n, (VALUES (100), (150), (180), (200), (300)) t(threshold) GROUP BY 1""",
    "peak_cells": _CORE + " SELECT fn, cluster, nation AS peak, round(lift, 6) AS lift FROM cs QUALIFY row_number() OVER (PARTITION BY fn, cluster ORDER BY round(-lift, 9), nation) = 1",
    "same_peak_pairs": _CORE + """, p AS (SELECT fn, cluster, nation AS peak FROM cs QUALIFY row_number() OVER (PARTITION BY fn, cluster ORDER BY round(-lift, 9), nation) = 1)
SELECT a.fn, a.peak, a.cluster, b.cluster AS other FROM p a JOIN p b ON a.fn = b.fn AND a.peak = b.peak AND a.cluster < b.cluster""",
}
