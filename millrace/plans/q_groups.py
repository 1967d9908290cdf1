"""Queries of employers, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import employers as E
from millrace.operators import graph as G
from millrace.operators import vectors as V
from millrace.operators.base import band
from millrace.plans.star import FACTS_SQL, adverts, facts
from millrace.sources.tables import table


def employer_gini(spark: SparkSession, folder: str) -> DataFrame:
    out = E.gini(adverts(spark, folder).groupBy("company").agg(F.count(F.lit(1)).alias("n_adverts")), "n_adverts")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("gini", "top_1_pct", "top_5_pct", "top_10_pct", "top_25_pct")])


def volume_bands(spark: SparkSession, folder: str) -> DataFrame:
    per = adverts(spark, folder).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("band", band(F.col("n"), [5, 10, 15], ["1-5", "6-10", "11-15", "16+"])).groupBy("band").agg(F.count(F.lit(1)).alias("companies"), F.sum("n").alias("adverts"))


def cap_per_employer(spark: SparkSession, folder: str) -> DataFrame:
    return E.cap_per_employer(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


def employer_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Share of adverts and share of companies that ask for each group, in every industry."""
    rows = facts(spark, folder)
    totals = rows.groupBy("industry").agg(F.count_distinct("posting").alias("p"), F.count_distinct("company").alias("c"))
    out = rows.groupBy("industry", "cluster").agg(F.count_distinct("posting").alias("postings"), F.count_distinct("company").alias("companies"))
    return out.join(totals, "industry").select("industry", "cluster", F.round(F.col("postings") / F.col("p"), 6).alias("posting_share"), F.round(F.col("companies") / F.col("c"), 6).alias("company_share"))


def content_dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    return E.dedup_exact(E.content_sets(facts(spark, folder), "company", "posting", "brand"), "company", "posting")


def content_dedup_leader(spark: SparkSession, folder: str) -> DataFrame:
    return E.dedup_leader(E.content_sets(facts(spark, folder), "company", "posting", "type"), "company", "posting", 0.75)


def employer_self_similarity(spark: SparkSession, folder: str) -> DataFrame:
    out = E.self_similarity(E.content_sets(facts(spark, folder), "company", "posting", "type"), "company", "posting", 300, 5)
    return out.withColumn("similarity", F.round("similarity", 6))


def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of parts that stand in one order; all lines count, each part is linked to the smallest of its order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return G.connected_components(lines.join(first, "l_orderkey").select("a", F.col("l_partkey").alias("b")).filter("a < b"))


def alias_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Requirement groups after groups of one topic were renamed to the commonest of them."""
    rows = table(spark, folder, "req_cores").groupBy("req_group", "req_topic").agg(F.sum("n").alias("n"))
    alias = G.fold_labels(rows.filter("req_topic IS NOT NULL"), "req_group", "req_topic", "n")
    facts_ = table(spark, folder, "requirements").filter("trim(req_group) <> ''").select("req_id", "req_group").distinct()
    return G.apply_aliases(facts_, "req_group", alias).groupBy("req_group").agg(F.count(F.lit(1)).alias("rows"))


def label_fold(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "title_dictionary").select("title_key", "title_group", "n")
    return G.fold_labels(rows, "title_key", "title_group", "n")


def vote_majority(spark: SparkSession, folder: str) -> DataFrame:
    """Three passes over the customers, with majority and unanimity."""
    c = table(spark, folder, "customer")
    votes = [c.select("c_custkey", (F.col("c_acctbal") > x).alias("v")) for x in (0.0, 2000.0, 5000.0)]
    return G.majority(votes, "c_custkey", "v")


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    out = V.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return out.select("label", "n", F.round(F.element_at("centroid", 1), 5).alias("c1"), F.round(F.element_at("centroid", 2), 5).alias("c2"), F.round(F.element_at("centroid", 64), 5).alias("c64"))


def _best(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return V.best_two(rows, "vec_id", "embedding", V.centroids(rows, "label", "embedding"), "label", "centroid")


def assign_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return V.assign(_best(spark, folder)).select("vec_id", "cluster", "similarity")


def prototype_margin(spark: SparkSession, folder: str) -> DataFrame:
    return V.margin_type(_best(spark, folder)).select("vec_id", "type", F.round("best_cos", 4).alias("best_cos"))


def residual_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors per band of similarity to their nearest centroid."""
    return V.similarity_bands(_best(spark, folder).withColumnRenamed("best_cos", "cosine")).withColumnRenamed("pairs", "vectors")


def threshold_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of one label with a cosine of 0.30 or more."""
    return V.near_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.3).select(F.col("block").alias("label"), "a", "b", F.round("cosine", 4).alias("cosine"))


def one_hop_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with the neighbour it joins; frequencies are 1 + the id modulo 7."""
    pairs = V.near_pairs(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.3)
    nodes = table(spark, folder, "embeddings").selectExpr("vec_id AS id", "1 + vec_id % 7 AS n")
    return V.one_hop(nodes, pairs)


def separation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """How well the similarity to the nearest centroid tells right assignments from wrong ones."""
    best = _best(spark, folder).join(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id")
    own = best.select((F.col("best") == F.col("label")).alias("right"), F.round(F.col("best_cos") - F.col("second_cos"), 6).alias("margin"))
    extra = table(spark, folder, "embeddings").select((F.col("vec_id") % 2 == 0).alias("right"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("margin"))
    return V.separation_stats(own.unionByName(extra), "right", "margin").select(F.round("cohens_d", 5).alias("cohens_d"), F.round("auc", 5).alias("auc"))


QUERIES = {f.__name__: f for f in (
    employer_gini, volume_bands, cap_per_employer, employer_unit, content_dedup_exact, content_dedup_leader, employer_self_similarity, connected_components, alias_apply, label_fold,
    vote_majority, centroids, assign_nearest, prototype_margin, residual_bands, threshold_pairs, one_hop_groups, separation_stats,
)}

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)"
_CENT = f"""{_UNIT}, e AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM u), s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY 1, 2),
c AS (SELECT label, list(s ORDER BY pos) AS s FROM s GROUP BY 1), k AS (SELECT label, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS c FROM c)"""
_BEST = f"""{_CENT}, d AS (SELECT vec_id, u.label AS own, k.label, round(list_dot_product(v, c), 9) AS cos FROM u, k),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS r FROM d),
b AS (SELECT vec_id, any_value(own) AS own, max(label) FILTER (r = 1) AS best, max(cos) FILTER (r = 1) AS best_cos, max(cos) FILTER (r = 2) AS second_cos FROM r GROUP BY 1)"""
_PAIRS = f"{_UNIT}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 9) AS cosine FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 9) >= 0.3)"

ORACLES = {
    "employer_gini": """WITH c AS (SELECT count(*)::DOUBLE AS x FROM orders GROUP BY o_custkey), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, row_number() OVER (ORDER BY x DESC) AS j, count(*) OVER () AS n FROM c)
SELECT max(n) AS n, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 6) AS gini, round(sum(x) FILTER (j <= greatest(1, ceil(n * 1 / 100))) / sum(x), 6) AS top_1_pct, round(sum(x) FILTER (j <= greatest(1, ceil(n * 5 / 100))) / sum(x), 6) AS top_5_pct,
round(sum(x) FILTER (j <= greatest(1, ceil(n * 10 / 100))) / sum(x), 6) AS top_10_pct, round(sum(x) FILTER (j <= greatest(1, ceil(n * 25 / 100))) / sum(x), 6) AS top_25_pct FROM r""",
    "volume_bands": """WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 15 THEN '11-15' ELSE '16+' END AS band, count(*) AS companies, sum(n)::BIGINT AS adverts FROM c GROUP BY 1""",
    "cap_per_employer": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5",
    "employer_unit": f"""WITH {FACTS_SQL}, t AS (SELECT industry, count(DISTINCT posting) AS p, count(DISTINCT company) AS c FROM facts GROUP BY 1)
SELECT f.industry, cluster, round(count(DISTINCT posting) / any_value(p), 6) AS posting_share, round(count(DISTINCT company) / any_value(c), 6) AS company_share FROM facts f JOIN t ON f.industry = t.industry GROUP BY 1, 2""",
    "employer_self_similarity": f"""WITH {FACTS_SQL}, s AS (SELECT company, posting, list(DISTINCT type) AS items, ('0x' || substr(sha256('5|' || posting), 1, 10))::BIGINT / 1099511627776.0::DOUBLE AS u FROM facts GROUP BY 1, 2),
r AS (SELECT company, items, lead(items) OVER w AS nxt, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY company ORDER BY u, posting)), p AS (SELECT company, len(list_intersect(items, nxt)) AS i, len(items) AS a, len(nxt) AS b FROM r WHERE nxt IS NOT NULL AND r <= 300)
SELECT company, count(*) AS pairs, round(avg(i / (a + b - i)), 6) AS similarity FROM p GROUP BY 1""",
    "content_dedup_exact": f"""WITH {FACTS_SQL}, s AS (SELECT company, posting, list_sort(list(DISTINCT brand)) AS items FROM facts GROUP BY 1, 2)
SELECT company, count(*) AS adverts, count(DISTINCT items) AS distinct_adverts FROM s GROUP BY 1""",
    "connected_components": """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.p AS a, b.p AS b FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p),
w(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(w.root) FROM w JOIN e ON w.node = e.a JOIN recurring.w AS r ON r.node = e.b WHERE w.root < r.root GROUP BY 1)
SELECT node, root FROM w""",
    "alias_apply": """WITH g AS (SELECT req_group, req_topic, sum(n) AS n FROM req_cores WHERE req_topic IS NOT NULL GROUP BY 1, 2),
b AS (SELECT req_topic, req_group AS target FROM g QUALIFY row_number() OVER (PARTITION BY req_topic ORDER BY n DESC, req_group) = 1), a AS (SELECT g.req_group, target FROM g JOIN b ON g.req_topic = b.req_topic),
f AS (SELECT DISTINCT req_id, req_group FROM requirements WHERE trim(req_group) <> '')
SELECT coalesce(target, f.req_group) AS req_group, count(*) AS rows FROM f LEFT JOIN a ON f.req_group = a.req_group GROUP BY 1""",
    "label_fold": """WITH b AS (SELECT title_group, title_key AS target FROM title_dictionary QUALIFY row_number() OVER (PARTITION BY title_group ORDER BY n DESC, title_key) = 1)
SELECT title_key AS node, target FROM title_dictionary d JOIN b ON d.title_group = b.title_group""",
    "vote_majority": """SELECT c_custkey, y AS yes, 3 AS drawn, y * 2 > 3 AS majority, y IN (0, 3) AS unanimous FROM (SELECT c_custkey, (c_acctbal > 0)::INT + (c_acctbal > 2000)::INT + (c_acctbal > 5000)::INT AS y FROM customer)""",
    "centroids": f"WITH {_CENT}, n AS (SELECT label, count(*) AS n FROM u GROUP BY 1) SELECT k.label, n, round(c[1], 5) AS c1, round(c[2], 5) AS c2, round(c[64], 5) AS c64 FROM k JOIN n ON k.label = n.label",
    "assign_nearest": f"WITH {_BEST} SELECT vec_id, CASE WHEN best_cos >= 0.55 THEN best ELSE -1 END AS cluster, round(best_cos, 4) AS similarity FROM b",
    "prototype_margin": f"WITH {_BEST} SELECT vec_id, CASE WHEN best_cos >= 0.2 AND best_cos - second_cos >= 0.02 THEN best END AS type, round(best_cos, 4) AS best_cos FROM b",
    "residual_bands": f"WITH {_BEST} SELECT floor(best_cos * 20) / 20 AS band, count(*) AS vectors FROM b GROUP BY 1",
    "threshold_pairs": f"WITH {_PAIRS} SELECT label, a, b, round(cosine, 4) AS cosine FROM p",
    "one_hop_groups": f"""WITH {_PAIRS}, n AS (SELECT vec_id AS id, 1 + vec_id % 7 AS n FROM embeddings), x AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (SELECT a, b, n.n AS nb FROM x JOIN n ON n.id = x.b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n.n DESC, b) = 1)
SELECT id, n, CASE WHEN nb > n OR (nb = n AND b < id) THEN b ELSE id END AS target FROM n LEFT JOIN t ON t.a = n.id""",
    "separation_stats": f"""WITH {_BEST}, sc AS (SELECT best = own AS r, round(best_cos - second_cos, 6) AS m FROM b UNION ALL SELECT vec_id % 2 = 0, round(embedding[1]::DOUBLE, 6) FROM embeddings),
a AS (SELECT avg(m) FILTER (r) AS m1, var_samp(m) FILTER (r) AS v1, count(*) FILTER (r) AS n1, avg(m) FILTER (NOT r) AS m0, var_samp(m) FILTER (NOT r) AS v0, count(*) FILTER (NOT r) AS n0 FROM sc),
w AS (SELECT sum(CASE WHEN x.m > y.m THEN 1.0 WHEN x.m = y.m THEN 0.5 ELSE 0 END) AS w FROM sc x, sc y WHERE x.r AND NOT y.r)
SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS cohens_d, round(w / (n1 * n0), 5) AS auc FROM a, w""",
}
