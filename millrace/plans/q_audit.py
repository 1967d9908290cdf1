"""Queries of the analysis base and the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import audit, base
from millrace.plans.star import ADVERTS_SQL, FACTS_SQL, adverts, facts
from millrace.sources.tables import table

KEY = ["o_custkey", "o_orderstatus", "o_orderpriority"]
FNS = ["F", "O", "P"]
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EXCLUDED = ["HOUSEHOLD"]
SHOP = [("porter", r"\bporter\b"), ("driver", r"\bdriver\b"), ("carpenter", r"\bcarpenter\b"), ("cook", r"\bcook\b"), ("sweep", r"\bsweep\b")]
B2B = [("key account", r"key account"), ("partner", r"channel partner"), ("sales", r"\bsales\b"), ("business development", r"business development")]
SIGNAL = r"[0-9]+\+? years"
COMPOUND = r" and | or |/"


def repeat_mark(spark: SparkSession, folder: str) -> DataFrame:
    """Size, weight and first row of every repeat group of orders."""
    out = base.mark_repeats(table(spark, folder, "orders"), KEY, ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", "repeat_group_size", F.round("repeat_weight", 6).alias("repeat_weight"), "is_repeat_first")


def repeat_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest order of every repeat group."""
    return base.collapse_repeats(table(spark, folder, "orders"), KEY, ["o_orderdate", "o_orderkey"]).select("o_orderkey", *KEY, "o_totalprice")


def repeat_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return base.repeat_diagnostic(table(spark, folder, "orders"), KEY, ["o_totalprice", "o_orderdate", "o_orderkey"])


def repeat_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings")
    return base.compare_repeat_rules(rows, {"id": ["id"], "id_title": ["id", "title"], "company_title": ["company_id", "title"], "company_country_title": ["company_id", "geo_country", "title"]})


def exclusion_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    """Postings removed by each exclusion in order, and what remains."""
    rows = table(spark, folder, "postings")
    marked = base.mark_repeats(rows, ["company_id", "geo_country", "title", "must_have"], ["received_at", "posting_row"])
    country = F.trim(F.coalesce("geo_country", F.lit("")))
    return base.waterfall(marked, [
        ("blank country", country == ""), ("excluded country", F.upper(country).isin("POLAND")), ("repeat", ~F.col("is_repeat_first")),
        ("blank must_have", F.coalesce(F.size("must_have"), F.lit(0)) <= 0), ("shop floor", base.first_match(F.lower(F.coalesce("title", F.lit(""))), SHOP).isNotNull()),
    ])


def role_flags(spark: SparkSession, folder: str) -> DataFrame:
    out = base.role_flags(table(spark, folder, "postings").select("posting_row", "title"), "title", SHOP, B2B)
    return out.select("posting_row", "shop_floor", "b2b", "shop_kind", "b2b_kind", "role_family")


def scope_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    """Size and share of each role family per country."""
    rows = table(spark, folder, "postings").select(F.upper(F.trim(F.coalesce("geo_country", F.lit("")))).alias("country"), "title")
    out = base.role_flags(rows, "title", SHOP, B2B)
    return out.groupBy("country").agg(F.count(F.lit(1)).alias("rows"), F.count_if("shop_floor").alias("shop_floor"), F.count_if(F.col("role_family") == "b2b").alias("b2b"), F.round(100 * F.avg(F.col("shop_floor").cast("double")), 6).alias("shop_floor_pct"))


def cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "nation").selectExpr("n_name AS nation")
    return base.cell_counts(adverts(spark, folder), cells, "nation", "fn", FNS, 180)


def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").withColumn("level", F.coalesce(F.nullif(F.lower(F.trim("seniority")), F.lit("")), F.lit("(none)")))
    return audit.dataset_summary(rows, "level", ["company_id", "geo_country", "title"], F.coalesce(F.size("must_have"), F.lit(0)) > 6, "received_at")


def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return audit.field_coverage(table(spark, folder, "postings"), ["id", "title", "language", "company_id", "geo_country", "seniority", "created_at", "received_at"])


def function_profile(spark: SparkSession, folder: str) -> DataFrame:
    return audit.value_profile(adverts(spark, folder), ["industry", "level"], "fn", FNS)


def function_separation(spark: SparkSession, folder: str) -> DataFrame:
    return audit.separation(adverts(spark, folder), "level", "company")


def employer_concentration(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select(F.upper(F.trim(F.coalesce("geo_country", F.lit("")))).alias("country"), base.blank_to_null("company_id").alias("company_id"))
    return audit.employer_concentration(rows, ["country"], "company_id", 0.10)


def recoverability(spark: SparkSession, folder: str) -> DataFrame:
    return audit.hit_rate(table(spark, folder, "requirements"), "route", "item", SIGNAL)


def extraction_exposure(spark: SparkSession, folder: str) -> DataFrame:
    """Share of long and of compound atoms per route."""
    rows = table(spark, folder, "requirements")
    long, compound = F.length("atom") > 60, F.lower("atom").rlike(COMPOUND)
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("atoms"), F.round(100 * F.avg(long.cast("double")), 6).alias("long_pct"), F.round(100 * F.avg((long | compound).cast("double")), 6).alias("risk_pct"))


def atomisation_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Items in, atoms out, expansion, atoms per posting and the median length."""
    rows = table(spark, folder, "requirements").filter("trim(coalesce(posting_id, '')) <> ''").dropDuplicates(["req_id"])
    out = rows.agg(
        F.count(F.lit(1)).alias("atoms"), F.count_distinct("posting_id", "item_idx").alias("items"), F.count_distinct("posting_id").alias("postings"),
        F.expr("percentile(length(atom), 0.5)").alias("median_length"), F.count_distinct("item").alias("distinct_items"), F.count_distinct("atom_norm").alias("distinct_atoms"),
    )
    return out.withColumn("per_item", F.round(F.col("atoms") / F.col("items"), 6)).withColumn("per_posting", F.round(F.col("atoms") / F.col("postings"), 6))


def type_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return audit.type_distribution(facts(spark, folder), "type", "cluster")


def type_mix(spark: SparkSession, folder: str) -> DataFrame:
    return audit.crosstab_share(facts(spark, folder), "type", "fn", FNS)


def top_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 commonest normalised atoms (the report's own length)."""
    return audit.top_values(table(spark, folder, "requirements"), "atom_norm", 15, F.min("head_group").alias("head_group"))


def sensitivity_diff(spark: SparkSession, folder: str) -> DataFrame:
    def share(df: DataFrame) -> DataFrame:
        return df.groupBy("cluster").agg(F.round(F.avg((F.col("fn") == "F").cast("double")), 6).alias("share"))

    return audit.with_sensitivity(facts(spark, folder), share, F.col("quantity") < 40, ["cluster"], "share")


def risk_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Adverts by share of small lines, in four bands."""
    per = facts(spark, folder).groupBy("posting").agg((100 * F.avg((F.col("quantity") < 10).cast("double"))).alias("pct"))
    banded = per.withColumn("band", base.band(F.col("pct"), [0, 25, 50], ["none", "low", "middle", "high"]))
    return banded.groupBy("band").agg(F.count(F.lit(1)).alias("postings"), F.round(F.avg("pct"), 6).alias("mean_pct"))


QUERIES = {f.__name__: f for f in (
    repeat_mark, repeat_collapse, repeat_diagnostic, repeat_rules, exclusion_waterfall, role_flags, scope_by_segment, cell_counts, dataset_summary, field_coverage,
    function_profile, function_separation, employer_concentration, recoverability, extraction_exposure, atomisation_stats, type_distribution, type_mix, top_phrases, sensitivity_diff, risk_bands,
)}


def _bank(text: str, bank: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in bank) + " END"


_TITLE = "lower(coalesce(title, ''))"
_ROLES = f"r AS (SELECT posting_row, upper(trim(coalesce(geo_country, ''))) AS country, {_bank(_TITLE, SHOP)} AS shop_kind, {_bank(_TITLE, B2B)} AS b2b_kind FROM postings)"
_PIVOT = ", ".join(f"count(*) FILTER (fn = '{f}') AS {f}" for f in FNS)

ORACLES = {
    "repeat_mark": """SELECT o_orderkey, count(*) OVER w AS repeat_group_size, round(1.0 / count(*) OVER w, 6) AS repeat_weight,
row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1 AS is_repeat_first
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus, o_orderpriority)""",
    "repeat_collapse": """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1""",
    "repeat_diagnostic": """WITH g AS (SELECT count(*) AS n, count(DISTINCT o_totalprice) AS a, count(DISTINCT o_orderdate) AS b, count(DISTINCT o_orderkey) AS c
FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1),
s AS (SELECT 'o_totalprice' AS "column", a AS d FROM g UNION ALL SELECT 'o_orderdate', b FROM g UNION ALL SELECT 'o_orderkey', c FROM g)
SELECT "column", count(*) AS groups, count(*) FILTER (d > 1) AS varying, round(100 * (1 - count(*) FILTER (d > 1) / count(*)), 4) AS identical_pct FROM s GROUP BY 1""",
    "repeat_rules": """SELECT 'id' AS rule, count(*) - count(DISTINCT coalesce(id, chr(1))) AS removed FROM postings
UNION ALL SELECT 'id_title', count(*) - count(DISTINCT (coalesce(id, chr(1)), coalesce(title, chr(1)))) FROM postings
UNION ALL SELECT 'company_title', count(*) - count(DISTINCT (coalesce(company_id, chr(1)), coalesce(title, chr(1)))) FROM postings
UNION ALL SELECT 'company_country_title', count(*) - count(DISTINCT (coalesce(company_id, chr(1)), coalesce(geo_country, chr(1)), coalesce(title, chr(1)))) FROM postings""",
    "exclusion_waterfall": f"""WITH p AS (SELECT trim(coalesce(geo_country, '')) = '' AS a, upper(trim(coalesce(geo_country, ''))) = 'POLAND' AS b,
row_number() OVER (PARTITION BY company_id, geo_country, title, must_have ORDER BY received_at, posting_row) <> 1 AS c,
coalesce(len(must_have), 0) = 0 AS d, {_bank(_TITLE, SHOP)} IS NOT NULL AS e FROM postings),
n AS (SELECT count(*) AS t, count(*) FILTER (a) AS a, count(*) FILTER (b AND NOT a) AS b, count(*) FILTER (c AND NOT (a OR b)) AS c,
count(*) FILTER (d AND NOT (a OR b OR c)) AS d, count(*) FILTER (e AND NOT (a OR b OR c OR d)) AS e FROM p)
SELECT 1 AS step_no, 'blank country' AS step, a AS removed, t - a AS remaining FROM n UNION ALL SELECT 2, 'excluded country', b, t - a - b FROM n
UNION ALL SELECT 3, 'repeat', c, t - a - b - c FROM n UNION ALL SELECT 4, 'blank must_have', d, t - a - b - c - d FROM n
UNION ALL SELECT 5, 'shop floor', e, t - a - b - c - d - e FROM n""",
    "role_flags": f"""WITH {_ROLES} SELECT posting_row, shop_kind IS NOT NULL AS shop_floor, b2b_kind IS NOT NULL AS b2b, shop_kind, b2b_kind,
CASE WHEN shop_kind IS NOT NULL THEN 'shop_floor' WHEN b2b_kind IS NOT NULL THEN 'b2b' ELSE 'unclassified' END AS role_family FROM r""",
    "scope_by_segment": f"""WITH {_ROLES} SELECT country, count(*) AS rows, count(shop_kind) AS shop_floor, count(*) FILTER (shop_kind IS NULL AND b2b_kind IS NOT NULL) AS b2b,
round(100 * count(shop_kind) / count(*), 6) AS shop_floor_pct FROM r GROUP BY 1""",
    "cell_counts": f"""WITH {ADVERTS_SQL}, c AS (SELECT nation, {_PIVOT} FROM adverts GROUP BY 1)
SELECT n_name AS nation, coalesce(F, 0) AS F, coalesce(O, 0) AS O, coalesce(P, 0) AS P, coalesce(F, 0) >= 180 AS F_ok, coalesce(O, 0) >= 180 AS O_ok, coalesce(P, 0) >= 180 AS P_ok,
coalesce(F, 0) >= 180 AND coalesce(O, 0) >= 180 AND coalesce(P, 0) >= 180 AS paired FROM nation LEFT JOIN c ON n_name = c.nation""",
    "dataset_summary": """SELECT coalesce(nullif(lower(trim(seniority)), ''), '(none)') AS level, count(*) AS rows,
count(DISTINCT CASE WHEN trim(company_id) <> '' THEN company_id END) AS distinct_company_id, count(DISTINCT CASE WHEN trim(geo_country) <> '' THEN geo_country END) AS distinct_geo_country,
count(DISTINCT CASE WHEN trim(title) <> '' THEN title END) AS distinct_title, round(100 * avg(CASE WHEN coalesce(len(must_have), 0) > 6 THEN 1.0 ELSE 0.0 END), 6) AS flag_pct,
min(received_at) AS first_at, max(received_at) AS last_at FROM postings GROUP BY 1""",
    "field_coverage": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({v}) AS filled, round(100 * count({v}) / count(*), 6) AS coverage_pct, count(DISTINCT {v}) AS distinct_values FROM postings"
        for c in ["id", "title", "language", "company_id", "geo_country", "seniority", "created_at", "received_at"]
        for v in [f"CASE WHEN trim({c}::VARCHAR) <> '' THEN {c}::VARCHAR END"]
    ),
    "function_profile": f"""WITH {ADVERTS_SQL}, l AS (SELECT fn, 'industry' AS field, industry AS value FROM adverts UNION ALL SELECT fn, 'level', level FROM adverts),
c AS (SELECT field, value, {_PIVOT} FROM l GROUP BY 1, 2)
SELECT field, value, {', '.join(f'round({f} / sum({f}) OVER (PARTITION BY field), 6) AS share_{f}' for f in FNS)} FROM c""",
    "function_separation": f"""WITH {ADVERTS_SQL}, s AS (SELECT DISTINCT level, company FROM adverts)
SELECT a.level AS group_a, b.level AS group_b, count(*) AS common FROM s a JOIN s b ON a.company = b.company AND a.level < b.level GROUP BY 1, 2""",
    "employer_concentration": """WITH c AS (SELECT upper(trim(coalesce(geo_country, ''))) AS country, company_id, count(*) AS n FROM postings WHERE trim(company_id) <> '' GROUP BY 1, 2),
t AS (SELECT country, company_id, n, sum(n) OVER (PARTITION BY country) AS rows FROM c QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, company_id) = 1)
SELECT country, rows::BIGINT AS rows, company_id AS top_employer, n AS top_rows, round(100.0 * n / rows, 1) AS top_share, round(100.0 * n / rows, 1) >= 10 AS flagged FROM t""",
    "recoverability": f"""WITH h AS (SELECT route, nullif(regexp_extract(item, '{SIGNAL}'), '') AS f FROM requirements)
SELECT route, count(*) AS rows, count(f) AS hits, round(count(f) / count(*), 6) AS hit_rate, count(DISTINCT f) AS distinct_hits FROM h GROUP BY 1""",
    "extraction_exposure": f"""SELECT route, count(*) AS atoms, round(100 * avg(CASE WHEN length(atom) > 60 THEN 1.0 ELSE 0.0 END), 6) AS long_pct,
round(100 * avg(CASE WHEN length(atom) > 60 OR regexp_matches(lower(atom), '{COMPOUND}') THEN 1.0 ELSE 0.0 END), 6) AS risk_pct FROM requirements GROUP BY 1""",
    "atomisation_stats": """WITH r AS (SELECT DISTINCT ON (req_id) * FROM requirements WHERE trim(coalesce(posting_id, '')) <> '')
SELECT count(*) AS atoms, count(DISTINCT (posting_id, item_idx)) AS items, count(DISTINCT posting_id) AS postings, quantile_cont(length(atom)::DOUBLE, 0.5) AS median_length,
count(DISTINCT item) AS distinct_items, count(DISTINCT atom_norm) AS distinct_atoms, round(count(*) / count(DISTINCT (posting_id, item_idx)), 6) AS per_item,
round(count(*) / count(DISTINCT posting_id), 6) AS per_posting FROM r""",
    "type_distribution": f"""WITH {FACTS_SQL}, c AS (SELECT type, count(*) AS occurrences, count(DISTINCT cluster) AS distinct_texts FROM facts GROUP BY 1)
SELECT type, occurrences, distinct_texts, round(100 * occurrences / sum(occurrences) OVER (), 6) AS share_pct FROM c""",
    "type_mix": f"""WITH {FACTS_SQL}, c AS (SELECT type, {_PIVOT} FROM facts GROUP BY 1)
SELECT type, {', '.join(f'round({f} / sum({f}) OVER (), 6) AS share_{f}' for f in FNS)} FROM c""",
    "top_phrases": """SELECT atom_norm, count(*) AS n, min(head_group) AS head_group FROM requirements WHERE atom_norm IS NOT NULL GROUP BY 1 ORDER BY n DESC, atom_norm LIMIT 15""",
    "sensitivity_diff": f"""WITH {FACTS_SQL}, a AS (SELECT cluster, round(avg(CASE WHEN fn = 'F' THEN 1.0 ELSE 0.0 END), 6) AS s FROM facts GROUP BY 1),
b AS (SELECT cluster, round(avg(CASE WHEN fn = 'F' THEN 1.0 ELSE 0.0 END), 6) AS s FROM facts WHERE quantity < 40 GROUP BY 1)
SELECT a.cluster, a.s AS all_rows, b.s AS clean_rows, round(b.s - a.s, 6) AS difference FROM a LEFT JOIN b ON a.cluster = b.cluster""",
    "risk_bands": f"""WITH {FACTS_SQL}, p AS (SELECT posting, 100 * avg(CASE WHEN quantity < 10 THEN 1.0 ELSE 0.0 END) AS pct FROM facts GROUP BY 1)
SELECT CASE WHEN pct <= 0 THEN 'none' WHEN pct <= 25 THEN 'low' WHEN pct <= 50 THEN 'middle' ELSE 'high' END AS band, count(*) AS postings, round(avg(pct), 6) AS mean_pct FROM p GROUP BY 1""",
}
