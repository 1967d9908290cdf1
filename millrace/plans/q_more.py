"""Queries about groups: kinds, junk, near keys, merge evidence, split defects, tables of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph, groups
from millrace.operators.base import blank_to_null
from millrace.plans.star import FACTS_SQL, facts
from millrace.sources.tables import table

INDUSTRIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
WORD = r"[^\p{L}\p{N}+#]+"


def modal_type(spark: SparkSession, folder: str) -> DataFrame:
    return groups.modal_value(table(spark, folder, "requirements").filter("trim(req_group) <> ''"), "req_group", "head_group")


def junk_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("trim(req_topic) <> ''")
    return groups.junk_drawers(rows, "req_topic", "head_group", "atom_norm")


def word_length(spark: SparkSession, folder: str) -> DataFrame:
    """Mean words, single words and one-word relational heads per head group."""
    words = F.split(F.trim("atom_norm"), r"\s+")
    rows = table(spark, folder, "requirements").filter("atom_norm IS NOT NULL").select("head_group", F.size(words).alias("n"), (F.col("atom_norm").isin("experience", "knowledge", "skills", "ability")).alias("bare"))
    return rows.groupBy("head_group").agg(F.round(F.avg("n"), 6).alias("mean_words"), F.round(100 * F.avg((F.col("n") == 1).cast("double")), 6).alias("single_pct"), F.count_if("bare").alias("bare_heads"))


def role_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Title keys that differ in one word."""
    return groups.one_token_apart(table(spark, folder, "title_dictionary").filter("title_group IN ('engineer', 'developer')"), "title_key")


def merge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Requirement groups whose member words overlap by 0.25 or more."""
    return groups.vocabulary_overlap(table(spark, folder, "req_cores").filter("req_group IS NOT NULL"), "req_group", "req_core", 0.25)


def merge_families(spark: SparkSession, folder: str) -> DataFrame:
    """The families that merge candidates form, with the commonest member as name."""
    comp = graph.connected_components(merge_candidates(spark, folder).select("a", "b"))
    weights = table(spark, folder, "req_cores").groupBy(F.col("req_group").alias("node")).agg(F.sum("n").alias("weight"))
    return graph.representatives(comp, weights)


def split_defects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("atom IS NOT NULL")
    return rows.groupBy("route", F.coalesce(groups.split_flags(F.col("atom"), F.col("item")), F.lit("none")).alias("flag")).agg(F.count(F.lit(1)).alias("rows"))


def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("trim(posting_id) <> ''").select("req_id", "posting_id", "item_idx", "core").distinct()
    return groups.repeated_in_item(rows, ["posting_id", "item_idx"], "core")


def group_by_industry(spark: SparkSession, folder: str) -> DataFrame:
    return groups.shares_by(facts(spark, folder), "cluster", "industry", INDUSTRIES, "posting")


def level_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select("posting_row", "company_id", F.lower("seniority").alias("seniority"), F.when(F.upper(F.trim("geo_country")) == "GERMANY", "de").otherwise("other").alias("fn"))
    return groups.level_table(rows, "seniority", "fn", ["de", "other"], "posting_row", "company_id")


def catalogue_summary(spark: SparkSession, folder: str) -> DataFrame:
    kinds = spark.createDataFrame([("error",), ("signup",), ("refund",)], "event_type STRING")
    return groups.catalogue_summary(kinds, table(spark, folder, "events"), "event_type", ["ts", "event_id"], "value")


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs, postings and requirements per rules version; retests count by their last job."""
    jobs = table(spark, folder, "jobs")
    latest = jobs.groupBy(F.coalesce(blank_to_null("retest_of"), F.col("job")).alias("original")).agg(F.max(F.struct("created_at", "job", "rules_version", "n_postings")).alias("j")).select("j.*")
    req = table(spark, folder, "requirements").groupBy("job").agg(F.count_distinct("req_id").alias("requirements"))
    out = latest.join(req, "job", "left")
    return out.groupBy("rules_version").agg(F.count(F.lit(1)).alias("jobs"), F.sum("n_postings").alias("postings"), F.sum(F.coalesce("requirements", F.lit(0))).alias("requirements"))


def probe_levels(spark: SparkSession, folder: str) -> DataFrame:
    """How well the country can be told from an advert's words, against shuffled labels."""
    rows = table(spark, folder, "postings").filter("size(must_have) > 0 AND trim(geo_country) <> '' AND trim(company_id) <> ''")
    rows = rows.select(F.split(F.lower(F.array_join("must_have", " ")), r"[^\p{L}]+").alias("words"), F.upper("geo_country").alias("country"), "company_id")
    return groups.probe(rows, "words", "country", "company_id")


QUERIES = {f.__name__: f for f in (modal_type, junk_groups, word_length, role_pairs, merge_candidates, merge_families, split_defects, repeated_keys, group_by_industry, level_table, catalogue_summary, run_totals, probe_levels)}

_OVERLAP = f"""w AS (SELECT DISTINCT req_group AS g, unnest(regexp_split_to_array(lower(req_core), '{WORD}')) AS w FROM req_cores WHERE req_group IS NOT NULL), v AS (SELECT * FROM w WHERE length(w) > 1),
n AS (SELECT g, count(*) AS n FROM v GROUP BY 1), c AS (SELECT DISTINCT x.g AS a, y.g AS b FROM v x JOIN v y ON x.w = y.w AND x.g < y.g),
i AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN v x ON x.g = c.a JOIN v y ON y.g = c.b AND y.w = x.w GROUP BY 1, 2),
j AS (SELECT i.a, i.b, round(i.i / (p.n + q.n - i.i), 6) AS jaccard FROM i JOIN n p ON p.g = i.a JOIN n q ON q.g = i.b WHERE round(i.i / (p.n + q.n - i.i), 6) >= 0.25)"""

ORACLES = {
    "modal_type": """WITH c AS (SELECT req_group, head_group, count(*) AS n FROM requirements WHERE trim(req_group) <> '' GROUP BY 1, 2)
SELECT req_group, t::BIGINT AS rows, head_group AS modal, round(n / t, 6) AS modal_share FROM (SELECT *, sum(n) OVER (PARTITION BY req_group) AS t FROM c QUALIFY row_number() OVER (PARTITION BY req_group ORDER BY n DESC, head_group NULLS FIRST) = 1)""",
    "junk_groups": r"""WITH r AS (SELECT * FROM requirements WHERE trim(req_topic) <> ''), c AS (SELECT req_topic, head_group, count(*) AS n FROM r GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY req_topic) AS t FROM c QUALIFY row_number() OVER (PARTITION BY req_topic ORDER BY n DESC, head_group NULLS FIRST) = 1),
s AS (SELECT req_topic, round(avg(CASE WHEN len(regexp_split_to_array(trim(atom_norm), '\s+')) = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_share FROM r GROUP BY 1)
SELECT m.req_topic, t::BIGINT AS rows, head_group AS modal, round(n / t, 6) AS modal_share, single_share, round(n / t, 6) < 0.5 AND single_share >= 0.35 AS junk FROM m JOIN s ON m.req_topic = s.req_topic""",
    "word_length": r"""WITH r AS (SELECT head_group, len(regexp_split_to_array(trim(atom_norm), '\s+')) AS n, atom_norm IN ('experience', 'knowledge', 'skills', 'ability') AS b FROM requirements WHERE atom_norm IS NOT NULL)
SELECT head_group, round(avg(n), 6) AS mean_words, round(100 * avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_pct, count(*) FILTER (b) AS bare_heads FROM r GROUP BY 1""",
    "role_pairs": """WITH k AS (SELECT title_key, list_sort(list_distinct(string_split(title_key, ' '))) AS w FROM title_dictionary WHERE title_group IN ('engineer', 'developer'))
SELECT a.title_key, b.title_key AS other, list_filter(a.w, lambda x: NOT list_contains(b.w, x))[1] AS left_out, list_filter(b.w, lambda x: NOT list_contains(a.w, x))[1] AS other_out
FROM k a JOIN k b ON a.title_key < b.title_key AND len(a.w) = len(b.w) AND len(list_intersect(a.w, b.w)) = len(a.w) - 1""",
    "merge_candidates": f"WITH {_OVERLAP} SELECT a, b, jaccard FROM j",
    "merge_families": f"""WITH RECURSIVE {_OVERLAP}, e AS (SELECT a, b FROM j UNION SELECT b, a FROM j), t(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON t.node = e.a WHERE t.root < e.b),
m AS (SELECT node, min(root) AS root FROM t GROUP BY 1), x AS (SELECT req_group, sum(n) AS w FROM req_cores GROUP BY 1),
y AS (SELECT root, node AS target FROM m JOIN x ON node = req_group QUALIFY row_number() OVER (PARTITION BY root ORDER BY w DESC, node) = 1)
SELECT m.node, y.target FROM m JOIN y ON m.root = y.root""",
    "split_defects": r"""SELECT route, CASE WHEN regexp_matches(atom, '(?i)^\s*(?:and|or|but|und|oder|et|ou|y|o|e)\s') THEN 'leading_conjunction' WHEN length(regexp_replace(atom, '[^(]', '', 'g')) <> length(regexp_replace(atom, '[^)]', '', 'g')) THEN 'open_bracket'
WHEN regexp_matches(atom, '(?i)\b(?:such as|e\.g\.|including)\s*$') THEN 'leaked_introducer' WHEN atom = item AND length(atom) > 60 AND atom LIKE '%,%' THEN 'whole_compound' ELSE 'none' END AS flag, count(*) AS rows
FROM requirements WHERE atom IS NOT NULL GROUP BY 1, 2""",
    "repeated_keys": """WITH r AS (SELECT DISTINCT req_id, posting_id, item_idx, core FROM requirements WHERE trim(posting_id) <> '')
SELECT posting_id, item_idx, core, count(*) AS times FROM r WHERE trim(coalesce(core, '')) <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "group_by_industry": f"""WITH {FACTS_SQL}, s AS (SELECT DISTINCT cluster, industry, posting FROM facts), t AS (SELECT industry, count(DISTINCT posting) AS t FROM s GROUP BY 1),
h AS (SELECT cluster, s.industry, count(*) / any_value(t) AS share FROM s JOIN t ON s.industry = t.industry GROUP BY 1, 2), w AS (SELECT cluster, {', '.join(f"round(coalesce(max(share) FILTER (industry = '{i}'), 0), 6) AS share_{i}" for i in INDUSTRIES)} FROM h GROUP BY 1)
SELECT *, round(greatest({', '.join('share_' + i for i in INDUSTRIES)}) / nullif(least({', '.join('share_' + i for i in INDUSTRIES)}), 0), 4) AS ratio FROM w""",
    "level_table": """WITH p AS (SELECT posting_row, company_id, coalesce(nullif(trim(lower(seniority)), ''), '(unstated)') AS level, CASE WHEN upper(trim(geo_country)) = 'GERMANY' THEN 'de' ELSE 'other' END AS fn FROM postings),
c AS (SELECT level, count(DISTINCT posting_row) FILTER (fn = 'de') AS adverts_de, count(DISTINCT company_id) FILTER (fn = 'de') AS companies_de, count(DISTINCT posting_row) FILTER (fn = 'other') AS adverts_other,
count(DISTINCT company_id) FILTER (fn = 'other') AS companies_other, count(DISTINCT posting_row) AS adverts FROM p GROUP BY 1) SELECT *, row_number() OVER (ORDER BY level = '(unstated)', adverts DESC, level) AS place FROM c""",
    "catalogue_summary": """WITH k(event_type) AS (VALUES ('error'), ('signup'), ('refund')), l AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT k.event_type, coalesce(n, 0) AS lines, value AS last_value FROM k LEFT JOIN l ON k.event_type = l.event_type""",
    "run_totals": """WITH l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(trim(retest_of), ''), job) ORDER BY created_at DESC, job DESC) = 1), r AS (SELECT job, count(DISTINCT req_id) AS n FROM requirements GROUP BY 1)
SELECT rules_version, count(*) AS jobs, sum(n_postings)::BIGINT AS postings, sum(coalesce(n, 0))::BIGINT AS requirements FROM l LEFT JOIN r ON l.job = r.job GROUP BY 1""",
}
