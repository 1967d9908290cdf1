"""Queries of the dictionary and of run quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dictionary as D
from millrace.operators import runs as R
from millrace.sources.tables import table

NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def _known(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("match_status = 'known' AND trim(core) <> '' AND trim(req_group) <> ''")
    return rows.select("req_id", "head_group", "core", "req_group", "req_topic").distinct()


def dictionary_freeze(spark: SparkSession, folder: str) -> DataFrame:
    rows = _known(spark, folder).groupBy("head_group", "core", "req_id").agg(F.min("req_topic").alias("req_topic"))
    groups = _known(spark, folder).groupBy("core").agg(F.min("req_group").alias("req_group"))
    return D.freeze(rows.join(groups, "core"), "head_group", "core", "req_group", "req_topic")


def _new(old: DataFrame) -> DataFrame:
    """A second version of the reference list: topics 03 and 05 are joined, one group is renamed, skills cores are gone."""
    g = F.when(F.col("req_topic").isin("topic-03", "topic-05"), "joined").when(F.col("req_group") == "English", "English language").when((F.length("req_core") > 14) & (F.col("req_topic") == "topic-07"), F.concat("req_group", F.lit(" long"))).otherwise(F.col("req_group"))
    return old.filter("NOT (req_topic = 'topic-04')").withColumn("req_group", g)


def dictionary_diff(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "req_cores")
    return D.diff(old, _new(old))


def dictionary_merged(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "req_cores")
    return D.merged_groups(old, _new(old))


def dictionary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Cores of the requirements in the reference list, by stage."""
    entries = table(spark, folder, "req_cores").select(F.lit("").alias("req_space"), "req_core", "req_group", "req_topic")
    values = table(spark, folder, "requirements").select(F.lit("").alias("space"), F.lower("atom_norm").alias("core")).distinct()
    aliases = spark.createDataFrame([("", "independent work", "independence")], "space STRING, variant STRING, target_group STRING")
    return D.lookup(values, "space", "core", entries, aliases).groupBy("match", "via").agg(F.count(F.lit(1)).alias("cores"), F.count_distinct("group").alias("groups"))


def match_bands(spark: SparkSession, folder: str) -> DataFrame:
    """What the recorded similarities are worth by the thresholds, against the recorded status."""
    rows = table(spark, folder, "requirements").filter("match_cosine IS NOT NULL")
    return rows.groupBy("match_status", D.nearest_status(F.col("match_cosine")).alias("by_threshold")).agg(F.count(F.lit(1)).alias("rows"))


def casing_map(spark: SparkSession, folder: str) -> DataFrame:
    return D.casing_map(table(spark, folder, "requirements").select("item"), "item")


def acronyms(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms mined from job titles that spell them out."""
    rows = table(spark, folder, "title_dictionary")
    spelled = rows.select(F.concat(F.initcap("title_name"), F.lit(" ("), F.upper(F.array_join(F.transform(F.split("title_name", "[ -]"), lambda w: F.substring(w, 1, 1)), "")), F.lit(")")).alias("title"))
    return D.acronyms(spelled.unionByName(spelled), "title")


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").dropDuplicates(["req_id"])
    return R.run_metrics(rows, "job", ["posting_id", "item_idx"])


def run_lights(spark: SparkSession, folder: str) -> DataFrame:
    """The light of two signals of every run against fixed bands."""
    m = run_metrics(spark, folder)
    known = R.light(F.col("match_known"), F.col("items"), 100, 0.30, 0.40, 0.60, 0.70, "low")
    damaged = R.light(F.col("share_damaged"), F.col("items"), 100, 0.0, 0.0, 0.045, 0.06, "high")
    return m.select("job", "items", known.alias("known_light"), damaged.alias("damaged_light"))


def reference_bands(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("trim(posting_id) <> ''").dropDuplicates(["req_id"])
    per = rows.groupBy("posting_id").agg(F.count(F.lit(1)).alias("atoms"), F.count_distinct("item_idx").alias("items"))
    bands = R.reference_bands(per, "atoms", "items", [10, 30, 100], 500, 20261104)
    return bands.select("size", "runs", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (1, 5, 50, 95, 99)])


def _history(spark: SparkSession, folder: str) -> DataFrame:
    light = F.when(F.col("value") > 60, "red").when(F.col("value") > 30, "yellow").otherwise("green")
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value", light.alias("light"))


def drift3(spark: SparkSession, folder: str) -> DataFrame:
    out = R.drift(_history(spark, folder), "user_id", "event_id", "light")
    return out.filter("drift").select("event_id", "user_id", "light")


def event_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose last signup or error is a signup."""
    return R.replay(_history(spark, folder), "user_id", ["ts", "event_id"], "event_type", "signup", "error", "value").select("user_id", "event_id", "value")


def latest_decision(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest(_history(spark, folder), "user_id", ["ts", "event_id"], "event_type", "value").select("user_id", "event_id", "event_type", "value")


def error_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("route <> 'rules'").select("route", F.coalesce("match_status", F.lit("")).alias("match_status"), "atom_norm")
    return R.error_table(rows, ["route", "match_status"], "atom_norm")


def wilson(spark: SparkSession, folder: str) -> DataFrame:
    """Share of unplaced requirements per job with its interval."""
    per = table(spark, folder, "requirements").groupBy("job").agg(F.count_if(F.col("match_status") == "nuovo").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = R.wilson(F.col("k"), F.col("n"))
    return per.select("job", "k", "n", low.alias("low"), high.alias("high"))


def binomial_tail(spark: SparkSession, folder: str) -> DataFrame:
    """P(X >= damaged) of every job, with its own number of items, if 4 percent were the rule."""
    per = table(spark, folder, "requirements").groupBy("job").agg(F.count_if(F.col("route") == "damaged").alias("k"), F.count(F.lit(1)).alias("n"))
    return per.select("job", "k", F.round(R.binomial_tail(F.col("n"), F.col("k"), F.lit(0.04)), 9).alias("tail"))


def judge_light(spark: SparkSession, folder: str) -> DataFrame:
    per = table(spark, folder, "requirements").groupBy("job").agg(F.count_if(F.col("route") == "damaged").alias("flagged"), F.count(F.lit(1)).alias("answered"))
    return per.select("job", "flagged", "answered", R.judge_light(F.col("flagged"), F.col("answered"), F.lit(4), F.lit(100)).alias("light"))


def kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of two yes/no readings of the lines: returned, and a large quantity."""
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").alias("t"), (F.col("l_quantity") > 25).alias("j"))
    return R.kappa(rows, "t", "j")


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").select("route", F.coalesce("match_status", F.lit("")).alias("match_status"))
    return R.confusion(rows, "route", "match_status")


def error_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of wrong requirements per job from damaged ones and recorded similarities."""
    per = table(spark, folder, "requirements").groupBy("job").agg(
        F.count_if(F.col("route") == "damaged").alias("d"), F.count(F.lit(1)).alias("n"), F.avg((F.col("match_status") == "group").cast("double")).alias("g"), F.count_if((F.col("match_status") == "group") & (F.col("match_cosine") < 0.92)).alias("gf"), F.count_if(F.col("match_status") == "group").alias("ga"),
    )
    total, light = R.error_estimate(F.col("d"), F.col("n"), [(F.coalesce("g", F.lit(0.0)), F.col("gf"), F.col("ga"))])
    return per.select("job", F.round(total, 6).alias("share"), light.alias("light"))


def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("at"))
    done = table(spark, folder, "events").filter(f"event_type = 'purchase' AND ts <= {NOW} AND ts > {NOW} - INTERVAL 3 DAYS").select("user_id")
    starts = table(spark, folder, "events").filter(f"event_type = 'click' AND ts <= {NOW}").groupBy("user_id").agg(F.max("ts").alias("at"))
    return R.pending(starts.join(jobs.select("user_id"), "user_id", "left_semi"), done, "user_id", "at", F.expr(NOW)).select("user_id", "at")


def job_health(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "events").filter(f"ts <= {NOW}").groupBy("user_id").agg(F.max("ts").alias("at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e"))
    state = F.when(F.col("e").isin("click", "view"), "running").otherwise("done")
    return last.select("user_id", R.health(state, F.col("at"), F.expr(NOW)).alias("health"))


QUERIES = {f.__name__: f for f in (
    dictionary_freeze, dictionary_diff, dictionary_merged, dictionary_lookup, match_bands, casing_map, acronyms, run_metrics, run_lights, reference_bands, drift3, event_replay, latest_decision,
    error_table, wilson, binomial_tail, judge_light, kappa, confusion, error_estimate, pending_jobs, job_health,
)}

_NEW = """nw AS (SELECT req_space, req_core, n, CASE WHEN req_topic IN ('topic-03', 'topic-05') THEN 'joined' WHEN req_group = 'English' THEN 'English language'
WHEN length(req_core) > 14 AND req_topic = 'topic-07' THEN req_group || ' long' ELSE req_group END AS req_group FROM req_cores WHERE NOT (req_topic = 'topic-04'))"""
_METRICS = "m AS (SELECT job, count(*) AS requirements, count(DISTINCT (posting_id, item_idx)) AS items, round(count(*) / count(DISTINCT (posting_id, item_idx)), 6) AS per_item, " + ", ".join(
    [f"round(avg(CASE WHEN route = '{r}' THEN 1.0 ELSE 0.0 END), 6) AS share_{r}" for r in ("rules", "single", "llm", "damaged")] + [f"round(avg(CASE WHEN match_status = '{m}' THEN 1.0 ELSE 0.0 END), 6) AS match_{m}" for m in ("known", "group", "topic", "nuovo")]
) + " FROM (SELECT DISTINCT ON (req_id) * FROM requirements) GROUP BY 1)"
_HIST = "h AS (SELECT *, CASE WHEN value > 60 THEN 'red' WHEN value > 30 THEN 'yellow' ELSE 'green' END AS light FROM events)"


def _canon(c: str) -> str:
    c = f"regexp_replace(lower(trim({c})), '[’`´]', '''', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, 'isation\\b', 'ization', 'g'), 'ise\\b', 'ize', 'g')"
    return f"regexp_replace({c}, '([a-z]{{3,}}[^s''])s\\b', '\\1', 'g')"



ORACLES = {
    "dictionary_freeze": """WITH k AS (SELECT DISTINCT req_id, head_group, core, req_group, req_topic FROM requirements WHERE match_status = 'known' AND trim(core) <> '' AND trim(req_group) <> ''),
g AS (SELECT core, min(req_group) AS req_group FROM k GROUP BY 1), r AS (SELECT head_group, core, req_id, min(req_topic) AS req_topic FROM k GROUP BY 1, 2, 3)
SELECT head_group AS req_space, r.core AS req_core, count(*) AS n, min(g.req_group) AS req_group, min(req_topic) AS req_topic FROM r JOIN g ON r.core = g.core GROUP BY 1, 2""",
    "dictionary_diff": f"""WITH {_NEW}, m AS (SELECT o.req_group AS old_group, nw.req_group AS new_group, sum(o.n) AS mass FROM req_cores o LEFT JOIN nw ON o.req_space = nw.req_space AND o.req_core = nw.req_core GROUP BY 1, 2),
t AS (SELECT old_group, new_group FROM m WHERE new_group IS NOT NULL QUALIFY row_number() OVER (PARTITION BY old_group ORDER BY mass DESC, new_group) = 1)
SELECT m.old_group, CASE WHEN count(m.new_group) = 0 THEN 'gone' WHEN count(m.new_group) > 1 THEN 'split' WHEN any_value(t.new_group) = m.old_group THEN 'same' ELSE 'renamed' END AS fate, sum(mass)::BIGINT AS mass, any_value(t.new_group) AS main_target
FROM m LEFT JOIN t ON m.old_group = t.old_group GROUP BY m.old_group""",
    "dictionary_merged": f"WITH {_NEW} SELECT nw.req_group AS new_group, count(DISTINCT o.req_group) AS sources FROM req_cores o JOIN nw ON o.req_space = nw.req_space AND o.req_core = nw.req_core GROUP BY 1 HAVING count(DISTINCT o.req_group) > 1",
    "dictionary_lookup": f"""WITH v AS (SELECT DISTINCT lower(atom_norm) AS core FROM requirements), x AS (SELECT DISTINCT ON (req_core) req_core, req_group FROM req_cores),
f AS (SELECT {_canon('req_core')} AS c, min(req_group) AS g FROM req_cores GROUP BY 1 HAVING count(DISTINCT req_group) = 1),
r AS (SELECT v.core, x.req_group AS e, CASE WHEN v.core = 'independent work' THEN 'independence' END AS a, f.g AS c FROM v LEFT JOIN x ON v.core = x.req_core LEFT JOIN f ON {_canon('v.core')} = f.c)
SELECT CASE WHEN trim(coalesce(core, '')) = '' THEN 'empty' WHEN coalesce(e, a, c) IS NOT NULL THEN 'known' ELSE 'nuovo' END AS match,
CASE WHEN trim(coalesce(core, '')) = '' THEN 'none' WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL THEN 'alias' WHEN c IS NOT NULL THEN 'canon' ELSE 'none' END AS via,
count(*) AS cores, count(DISTINCT CASE WHEN trim(core) <> '' THEN coalesce(e, a, c) END) AS groups FROM r GROUP BY 1, 2""",
    "match_bands": "SELECT match_status, CASE WHEN match_cosine >= 0.9 THEN 'group' WHEN match_cosine >= 0.8 THEN 'topic' ELSE 'nuovo' END AS by_threshold, count(*) AS rows FROM requirements WHERE match_cosine IS NOT NULL GROUP BY 1, 2",
    "casing_map": r"""WITH w AS (SELECT unnest(list_slice(regexp_extract_all(item, '[\p{L}\p{N}+#.]*\p{L}[\p{L}\p{N}+#.]*'), 2, 100000)) AS w FROM requirements),
f AS (SELECT lower(w) AS lower, w AS cased, count(*) AS n FROM w WHERE length(w) >= 2 GROUP BY 1, 2),
b AS (SELECT lower, cased, n, sum(n) OVER (PARTITION BY lower) AS t FROM f QUALIFY row_number() OVER (PARTITION BY lower ORDER BY n DESC, cased) = 1)
SELECT lower, cased, n FROM b WHERE n >= 5 AND n / t >= 0.9 AND cased <> lower""",
    "run_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "run_lights": f"""WITH {_METRICS} SELECT job, items, CASE WHEN items < 100 THEN 'grey' WHEN match_known < 0.30 THEN 'red' WHEN match_known < 0.40 THEN 'yellow' ELSE 'green' END AS known_light,
CASE WHEN items < 100 THEN 'grey' WHEN share_damaged > 0.06 THEN 'red' WHEN share_damaged > 0.045 THEN 'yellow' ELSE 'green' END AS damaged_light FROM m""",
    "drift3": f"""WITH {_HIST}, d AS (SELECT event_id, user_id, light, sum((light <> 'green')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b FROM h) SELECT event_id, user_id, light FROM d WHERE b = 3""",
    "event_replay": "SELECT user_id, event_id, value FROM (SELECT * FROM events WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type = 'signup'",
    "latest_decision": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "error_table": """WITH r AS (SELECT route, coalesce(match_status, '') AS match_status, atom_norm FROM requirements WHERE route <> 'rules'), c AS (SELECT route, match_status, count(*) AS count FROM r GROUP BY 1, 2),
d AS (SELECT DISTINCT * FROM r WHERE atom_norm IS NOT NULL), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY route, match_status ORDER BY atom_norm) <= 3), e AS (SELECT route, match_status, string_agg(atom_norm, ' | ' ORDER BY atom_norm) AS examples FROM t GROUP BY 1, 2)
SELECT c.route, c.match_status, count, examples, round(count / sum(count) OVER (), 6) AS share FROM c LEFT JOIN e ON c.route = e.route AND c.match_status = e.match_status""",
    "wilson": """WITH c AS (SELECT job, count(*) FILTER (match_status = 'nuovo') AS k, count(*) AS n FROM requirements GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 * 1.96 AS z2 FROM c)
SELECT job, k, n, round(greatest(0, ((p + z2 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 4) AS low, round(least(1, ((p + z2 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 4) AS high FROM p""",
    "reference_bands": """WITH r AS (SELECT * FROM requirements WHERE trim(posting_id) <> '' QUALIFY row_number() OVER (PARTITION BY req_id) = 1), p AS (SELECT posting_id, count(*) AS atoms, count(DISTINCT item_idx) AS items FROM r GROUP BY 1),
s AS (SELECT v.size, greatest(1, (SELECT count(*) FROM p) // v.size) AS slots FROM (VALUES (10), (30), (100)) v(size)),
d AS (SELECT s.size, slots, atoms, items, floor((('0x' || substr(sha256('20261104|' || s.size || '|' || posting_id), 1, 10))::BIGINT / 1099511627776.0::DOUBLE) * slots)::INT AS slot FROM p, s),
g AS (SELECT size, slot, sum(atoms) / sum(items) AS r FROM d WHERE slot < least(slots, 500) GROUP BY 1, 2)
SELECT size, count(*) AS runs, round(quantile_cont(r, 0.01), 6) AS p1, round(quantile_cont(r, 0.05), 6) AS p5, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(r, 0.99), 6) AS p99 FROM g GROUP BY 1""",
    "binomial_tail": """WITH c AS (SELECT job, count(*) FILTER (route = 'damaged') AS k, count(*) AS n FROM requirements GROUP BY 1),
t AS (SELECT job, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.04) + (n - i) * ln(0.96))) AS p FROM (SELECT *, unnest(range(k, n + 1)) AS i FROM c) GROUP BY 1)
SELECT c.job, k, round(CASE WHEN k <= 0 THEN 1.0 ELSE least(1.0, p) END, 9) AS tail FROM c LEFT JOIN t ON c.job = t.job""",
    "judge_light": """WITH c AS (SELECT job, count(*) FILTER (route = 'damaged') AS flagged, count(*) AS answered FROM requirements GROUP BY 1),
t AS (SELECT job, sum(exp(lgamma(answered + 1) - lgamma(i + 1) - lgamma(answered - i + 1) + i * ln(0.04) + (answered - i) * ln(0.96))) AS p FROM (SELECT *, unnest(range(flagged, answered + 1)) AS i FROM c) GROUP BY 1)
SELECT c.job, flagged, answered, CASE WHEN answered < 10 THEN 'grey' WHEN p < 0.01 THEN 'red' WHEN p < 0.05 THEN 'yellow' ELSE 'green' END AS light FROM c LEFT JOIN t ON c.job = t.job""",
    "kappa": """WITH r AS (SELECT l_returnflag = 'R' AS t, l_quantity > 25 AS j FROM lineitem), s AS (SELECT count(*) AS n, count(*) FILTER (t = j) AS same, count(*) FILTER (t) AS t1, count(*) FILTER (j) AS j1, count(*) FILTER (t AND j) AS tp FROM r),
x AS (SELECT *, same / n AS po, (t1::DOUBLE * j1 + (n - t1)::DOUBLE * (n - j1)) / (n::DOUBLE * n) AS pe FROM s)
SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, tp, j1 - tp AS fp, t1 - tp AS fn FROM x""",
    "confusion": "SELECT route, coalesce(match_status, '') AS match_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY route), 6) AS share FROM requirements GROUP BY 1, 2",
    "error_estimate": """WITH c AS (SELECT job, count(*) FILTER (route = 'damaged') AS d, count(*) AS n, avg(CASE WHEN match_status IS NULL THEN NULL WHEN match_status = 'group' THEN 1.0 ELSE 0.0 END) AS g, count(*) FILTER (match_status = 'group' AND match_cosine < 0.92) AS gf, count(*) FILTER (match_status = 'group') AS ga FROM requirements GROUP BY 1),
t AS (SELECT job, d / n + coalesce(coalesce(g, 0) * gf / nullif(ga, 0), 0) AS s FROM c) SELECT job, round(s, 6) AS share, CASE WHEN s > 0.06 THEN 'red' WHEN s >= 0.03 THEN 'yellow' ELSE 'green' END AS light FROM t""",
    "pending_jobs": f"""WITH s AS (SELECT user_id, max(ts) AS at_ FROM events WHERE event_type = 'click' AND ts <= {NOW} GROUP BY 1)
SELECT user_id, at_ AS at FROM s WHERE at_ > {NOW} - INTERVAL 24 HOURS AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts <= {NOW} AND ts > {NOW} - INTERVAL 3 DAYS)""",
    "job_health": f"""WITH l AS (SELECT user_id, ts, event_type FROM events WHERE ts <= {NOW} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN epoch({NOW}) - floor(epoch(ts)) > 5400 THEN 'failed' ELSE 'running' END ELSE 'done' END AS health FROM l""",
    "acronyms": r"""WITH t AS (SELECT title_name, list_transform(string_split(regexp_replace(title_name, '-', ' ', 'g'), ' '), lambda x: upper(x[1])) AS i, title_name LIKE '%-%' AS h FROM title_dictionary),
a AS (SELECT list_aggregate(i, 'string_agg', '') AS acronym, lower(regexp_replace(title_name, '[^a-zA-Z ]', ' ', 'g')) AS expansion FROM t)
SELECT acronym, min(expansion) AS expansion, count(*) * 2 AS n FROM a WHERE length(acronym) BETWEEN 2 AND 6 GROUP BY 1 HAVING count(DISTINCT expansion) = 1""",
}
