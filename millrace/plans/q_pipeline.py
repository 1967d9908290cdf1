"""Queries of the text pipeline, of streams and of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.requirements import decompose_udf, split_udf
from millrace.operators import process as P
from millrace.operators import runs as R
from millrace.plans.q_runs import _METRICS
from millrace.sources import sinks
from millrace.sources.tables import table
from millrace.streaming import admission as S


def split_items(spark: SparkSession, folder: str) -> DataFrame:
    """Atoms and route of every distinct item."""
    items = table(spark, folder, "requirements").filter("item IS NOT NULL").select("item").distinct()
    return items.withColumn("s", split_udf(F.col("item"))).select("item", F.col("s.atoms").alias("atoms"), F.col("s.route").alias("route"))


def decompose(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of every distinct atom."""
    atoms = table(spark, folder, "requirements").filter("atom_norm IS NOT NULL").select("atom_norm").distinct()
    return atoms.withColumn("d", decompose_udf(F.col("atom_norm"))).select("atom_norm", "d.*")


def process_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline over the postings, with years handed on and keys marked."""
    return P.first_per_key(P.inherit_years(P.process(table(spark, folder, "postings").select("posting_row", "must_have"))))


def unsplit_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that look compound and were left whole."""
    return P.residue(P.process(table(spark, folder, "postings").select("posting_row", "must_have")))


def input_causes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("item IS NOT NULL")
    return rows.groupBy(F.coalesce(P.input_cause(F.col("item"), F.col("translated")), F.lit("none")).alias("cause")).agg(F.count(F.lit(1)).alias("rows"))


def posting_export(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table per posting."""
    rows = table(spark, folder, "requirements").filter("trim(posting_id) <> ''").dropDuplicates(["req_id"]).select("posting_id", "item_idx", "atom_idx", "core", "match_status")
    return sinks.posting_rollup(rows)


def metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    m = R.run_metrics(table(spark, folder, "requirements").dropDuplicates(["req_id"]), "job", ["posting_id", "item_idx"])
    return sinks.metric_rows(m, ["job"])


def stream_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Adverts admitted from a stream of postings, each once."""
    place = S.work_folder(spark, "admission")
    S.admit(S.table_stream(spark, folder, "postings"), place, gate="size(must_have) > 0")
    return spark.read.parquet(f"{place}/adverts").select("advert_key")


def stream_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Events that are the third or later off-green one of a user in a row."""
    light = F.when(F.col("value") > 60, "red").when(F.col("value") > 30, "yellow").otherwise("green")
    stream = S.table_stream(spark, folder, "events").select("user_id", "event_id", light.alias("light"))
    return S.collect_stream(S.drift_stream(stream, "user_id", "event_id", "light"), S.work_folder(spark, "drift"))


def stream_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and type from a stream; the last window stays open at the end of the stream."""
    out = S.collect_stream(S.windowed_counts(S.table_stream(spark, folder, "events"), "ts", "event_type", "1 day", "1 hour"), S.work_folder(spark, "counts"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (split_items, decompose, process_postings, unsplit_items, input_causes, posting_export, metric_rows, stream_admission, stream_drift, stream_counts)}

_KEYED = "k AS (SELECT DISTINCT substr(sha256(CASE WHEN trim(coalesce(id, '')) <> '' THEN 'i:' || id ELSE 't:' || coalesce(title, '') || chr(0) || coalesce(array_to_string(must_have, chr(0)), '') END), 1, 16) AS advert_key FROM postings WHERE len(must_have) > 0)"

ORACLES = {
    "metric_rows": f"WITH {_METRICS} SELECT job, metric, value FROM (UNPIVOT (SELECT job, COLUMNS(* EXCLUDE (job))::DOUBLE FROM m) ON COLUMNS(* EXCLUDE (job)) INTO NAME metric VALUE value)",
    "input_causes": r"""WITH i AS (SELECT regexp_replace(item, '[^\p{L}]', '', 'g') AS l, item, translated FROM requirements WHERE item IS NOT NULL)
SELECT CASE WHEN length(l) > 0 AND l = lower(l) THEN 'lowercase' WHEN translated THEN 'translation' WHEN length(item) > 120 THEN 'long_item' ELSE 'none' END AS cause, count(*) AS rows FROM i GROUP BY 1""",
    "posting_export": """WITH r AS (SELECT DISTINCT ON (req_id) * FROM requirements WHERE trim(posting_id) <> ''),
f AS (SELECT posting_id, core, min((item_idx, atom_idx)) AS p FROM r WHERE coalesce(core, '') <> '' GROUP BY 1, 2), c AS (SELECT posting_id, string_agg(core, ' | ' ORDER BY p, core) AS cores FROM f GROUP BY 1)
SELECT r.posting_id, count(*) AS requirements, count(DISTINCT item_idx) AS items, count(*) FILTER (match_status = 'known') AS known, count(*) FILTER (match_status = 'group') AS "group",
count(*) FILTER (match_status = 'topic') AS topic, count(*) FILTER (match_status = 'nuovo') AS nuovo, coalesce(any_value(c.cores), '') AS cores FROM r LEFT JOIN c ON r.posting_id = c.posting_id GROUP BY 1""",
    "stream_admission": f"WITH {_KEYED} SELECT advert_key FROM k",
    "stream_drift": """WITH h AS (SELECT user_id, event_id, (value > 30)::INT AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM h) SELECT user_id, event_id FROM s WHERE s = 3""",
    "stream_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
}
