"""Queries of the explorer, of text functions and of sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.operators import explorer as X
from millrace.operators import sampling as S
from millrace.operators.base import blank_to_null
from millrace.plans.star import FACTS_SQL, facts
from millrace.sources.tables import table

SEED = "20261104"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements with the advert's company, country and level; adverts are distinct posting ids."""
    req = table(spark, folder, "requirements").filter("trim(posting_id) <> '' AND trim(req_group) <> ''").select("posting_id", "req_group", "req_topic", "head_group", "core").distinct()
    ads = table(spark, folder, "postings").filter("trim(id) <> ''").groupBy("id").agg(F.min("company_id").alias("company"), F.upper(F.trim(F.min(blank_to_null("geo_country")))).alias("country"), F.lower(F.min(blank_to_null("seniority"))).alias("level"))
    return req.join(ads, req["posting_id"] == ads["id"]).drop("id")


def explorer_index(spark: SparkSession, folder: str) -> DataFrame:
    return X.requirement_index(_rows(spark, folder), "req_group", "posting_id", "company", 30, 8)


def explorer_seniority(spark: SparkSession, folder: str) -> DataFrame:
    return X.breakdown(_rows(spark, folder), "req_group", "posting_id", "level")


def explorer_countries(spark: SparkSession, folder: str) -> DataFrame:
    return X.breakdown(_rows(spark, folder), "req_group", "posting_id", "country")


def explorer_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Adverts per requirement group and title key."""
    titles = table(spark, folder, "titles").filter("trim(title_key) <> '' AND title_key <> 'nuovo' AND trim(posting_id) <> ''").groupBy("posting_id").agg(F.min("title_key").alias("role"))
    return X.breakdown(_rows(spark, folder).join(titles, "posting_id"), "req_group", "posting_id", "role", 3)


def cooccurrence_lift(spark: SparkSession, folder: str) -> DataFrame:
    out = X.cooccurrence(_rows(spark, folder), "posting_id", "req_group", 20, 30)
    return out.withColumn("lift", F.round("lift", 6))


def drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").dropDuplicates(["req_id"])
    reason = X.drop_reason(F.col("counted"), F.col("route"), F.col("req_topic"), F.col("core"), F.col("head_group"))
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def unit_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "req_cores").select("req_topic", X.unit_of(F.col("req_topic")).alias("unit")).distinct()


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return X.slugs(table(spark, folder, "req_cores").select("req_core", (F.col("n") * 1000 + F.length("req_core")).alias("place")), "req_core", "place")


def advert_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "postings").select("posting_row", X.advert_key(F.col("id"), F.col("title"), F.col("must_have")).alias("key"))


def unique_adverts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select(X.advert_key(F.col("id"), F.col("title"), F.col("must_have")).alias("key"), "posting_row", "title")
    return X.unique_adverts(rows, "key", ["posting_row"])


def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "requirements").filter("item IS NOT NULL AND translated").select("item").distinct()
    return items.select("item", X.cache_key(F.lit("de"), F.col("item")).alias("key"))


def loo_verdict(spark: SparkSession, folder: str) -> DataFrame:
    out = X.loo_verdicts(facts(spark, folder), "industry", "posting", "brand")
    return out.groupBy("industry", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean_share"))


def expected_missing(spark: SparkSession, folder: str) -> DataFrame:
    """What the adverts of one industry and level mostly ask for and an advert does not, over all industries."""
    rows = facts(spark, folder).withColumn("role", F.struct("industry", "level"))
    return X.expected_missing(rows, "role", "posting", "type", 0.45)


def saturation_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").filter("trim(posting_id) <> '' AND atom_norm IS NOT NULL").select("posting_id", "processed_at", "req_id", "atom_norm")
    return X.vocabulary_growth(rows, "posting_id", "atom_norm", ["processed_at", "req_id"], 10)


def heaps_fit(spark: SparkSession, folder: str) -> DataFrame:
    fit = X.heaps_fit(saturation_curve(spark, folder))
    return fit.select(F.round("k", 4).alias("k"), F.round("beta", 6).alias("beta"))


def holdout_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of held-out adverts (ids ending in 0 or 1) as the training share grows."""
    rows = table(spark, folder, "requirements").filter("trim(posting_id) <> '' AND atom_norm IS NOT NULL").select("posting_id", "atom_norm")
    return X.holdout_coverage(rows, "posting_id", "atom_norm", F.col("posting_id").rlike("[01]$"), 8)


def normalise_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "requirements").select("item").distinct().select("item", T.normalise(F.col("item")).alias("normal"))


def clean_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "requirements").select("item").distinct().select("item", T.clean(F.col("item")).alias("cleaned"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "postings").select("posting_row", F.array_join("must_have", " | ").alias("cell"))
    return joined.select("posting_row", F.posexplode(T.segments(F.col("cell"))).alias("pos", "segment")).withColumn("pos", F.col("pos").cast("bigint"))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Detected against recorded language of the documents."""
    rows = table(spark, folder, "documents").select("lang", T.detect_language(F.col("text")).alias("detected"))
    return rows.groupBy(F.substring(F.lower(F.trim("lang")), 1, 2).alias("recorded"), "detected").agg(F.count(F.lit(1)).alias("n"))


def language_backfill(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.lower(F.substring(F.trim("lang"), 1, 2)).alias("recorded"), T.detect_language(F.col("text")).alias("detected"))
    source = F.when(F.coalesce("recorded", F.lit("")) != "", "recorded").when(F.col("detected").isNotNull(), "detected").otherwise("none")
    return rows.select("doc_id", F.coalesce(F.nullif("recorded", F.lit("")), "detected").alias("language"), source.alias("source"))


def language_shape(spark: SparkSession, folder: str) -> DataFrame:
    """The commonest recorded language of each source with its share."""
    counts = table(spark, folder, "documents").groupBy("source", F.coalesce(F.nullif(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("")), F.lit("(unknown)")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("source").agg(F.sum("n").alias("documents"), F.min(F.struct((-F.col("n")).alias("m"), "language")).alias("b"))
    return best.select("source", "documents", F.col("b.language").alias("language"), F.round(-F.col("b.m") / F.col("documents"), 6).alias("share"))


def lexicon_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Types of the distinct atoms, classified once each and counted over all rows."""
    rows = table(spark, folder, "requirements").filter("atom_norm IS NOT NULL").select("atom_norm")
    return T.map_distinct(rows, "atom_norm", T.classify, "type").groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("atom_norm").alias("atoms"))


def first_years(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requirements").select(T.first_years(F.col("item")).alias("years")).filter("years IS NOT NULL")
    return rows.groupBy("years").agg(F.count(F.lit(1)).alias("items"))


def nice_to_have(spark: SparkSession, folder: str) -> DataFrame:
    """Optional items per posting and how many of its items count."""
    per = table(spark, folder, "postings").filter("size(must_have) > 0").select("posting_row", F.transform("must_have", lambda x: T.nice_to_have(x)).alias("o"))
    return per.select("posting_row", F.size(F.filter("o", lambda x: x)).cast("bigint").alias("optional"), F.size(F.filter(T.counted(F.col("o")), lambda x: x)).cast("bigint").alias("counted"))


def title_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "titles").select("title").distinct().select("title", T.title_key(F.col("title")).alias("key"), T.title_level(F.col("title")).alias("level"))


def title_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct titles, and how many reach 2, 5 and 10 rows, by stage of cleaning."""
    rows = table(spark, folder, "titles").filter("title IS NOT NULL").dropDuplicates(["title_id"])
    stages = F.array(*[F.struct(F.lit(n).alias("stage"), v.alias("value")) for n, v in (("raw", F.col("title")), ("cleaned", T.clean_title(F.col("title"))), ("key", T.title_key(F.col("title"))))])
    counts = rows.select(F.explode(stages).alias("s")).groupBy("s.stage", "s.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("stage").agg(F.count(F.lit(1)).alias("distinct_values"), *[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (2, 5, 10)], F.sum("n").alias("rows"))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every word of the normalised atoms per head group."""
    rows = table(spark, folder, "requirements").filter("atom_norm IS NOT NULL").select("head_group", F.explode(F.split("atom_norm", r"\s+")).alias("word")).filter("word <> ''")
    return rows.groupBy("head_group", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


def ctfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The six words that tell each head group apart: (tf / sum tf) x ln(1 + N / df)."""
    rows = table(spark, folder, "requirements").filter("atom_norm IS NOT NULL AND trim(head_group) <> ''").select("head_group", F.explode(F.split("atom_norm", r"\s+")).alias("word")).filter("word <> ''")
    tf = rows.groupBy("head_group", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.sum("tf").alias("df"))
    sizes = tf.groupBy("head_group").agg(F.sum("tf").alias("total"))
    n = tf.agg(F.sum("tf").alias("n"))
    score = (F.col("tf") / F.col("total")) * F.log(1 + F.col("n") / F.col("df"))
    out = tf.join(df, "word").join(sizes, "head_group").join(F.broadcast(n)).withColumn("score", score)  # one row of totals
    w = Window.partitionBy("head_group").orderBy(F.desc(F.round("score", 9)), "word")
    return out.withColumn("rank", F.row_number().over(w)).filter("rank <= 6").select("head_group", "word", F.round("score", 6).alias("score"), "rank")


def cluster_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Every topic with its size, spread, mean length and commonest route."""
    rows = table(spark, folder, "requirements").filter("trim(req_topic) <> ''")
    words = F.size(F.split(F.trim("atom_norm"), r"\s+"))
    base = rows.groupBy("req_topic").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("atom_norm").alias("distinct_atoms"), F.count_distinct("posting_id").alias("postings"), F.round(F.avg(words), 6).alias("mean_words"))
    routes = rows.groupBy("req_topic", "route").agg(F.count(F.lit(1)).alias("n")).groupBy("req_topic").agg(F.min(F.struct((-F.col("n")).alias("m"), "route")).alias("b"))
    return base.join(routes, "req_topic").select("req_topic", "occurrences", "distinct_atoms", "postings", "mean_words", F.col("b.route").alias("top_route"))


def vocabulary_top25(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 commonest content words of every topic; ties go to the smaller word."""
    rows = table(spark, folder, "requirements").filter("trim(req_topic) <> ''").select("req_topic", F.explode(F.regexp_extract_all("atom_norm", F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    counts = rows.filter(~F.col("word").isin("with", "and", "the", "for", "experience", "knowledge")).groupBy("req_topic", "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("req_topic").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter("rank <= 25")


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return S.hash_split(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 0.3, SEED)


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return S.alternating_split(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], SEED)


def stratified_quota(spark: SparkSession, folder: str) -> DataFrame:
    return S.quota_sample(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", {"MACHINERY": 40, "HOUSEHOLD": 20}, SEED).select("c_custkey", "c_mktsegment", "draw")


def sampling_weights(spark: SparkSession, folder: str) -> DataFrame:
    return S.proportional_quota(table(spark, folder, "requirements").select("route"), "route", 150, 20)


def recent_holdout(spark: SparkSession, folder: str) -> DataFrame:
    return S.recent_holdout(table(spark, folder, "postings").filter("created_at IS NOT NULL").select("posting_row", "created_at"), "posting_row", "created_at", 0.15).select("posting_row", "part")


def greedy_match(spark: SparkSession, folder: str) -> DataFrame:
    """Split quality of the recorded atoms against the packed values, as precision and recall."""
    from millrace.operators.packed import packed_values

    rows = table(spark, folder, "requirements").filter("atom IS NOT NULL").dropDuplicates(["req_id"])
    pairs = rows.groupBy("posting_id", "item_idx").agg(F.array_sort(F.collect_list("atom")).alias("predicted"), F.flatten(F.array_sort(F.collect_list(packed_values(F.col("atom"))))).alias("truth"))
    return S.score_splits(pairs, "predicted", "truth")


QUERIES = {f.__name__: f for f in (
    explorer_index, explorer_seniority, explorer_countries, explorer_roles, cooccurrence_lift, drop_reasons, unit_names, slugs, advert_key, unique_adverts, cache_keys, loo_verdict, expected_missing,
    saturation_curve, heaps_fit, holdout_coverage, normalise_text, clean_items, segments, language_id, language_backfill, language_shape, lexicon_classify, first_years, nice_to_have, title_key, title_depth,
    word_counts, ctfidf_terms, cluster_dictionary, vocabulary_top25, hash_split, stratified_split, stratified_quota, sampling_weights, recent_holdout, greedy_match,
)}

_ROWS = """r AS (SELECT DISTINCT posting_id, req_group, req_topic, head_group, core FROM requirements WHERE trim(posting_id) <> '' AND trim(req_group) <> ''),
a AS (SELECT id, min(company_id) AS company, upper(trim(min(CASE WHEN trim(geo_country) <> '' THEN geo_country END))) AS country, lower(min(CASE WHEN trim(seniority) <> '' THEN seniority END)) AS level FROM postings WHERE trim(id) <> '' GROUP BY 1),
x AS (SELECT r.*, company, country, level FROM r JOIN a ON posting_id = id)"""


def _facet(facet: str, source: str = "x") -> str:
    return f"""s AS (SELECT DISTINCT req_group, posting_id, {facet} FROM {source} WHERE {facet} IS NOT NULL), c AS (SELECT req_group, {facet}, count(*) AS adverts FROM s GROUP BY 1, 2),
f AS (SELECT req_group, {facet}, adverts, round(adverts / sum(adverts) OVER (PARTITION BY req_group), 6) AS share FROM c)"""


_GROWTH = """g AS (SELECT posting_id, atom_norm, processed_at, req_id FROM requirements WHERE trim(posting_id) <> '' AND atom_norm IS NOT NULL),
ad AS (SELECT posting_id, row_number() OVER (ORDER BY min(processed_at), min(req_id), posting_id) AS rank, count(*) OVER () AS total FROM g GROUP BY 1),
fi AS (SELECT atom_norm, min(rank) AS f, any_value(total) AS total FROM g JOIN ad ON g.posting_id = ad.posting_id GROUP BY 1),
cu AS (SELECT step::INT AS step, (SELECT count(*) FROM fi WHERE ceil(f * 10 / total) <= step) AS vocabulary, (SELECT floor(step * max(total) / 10)::BIGINT FROM fi) AS adverts FROM range(1, 11) t(step))"""
_N = r"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(item), 'ł', 'l')), '[^\p{L}\p{N}_+#.\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TOK = "list_distinct(string_split(lower(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')), ' '))"
_HITS = "h AS (SELECT doc_id, lang, " + ", ".join(f"len(list_intersect({_TOK}, {T.DISTINCTIVE[l]!r})) AS {l}_h" for l in T.DISTINCTIVE) + " FROM documents)"
_DETECT = _HITS + ", k AS (SELECT doc_id, lang, list_reverse_sort([" + ", ".join(f"{{'h': {l}_h, 'l': '{l}'}}" for l in T.DISTINCTIVE) + "]) AS r FROM h), dt AS (SELECT doc_id, lang, CASE WHEN r[1].h >= 2 AND r[1].h - r[2].h >= 1 THEN r[1].l END AS detected FROM k)"
_REC = "lower(trim(lang)[1:2])"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(atom_norm), '{p}') THEN '{k}'" for k, p in T.LEXICON) + " END"
_CT = r"regexp_replace(regexp_replace(lower(coalesce(title, '')), '\([^)]*\)|\[[^\]]*\]|#\d+|\bref\.?\s*:?\s*\d+\s*:?|\b[mfhwdxv](?:/[mfhwdxv])+\b|\d+-\d+\s*%|\*', ' ', 'g'), '\s[|–—-]\s.*$', ' ')"
_CT = rf"trim(regexp_replace(regexp_replace({_CT}, '[^\p{{L}}\p{{N}}+#./& -]', ' ', 'g'), '\s+', ' ', 'g'))"
_KEY = rf"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace({_CT}, '{T.LEVELS}', ' ', 'g'), '[^\p{{L}}\p{{N}}+#]+'), lambda w: w <> '' AND w NOT IN ('for', 'of', 'the', 'and', 'in', 'a')))), ' ')"
_LEVEL = r"regexp_extract(lower(coalesce(title, '')), '\b(senior|junior|sr|jr|lead|principal|trainee|mid-level)\b', 1)"

ORACLES = {
    "explorer_index": f"WITH {_ROWS} SELECT req_group, count(DISTINCT posting_id) AS adverts, count(DISTINCT company) AS companies FROM x GROUP BY 1 HAVING count(DISTINCT posting_id) >= 30 AND count(DISTINCT company) >= 8",
    "explorer_seniority": f"WITH {_ROWS}, {_facet('level')} SELECT * FROM f",
    "explorer_countries": f"WITH {_ROWS}, {_facet('country')} SELECT * FROM f",
    "explorer_roles": f"""WITH {_ROWS}, t AS (SELECT posting_id, min(title_key) AS role FROM titles WHERE trim(title_key) <> '' AND title_key <> 'nuovo' AND trim(posting_id) <> '' GROUP BY 1),
y AS (SELECT x.*, role FROM x JOIN t ON x.posting_id = t.posting_id), {_facet('role', 'y')} SELECT * FROM f WHERE adverts >= 3""",
    "cooccurrence_lift": f"""WITH {_ROWS}, s AS (SELECT DISTINCT posting_id, req_group FROM x), n AS (SELECT req_group, count(*) AS n FROM s GROUP BY 1), t AS (SELECT count(DISTINCT posting_id) AS t FROM s),
j AS (SELECT p.req_group AS obj, q.req_group AS other, count(*) AS joint FROM s p JOIN s q ON p.posting_id = q.posting_id AND p.req_group <> q.req_group GROUP BY 1, 2 HAVING count(*) >= 20),
l AS (SELECT obj, other, joint, joint * t / (u.n * v.n) AS lift FROM j JOIN n u ON u.req_group = obj JOIN n v ON v.req_group = other, t)
SELECT obj, other, joint, round(lift, 6) AS lift, row_number() OVER (PARTITION BY obj ORDER BY round(l.lift, 9) DESC, joint DESC, other) AS rank FROM l QUALIFY rank <= 30""",
    "drop_reasons": """WITH r AS (SELECT DISTINCT ON (req_id) * FROM requirements)
SELECT CASE WHEN NOT coalesce(counted, TRUE) THEN 'not_counted' WHEN route = 'damaged' THEN 'damaged' WHEN trim(coalesce(req_topic, '')) = '' THEN 'no_topic' WHEN head_group = 'education' AND trim(coalesce(core, '')) = '' THEN 'degree_suspect'
WHEN lower(core) IN ('skills', 'experience', 'knowledge') THEN 'generic' ELSE 'kept' END AS reason, count(*) AS rows FROM r GROUP BY 1""",
    "unit_names": r"SELECT DISTINCT req_topic, lower(trim(regexp_replace(replace(replace(replace(regexp_replace(req_topic, '^(?:topic-|[a-z]+:)', ''), '’', ''''), '`', ''''), '´', ''''), '\s+', ' ', 'g'))) AS unit FROM req_cores",
    "slugs": """WITH b AS (SELECT req_core, n * 1000 + length(req_core) AS place, regexp_replace(regexp_replace(lower(req_core), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM req_cores),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY place) AS r FROM b) SELECT req_core, CASE WHEN r = 1 THEN s ELSE s || '-' || r END AS slug FROM r""",
    "advert_key": "SELECT posting_row, substr(sha256(CASE WHEN trim(coalesce(id, '')) <> '' THEN 'i:' || id ELSE 't:' || coalesce(title, '') || chr(0) || coalesce(array_to_string(must_have, chr(0)), '') END), 1, 16) AS key FROM postings",
    "unique_adverts": """WITH k AS (SELECT substr(sha256(CASE WHEN trim(coalesce(id, '')) <> '' THEN 'i:' || id ELSE 't:' || coalesce(title, '') || chr(0) || coalesce(array_to_string(must_have, chr(0)), '') END), 1, 16) AS key, posting_row, title FROM postings)
SELECT key, posting_row, title FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY posting_row) = 1""",
    "cache_keys": "SELECT DISTINCT item, substr(sha256('de' || chr(0) || item), 1, 32) AS key FROM requirements WHERE item IS NOT NULL AND translated",
    "loo_verdict": f"""WITH {FACTS_SQL}, s AS (SELECT DISTINCT industry, posting, brand FROM facts), c AS (SELECT industry, brand, count(*) AS c FROM s GROUP BY 1, 2), n AS (SELECT industry, count(DISTINCT posting) AS n FROM s GROUP BY 1),
v AS (SELECT s.industry, (c - 1) / (n - 1) AS share FROM s JOIN c ON s.industry = c.industry AND s.brand = c.brand JOIN n ON s.industry = n.industry)
SELECT industry, CASE WHEN share >= 0.3 THEN 'standard' WHEN share >= 0.1 THEN 'common' ELSE 'unusual' END AS verdict, count(*) AS n, round(avg(share), 6) AS mean_share FROM v GROUP BY 1, 2""",
    "holdout_coverage": """WITH r AS (SELECT posting_id, atom_norm, regexp_matches(posting_id, '[01]$') AS test FROM requirements WHERE trim(posting_id) <> '' AND atom_norm IS NOT NULL),
f AS (SELECT atom_norm, min(('0x' || substr(sha256('holdout|' || posting_id), 1, 10))::BIGINT / 1099511627776.0::DOUBLE) AS u FROM r WHERE NOT test GROUP BY 1)
SELECT step::INT AS step, round(avg(CASE WHEN coalesce(u, 2.0) < step / 8.0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM r LEFT JOIN f ON r.atom_norm = f.atom_norm, range(1, 9) k(step) WHERE test GROUP BY 1""",
    "expected_missing": f"""WITH {FACTS_SQL}, s AS (SELECT DISTINCT industry, level, posting, type FROM facts), n AS (SELECT industry, level, count(DISTINCT posting) AS n FROM s GROUP BY 1, 2),
u AS (SELECT s.industry, s.level, type FROM s JOIN n ON s.level = n.level AND s.industry = n.industry GROUP BY 1, 2, 3, n HAVING count(*) / n >= 0.45)
SELECT DISTINCT s.posting, u.type FROM s JOIN u ON s.level = u.level AND s.industry = u.industry WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.posting = s.posting AND y.type = u.type)""",
    "saturation_curve": f"WITH {_GROWTH} SELECT step, adverts, vocabulary FROM cu",
    "heaps_fit": f"WITH {_GROWTH}, p AS (SELECT ln(adverts) AS x, ln(vocabulary) AS y FROM cu WHERE adverts >= 0.2 * (SELECT max(adverts) FROM cu)) SELECT round(exp(regr_intercept(y, x)), 4) AS k, round(regr_slope(y, x), 6) AS beta FROM p",
    "normalise_text": f"SELECT DISTINCT item, {_N} AS normal FROM requirements",
    "clean_items": r"SELECT DISTINCT item, regexp_replace(regexp_replace(regexp_replace(item, '^[\s\-*•·–—,;:.]+', ''), '[\s,;:.]+$', ''), '\s+', ' ', 'g') AS cleaned FROM requirements",
    "segments": """WITH c AS (SELECT posting_row, list_filter(list_transform(string_split(array_to_string(must_have, ' | '), '|'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM postings)
SELECT posting_row, unnest(range(0, len(s))) AS pos, unnest(s) AS segment FROM c""",
    "language_id": f"WITH {_DETECT} SELECT {_REC} AS recorded, detected, count(*) AS n FROM dt GROUP BY 1, 2",
    "language_backfill": f"WITH {_DETECT} SELECT doc_id, coalesce(nullif({_REC}, ''), detected) AS language, CASE WHEN coalesce({_REC}, '') <> '' THEN 'recorded' WHEN detected IS NOT NULL THEN 'detected' ELSE 'none' END AS source FROM dt",
    "language_shape": f"""WITH c AS (SELECT source, coalesce(nullif({_REC}, ''), '(unknown)') AS language, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, t::BIGINT AS documents, language, round(n / t, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS t FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, language) = 1)""",
    "lexicon_classify": f"SELECT {_CLASS} AS type, count(*) AS rows, count(DISTINCT atom_norm) AS atoms FROM requirements WHERE atom_norm IS NOT NULL GROUP BY 1",
    "first_years": f"WITH y AS (SELECT try_cast(regexp_extract(lower(item), '{T.YEARS}', 1) AS INT) AS years FROM requirements) SELECT years, count(*) AS items FROM y WHERE years BETWEEN 1 AND 25 GROUP BY 1",
    "nice_to_have": f"""WITH o AS (SELECT posting_row, list_transform(must_have, lambda x: coalesce(regexp_matches(lower(x), '{T.OPTIONAL}'), FALSE)) AS o FROM postings WHERE len(must_have) > 0),
c AS (SELECT posting_row, len(list_filter(o, lambda x: x)) AS optional, len(o) AS n FROM o) SELECT posting_row, optional, CASE WHEN optional = n THEN n ELSE n - optional END AS counted FROM c""",
    "title_key": f"SELECT DISTINCT title, {_KEY} AS key, CASE {_LEVEL} WHEN 'sr' THEN 'senior' WHEN 'jr' THEN 'junior' ELSE {_LEVEL} END AS level FROM titles",
    "title_depth": f"""WITH r AS (SELECT DISTINCT ON (title_id) title FROM titles WHERE title IS NOT NULL), s AS (SELECT 'raw' AS stage, title AS v FROM r UNION ALL SELECT 'cleaned', {_CT} FROM r UNION ALL SELECT 'key', {_KEY} FROM r),
c AS (SELECT stage, v, count(*) AS n FROM s GROUP BY 1, 2) SELECT stage, count(*) AS distinct_values, count(*) FILTER (n >= 2) AS at_least_2, count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n >= 10) AS at_least_10, sum(n)::BIGINT AS rows FROM c GROUP BY 1""",
    "word_counts": r"WITH w AS (SELECT head_group, unnest(regexp_split_to_array(atom_norm, '\s+')) AS word FROM requirements WHERE atom_norm IS NOT NULL) SELECT head_group, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2 HAVING count(*) >= 5",
    "ctfidf_terms": r"""WITH w AS (SELECT head_group, unnest(regexp_split_to_array(atom_norm, '\s+')) AS word FROM requirements WHERE atom_norm IS NOT NULL AND trim(head_group) <> ''), tf AS (SELECT head_group, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY 1, 2),
df AS (SELECT word, sum(tf) AS df FROM tf GROUP BY 1), s AS (SELECT head_group, sum(tf) AS total FROM tf GROUP BY 1), n AS (SELECT sum(tf) AS n FROM tf),
r AS (SELECT tf.head_group, tf.word, tf / total * ln(1 + n / df) AS score FROM tf JOIN df ON tf.word = df.word JOIN s ON tf.head_group = s.head_group, n)
SELECT head_group, word, round(score, 6) AS score, row_number() OVER (PARTITION BY head_group ORDER BY round(r.score, 9) DESC, word) AS rank FROM r QUALIFY rank <= 6""",
    "cluster_dictionary": r"""WITH r AS (SELECT * FROM requirements WHERE trim(req_topic) <> ''), c AS (SELECT req_topic, route, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT req_topic, route FROM c QUALIFY row_number() OVER (PARTITION BY req_topic ORDER BY n DESC, route) = 1)
SELECT r.req_topic, count(*) AS occurrences, count(DISTINCT atom_norm) AS distinct_atoms, count(DISTINCT posting_id) AS postings, round(avg(len(regexp_split_to_array(trim(atom_norm), '\s+'))), 6) AS mean_words, any_value(b.route) AS top_route FROM r JOIN b ON r.req_topic = b.req_topic GROUP BY 1""",
    "vocabulary_top25": """WITH w AS (SELECT req_topic, unnest(regexp_extract_all(atom_norm, '[a-z]{3,}')) AS word FROM requirements WHERE trim(req_topic) <> ''), c AS (SELECT req_topic, word, count(*) AS n FROM w WHERE word NOT IN ('with', 'and', 'the', 'for', 'experience', 'knowledge') GROUP BY 1, 2)
SELECT req_topic, word, n, row_number() OVER (PARTITION BY req_topic ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 25""",
    "hash_split": f"SELECT c_custkey, CASE WHEN ('0x' || substr(sha256('{SEED}|' || c_custkey), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'holdout' ELSE 'dev' END AS part FROM customer",
    "stratified_split": f"SELECT c_custkey, c_mktsegment, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}|' || c_custkey)) % 2 = 0 THEN 'holdout' ELSE 'dev' END AS part FROM customer",
    "stratified_quota": f"""SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}|' || c_custkey)) AS draw FROM customer
QUALIFY draw <= CASE c_mktsegment WHEN 'MACHINERY' THEN 40 WHEN 'HOUSEHOLD' THEN 20 ELSE 0 END""",
    "sampling_weights": """WITH p AS (SELECT route, count(*) AS pool FROM requirements GROUP BY 1), q AS (SELECT route, pool, least(pool, greatest(20, round(150 * pool / sum(pool) OVER ())::BIGINT)) AS quota FROM p)
SELECT route, pool, quota, round((pool / sum(pool) OVER ()) / (quota / sum(quota) OVER ()), 6) AS weight FROM q""",
    "recent_holdout": "WITH q AS (SELECT quantile_cont(epoch_us(created_at)::DOUBLE, 0.85) AS q FROM postings WHERE created_at IS NOT NULL) SELECT posting_row, CASE WHEN epoch_us(created_at) > q THEN 'holdout' ELSE 'dev' END AS part FROM postings, q WHERE created_at IS NOT NULL",
}
