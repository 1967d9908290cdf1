"""Queries of the review of runs: wording, lookups of held-out postings, candidates, samples of pairs, routing, null models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import wording as W
from millrace.operators import graph, review
from millrace.operators import profiles as P
from millrace.operators import vectors as V
from millrace.operators.sampling import rank_key
from millrace.plans.q_profiles import _DIST
from millrace.plans.star import FACTS_SQL, facts
from millrace.sources.tables import table

MONTHS = ["2025-09", "2025-10"]


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "requirements")


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#]+", "")


def reference_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct atoms of the months that references are drawn from."""
    return review.in_months(_rows(spark, folder).filter("atom_norm IS NOT NULL"), "processed_at", MONTHS).select("atom_norm").distinct()


def month_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "postings").filter("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


def bare_heads(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).groupBy("head_group", W.bare_head(F.col("atom_norm")).alias("flag")).agg(F.count(F.lit(1)).alias("rows"))


def display_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "req_cores").select("req_core", W.display(F.col("req_space"), F.col("req_core")).alias("shown"))


def plain_requirements(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct items whose frame goes, without it."""
    rows = _rows(spark, folder).select("item").filter("item IS NOT NULL").distinct().withColumn("plain", W.plain_requirement(F.col("item")))
    return rows.filter("plain <> item")


def role_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of titles, with a slash or `or`, that name two roles at once."""
    rows = table(spark, folder, "titles").select("title").filter("title IS NOT NULL").distinct()
    return rows.select("title", F.posexplode(W.role_alternatives(F.col("title"))).alias("at", "role"))


def title_variants(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "title_dictionary").select("title_key", F.explode(W.title_variants(F.col("title_key"))).alias("variant"))


def title_families(spark: SparkSession, folder: str) -> DataFrame:
    """Titles joined by a variant that they share: each with the first title of its family."""
    forms = title_variants(spark, folder)
    first = forms.groupBy("variant").agg(F.min("title_key").alias("a"))
    pairs = forms.join(first, "variant").select("a", F.col("title_key").alias("b")).filter("a < b").distinct()
    return graph.connected_components(pairs)


def core_variants(spark: SparkSession, folder: str) -> DataFrame:
    """What each core may be another spelling of: without its version, bracket or generic last word."""
    cores = table(spark, folder, "req_cores").select("req_core")
    forms = cores.select("req_core", F.explode(W.core_variants(F.col("req_core"))).alias("x")).select("req_core", "x.kind", "x.form")
    return forms


def inspections(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).groupBy("route", F.coalesce(W.inspection(F.col("core")), F.lit("none")).alias("flag")).agg(F.count(F.lit(1)).alias("rows"))


def further_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Items in which words of a further language occur."""
    items = table(spark, folder, "postings").select("posting_row", F.posexplode("must_have").alias("item_idx", "item"))
    found = items.select("posting_row", "item_idx", W.further_language(F.col("item")).alias("x")).filter("x IS NOT NULL")
    return found.select("posting_row", "item_idx", "x.lang", "x.hits")


def held_out_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the postings looked up in the dictionary of the others."""
    rows = _rows(spark, folder).filter("trim(posting_id) <> '' AND trim(core) <> '' AND trim(req_group) <> ''").select("req_id", "posting_id", "core", "req_group").distinct()
    return review.held_out_lookup(rows, "posting_id", "core", "req_group", 0.1, "lookup")


def label_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Reference cores whose letters are those of one of a group's atoms."""
    labels = table(spark, folder, "req_cores").withColumn("order_", -F.col("n"))
    return review.label_candidates(_rows(spark, folder).filter("trim(req_group) <> '' AND atom_norm IS NOT NULL"), "req_group", "atom_norm", labels, "req_core", "order_", _key)


def split_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Atoms of an item against the values that stand between its marks: exact, merged or over-split, by route."""
    rows = _rows(spark, folder).filter("trim(posting_id) <> '' AND item IS NOT NULL").groupBy("posting_id", "job", "item_idx", "item").agg(F.count_distinct("atom_idx").alias("atoms"), F.min("route").alias("route"))
    marks = F.size(F.filter(F.split("item", r"[;|\n•]"), lambda x: F.trim(x) != ""))
    verdict = F.when(F.col("atoms") == marks, "exact").when(F.col("atoms") < marks, "merged").otherwise("over_split")
    return rows.groupBy("route", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("items"))


def judged_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements that found nothing, by kind of requirement and by how they were split."""
    rows = _rows(spark, folder).select("req_id", "head_group", "route", "match_status").distinct()
    out = rows.groupBy("head_group", "route").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("match_status") == "nuovo").alias("flagged"))
    return out.withColumn("share", F.round(F.col("flagged") / F.col("judged"), 6))


def decision_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision taken by similarity, as a pair to be judged."""
    return _rows(spark, folder).filter("match_status IN ('group', 'topic') AND trim(match_via) <> ''").select(F.col("match_status").alias("sample"), F.col("atom_norm").alias("a"), F.col("match_via").alias("b")).distinct()


def decision_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs by decision and band of the cosine, and how many of them name the group of their core."""
    cores = table(spark, folder, "req_cores").select(F.col("req_core").alias("match_via"), F.col("req_group").alias("expected"))
    rows = _rows(spark, folder).filter("match_status IN ('group', 'topic')").select("match_status", "atom_norm", "match_via", "req_group", F.floor(F.col("match_cosine") * 20).cast("int").alias("band")).distinct()
    rows = rows.join(cores, "match_via", "left")
    return rows.groupBy("match_status", "band").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("expected") != F.col("req_group")).alias("errors"), F.count_if(F.col("expected").isNull() | F.col("req_group").isNull()).alias("unsure"))


def item_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """How many items have the same signature: kinds of requirement in order of the alphabet, and their number."""
    rows = _rows(spark, folder).filter("trim(posting_id) <> ''").select("posting_id", "job", "item_idx", "atom_idx", F.coalesce("head_group", F.lit("")).alias("h")).distinct()
    per = rows.groupBy("posting_id", "job", "item_idx").agg(F.array_join(F.array_sort(F.collect_list("h")), "|").alias("signature"), F.count(F.lit(1)).alias("atoms"))
    return per.groupBy("signature", "atoms").agg(F.count(F.lit(1)).alias("items"))


def scale_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that would reach 300 requirements if the corpus were 1, 2, 5 or 10 times as large."""
    counts = _rows(spark, folder).filter("trim(req_group) <> ''").groupBy("req_group").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("n", F.explode(F.array(*map(F.lit, (1, 2, 5, 10)))).alias("times")).groupBy("times").agg(F.count_if(F.col("n") * F.col("times") >= 300).alias("groups"), F.count(F.lit(1)).alias("all_groups"))


def concept_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors nearest to the centre of each label."""
    rows = table(spark, folder, "embeddings")
    out = review.nearest_per_entry(rows, "vec_id", "embedding", V.centroids(rows, "label", "embedding"), "label", "centroid", 5)
    return out.select(F.col("entry").alias("label"), F.col("key").alias("vec_id"), "rank", F.round("cosine", 6).alias("cosine"))


def neighbour_label_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the ten nearest vectors that have the label of the vector, and the share to be expected by chance."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    near = review.nearest_per_entry(rows, "vec_id", "embedding", rows, "vec_id", "embedding", 10, own=True)
    names = rows.select("vec_id", "label")
    both = near.join(names.withColumnsRenamed({"vec_id": "entry", "label": "mine"}), "entry").join(names.withColumnsRenamed({"vec_id": "key", "label": "theirs"}), "key")
    chance = names.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t")).select((F.col("s") / (F.col("t") * F.col("t"))).alias("chance"))
    same = both.agg(F.avg((F.col("mine") == F.col("theirs")).cast("double")).alias("same"))
    return same.crossJoin(chance).select(F.round("same", 6).alias("same"), F.round("chance", 6).alias("chance"))  # one row beside one row


def null_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """The best cosine of every label's centre, and of the same centre with its places shuffled."""
    rows = table(spark, folder, "embeddings")
    centres = V.centroids(rows, "label", "embedding").select("label", "centroid")
    real = review.nearest_per_entry(rows, "vec_id", "embedding", centres, "label", "centroid", 1).select(F.col("entry").alias("label"), F.col("cosine").alias("best"))
    null = review.nearest_per_entry(rows, "vec_id", "embedding", review.shuffled_vectors(centres, "label", "centroid", "null"), "label", "centroid", 1).select(F.col("entry").alias("label"), F.col("cosine").alias("null_best"))
    return real.join(null, "label").select("label", F.round("best", 6).alias("best"), F.round("null_best", 6).alias("null_best"))


def anchor_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold that 95 percent of the shuffled centres stay below, and how many real ones reach it."""
    both = null_cosines(spark, folder)
    edge = both.agg(F.expr("percentile(null_best, 0.95)").alias("edge"))
    return both.crossJoin(edge).groupBy(F.round("edge", 6).alias("threshold")).agg(F.count_if(F.col("best") >= F.col("edge")).alias("anchored"), F.count(F.lit(1)).alias("labels"))  # one row beside one row per label


def corrected_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Requirements per group after atoms that were split badly left their group."""
    rows = _rows(spark, folder).filter("trim(req_group) <> '' AND atom_norm IS NOT NULL").select("req_id", "atom_norm", "req_group").distinct()
    wrong = _rows(spark, folder).filter("route = 'damaged' AND trim(req_group) <> ''").select("atom_norm", "req_group").distinct().withColumn("moved", F.lit("noise"))
    return rows.join(wrong, ["atom_norm", "req_group"], "left").groupBy(F.coalesce("moved", "req_group").alias("req_group")).agg(F.count(F.lit(1)).alias("rows"))


def topped_up_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Three postings of every country, topped up to 100 at random."""
    pool = table(spark, folder, "postings").select("posting_row", F.coalesce("geo_country", F.lit("")).alias("country"))
    quota = review.pairs_per_cell(pool, ["country"], ["posting_row"], 3, "quota").select("posting_row", "country")
    return review.topped_up(quota, pool, "posting_row", 100, "top-up").select("posting_row", "drawn")


def requirement_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen pairs of every kind, merged (0.9 and more) or just apart (0.85 to 0.9), for people to judge."""
    rows = _rows(spark, folder).filter("match_cosine >= 0.85 AND trim(match_via) <> '' AND atom_norm IS NOT NULL")
    rows = rows.select(F.coalesce("head_group", F.lit("")).alias("head_group"), F.when(F.col("match_cosine") >= 0.9, "merged").otherwise("apart").alias("decision"), "atom_norm", "match_via")
    return review.pairs_per_cell(rows, ["head_group", "decision"], ["atom_norm", "match_via"], 15, "pairs").select("head_group", "decision", "atom_norm", "match_via")


def split_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of a classifier, apart for labels whose definition still stands and others, and for all."""
    rows = table(spark, folder, "lineitem").select((F.col("l_linestatus") == "F").alias("stands"), (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") > 25).alias("predicted"))
    cut = rows.rollup("stands").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return cut.select(F.when(F.col("stands").isNull(), "all").when(F.col("stands"), "stands").otherwise("changed").alias("part"), "n", "accuracy")


def routing_score(spark: SparkSession, folder: str) -> DataFrame:
    """How well the route `llm` finds items with several marks."""
    rows = _rows(spark, folder).filter("item IS NOT NULL").select("item", "route").distinct()
    several = F.size(F.split("item", r"[;|,]")) >= 3
    return review.routing_score(rows, F.col("route") == "llm", several, F.length("item"))


def gate_table(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy, routing precision and recall against their floors."""
    acc = split_accuracy(spark, folder).select(F.concat(F.lit("accuracy_"), "part").alias("metric"), F.col("accuracy").alias("value"))
    score = routing_score(spark, folder)
    rest = score.select(F.explode(F.array(*[F.struct(F.lit(f"routing_{m}").alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall")])).alias("x")).select("x.*")
    return review.gate(acc.unionByName(rest), "metric", "value", {"accuracy_all": 0.6, "accuracy_stands": 0.4, "routing_precision": 0.5, "routing_recall": 0.05})


def path_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Items that two paths split alike: the recorded atoms in order against the recorded split text, letters only."""
    rows = _rows(spark, folder).filter("trim(posting_id) <> '' AND atom IS NOT NULL").select("posting_id", "job", "item_idx", "item_split", "atom_idx", "atom").distinct()
    per = rows.groupBy("posting_id", "job", "item_idx", "item_split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("atom_idx", "atom"))), lambda x: x["atom"]), "").alias("joined"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.count_if(_key(F.col("joined")) == _key(F.col("item_split"))).alias("alike"))


def split_half_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Distance between two random halves of every industry: what no real difference looks like."""
    half = F.when(F.substring(rank_key("halves", "posting"), 1, 1).isin(*"01234567"), "a").otherwise("b")
    shares = P.cell_shares(facts(spark, folder).withColumn("half", half), "industry", "half", "cluster", "posting")
    return P.grouped_index(shares, ["industry"], "half", "cluster").select("industry", F.round("js", 6).alias("js"))


QUERIES = {f.__name__: f for f in (
    reference_phrases, month_counts, bare_heads, display_names, plain_requirements, role_alternatives, title_variants, title_families, core_variants, inspections, further_languages, held_out_lookup, label_candidates,
    split_profile, judged_errors, decision_pairs, decision_rates, item_signatures, scale_projection, concept_shortlist, neighbour_label_mix, null_cosines, anchor_threshold, corrected_groups, topped_up_sample,
    requirement_pairs, split_accuracy, routing_score, gate_table, path_parity, split_half_floor,
)}

_K = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}+#]+', '', 'g')"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_ROLE = r"(?i)^(.{2,40}?)\s+(?:or|/|and/or)\s+(.{2,40}?)\s+(engineer|developer|manager|analyst|consultant|specialist|architect|administrator)s?$"
_VARIANTS = r"""low AS (SELECT title_key, lower(trim(title_key)) AS l FROM title_dictionary),
sg AS (SELECT title_key, l, array_to_string(list_sort(list_transform(regexp_split_to_array(l, '[^\p{L}\p{N}+#]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)), ' ') AS s FROM low),
vr AS (SELECT DISTINCT title_key, unnest([s, '#' || regexp_replace(l, '[^\p{L}\p{N}+#]+', '', 'g'), regexp_replace(s, '\bdeveloper\b', 'engineer', 'g')]) AS variant FROM sg)"""
_FURTHER = " UNION ALL ".join(f"SELECT posting_row, item_idx, '{l}' AS lang, list_intersect(ws, [{_list(ws)}]) AS hit FROM it" for l, ws in W.FURTHER.items())
_INSPECT = " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{n}'" for n, p in W.INSPECTIONS if n != "said_twice")
_UNIT = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings WHERE len(embedding) > 0"
_CENTRE = f"""u AS ({_UNIT}), pos AS (SELECT label, i, sum(v[i]) AS s FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM u) GROUP BY 1, 2), ce AS (SELECT label, list(s ORDER BY i) AS s FROM pos WHERE label IS NOT NULL GROUP BY 1),
cn AS (SELECT label, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS c FROM ce)"""
_NULLS = f"""{_CENTRE}, re AS (SELECT cn.label, max(round(list_dot_product(c, v), 9)) AS best FROM cn, u GROUP BY 1),
sh AS (SELECT label, list(x ORDER BY sha256('null|' || label || '|' || i)) AS c FROM (SELECT label, unnest(c) AS x, unnest(range(0, len(c))) AS i FROM cn) GROUP BY 1), nu AS (SELECT sh.label, max(round(list_dot_product(c, v), 9)) AS null_best FROM sh, u GROUP BY 1),
b AS (SELECT re.label, round(best, 6) AS best, round(null_best, 6) AS null_best FROM re JOIN nu ON re.label = nu.label)"""
_ACC = "SELECT CASE WHEN l_linestatus = 'F' THEN 'stands' ELSE 'changed' END AS part, (l_returnflag = 'R') = (l_quantity > 25) AS ok FROM lineitem"
_ROUTE = r"""rt AS (SELECT DISTINCT item, route FROM requirements WHERE item IS NOT NULL), rs AS (SELECT coalesce(route = 'llm', FALSE) AS s, len(regexp_split_to_array(item, '[;|,]')) >= 3 AS d, length(item) AS m FROM rt),
sc AS (SELECT count(*) FILTER (s AND d) AS tp, count(*) FILTER (s AND NOT d) AS fp, count(*) FILTER (NOT s AND d) AS fn, count(*) FILTER (NOT s AND NOT d) AS tn, coalesce(sum(m) FILTER (NOT s AND d), 0)::BIGINT AS missed FROM rs)"""

ORACLES = {
    "reference_phrases": f"SELECT DISTINCT atom_norm FROM requirements WHERE atom_norm IS NOT NULL AND strftime(processed_at, '%Y-%m') IN ({_list(MONTHS)})",
    "month_counts": "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS rows FROM postings WHERE created_at IS NOT NULL GROUP BY 1",
    "bare_heads": rf"""SELECT head_group, CASE WHEN len(regexp_split_to_array(w, '\s+')) = 1 THEN CASE WHEN w IN ({_list(W.RELATIONAL)}) THEN 'noun' WHEN w IN ({_list(W.FILLERS)}) THEN 'filler'
WHEN w IN ('gute', 'guten', 'guter', 'sehr', 'fundierte', 'fundierten', 'sichere', 'sicherer', 'erste', 'ersten', 'fließende', 'fließend') THEN 'adjective' END END AS flag, count(*) AS rows FROM (SELECT head_group, lower(trim(atom_norm)) AS w FROM requirements) GROUP BY 1, 2""",
    "display_names": r"""SELECT req_core, CASE WHEN coalesce(req_space, '') IN ('education', 'language') THEN req_core WHEN regexp_matches(req_core, '^\p{Ll}+al$') THEN upper(req_core[1]) || req_core[2:] || ' skills'
ELSE upper(req_core[1]) || req_core[2:] END AS shown FROM req_cores""",
    "role_alternatives": rf"""WITH t AS (SELECT DISTINCT title FROM titles WHERE title IS NOT NULL), m AS (SELECT title, regexp_extract(title, '{_ROLE}', 1) AS a, regexp_extract(title, '{_ROLE}', 2) AS b, regexp_extract(title, '{_ROLE}', 3) AS n FROM t WHERE regexp_matches(title, '{_ROLE}'))
SELECT title, 0 AS at, a || ' ' || n AS role FROM m UNION ALL SELECT title, 1, b || ' ' || n FROM m""",
    "title_variants": f"WITH {_VARIANTS} SELECT title_key, variant FROM vr",
    "title_families": f"""WITH RECURSIVE {_VARIANTS}, e AS (SELECT DISTINCT x.title_key AS a, y.title_key AS b FROM vr x JOIN vr y ON x.variant = y.variant AND x.title_key <> y.title_key),
w(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, min(w.root) FROM w JOIN e ON w.node = e.a JOIN recurring.w AS r ON r.node = e.b WHERE w.root < r.root GROUP BY 1) SELECT node, root FROM w""",
    "core_variants": rf"""WITH f AS (SELECT req_core, unnest([{{'kind': 'version', 'form': trim(regexp_replace(req_core, '\s+v?\d+(\.\d+)*\+?$', ''))}}, {{'kind': 'bracket', 'form': trim(regexp_replace(req_core, '\s*\([^()]*\)$', ''))}},
{{'kind': 'generic', 'form': trim(regexp_replace(req_core, '(?i)\s+({W.GENERIC})$', ''))}}], recursive := true) FROM req_cores) SELECT req_core, kind, form FROM f WHERE form <> req_core AND form <> ''""",
    "further_languages": rf"""WITH it AS (SELECT posting_row, unnest(range(0, len(must_have)))::INT AS item_idx, list_distinct(regexp_split_to_array(lower(unnest(must_have)), '[^\p{{L}}]+')) AS ws FROM postings),
f AS ({_FURTHER}), g AS (SELECT posting_row, item_idx, lang, len(hit)::INT AS hits FROM f WHERE len(list_filter(hit, lambda w: length(w) >= 4)) > 0)
SELECT posting_row, item_idx, lang, hits FROM g QUALIFY row_number() OVER (PARTITION BY posting_row, item_idx ORDER BY hits DESC, lang) = 1""",
    "held_out_lookup": """WITH r AS (SELECT DISTINCT req_id, posting_id, core, req_group FROM requirements WHERE trim(posting_id) <> '' AND trim(core) <> '' AND trim(req_group) <> ''),
m AS (SELECT *, ('0x' || substr(sha256('lookup|' || posting_id), 1, 8))::BIGINT < floor(0.1 * 4294967296) AS held FROM r), k AS (SELECT core, req_group AS expected FROM (SELECT core, req_group, count(*) AS n FROM m WHERE NOT held GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY core ORDER BY n DESC, req_group) = 1)
SELECT CASE WHEN expected IS NULL THEN 'new' ELSE 'known' END AS status, expected = req_group AS same, count(*) AS n FROM m LEFT JOIN k ON m.core = k.core WHERE held GROUP BY 1, 2""",
    "label_candidates": f"""WITH l AS (SELECT {_K.format('req_core')} AS key, req_core FROM req_cores QUALIFY row_number() OVER (PARTITION BY {_K.format('req_core')} ORDER BY n DESC, req_core) = 1),
t AS (SELECT DISTINCT req_group, {_K.format('atom_norm')} AS key FROM requirements WHERE trim(req_group) <> '' AND atom_norm IS NOT NULL) SELECT DISTINCT req_group, req_core AS label FROM t JOIN l ON t.key = l.key WHERE t.key <> ''""",
    "split_profile": r"""WITH p AS (SELECT posting_id, job, item_idx, item, count(DISTINCT atom_idx) AS atoms, min(route) AS route FROM requirements WHERE trim(posting_id) <> '' AND item IS NOT NULL GROUP BY ALL),
m AS (SELECT route, atoms, len(list_filter(regexp_split_to_array(item, '[;|\n•]'), lambda x: trim(x) <> '')) AS marks FROM p)
SELECT route, CASE WHEN atoms = marks THEN 'exact' WHEN atoms < marks THEN 'merged' ELSE 'over_split' END AS verdict, count(*) AS items FROM m GROUP BY 1, 2""",
    "judged_errors": """SELECT head_group, route, count(*) AS judged, count(*) FILTER (match_status = 'nuovo') AS flagged, round(count(*) FILTER (match_status = 'nuovo') / count(*), 6) AS share
FROM (SELECT DISTINCT req_id, head_group, route, match_status FROM requirements) GROUP BY 1, 2""",
    "decision_pairs": "SELECT DISTINCT match_status AS sample, atom_norm AS a, match_via AS b FROM requirements WHERE match_status IN ('group', 'topic') AND trim(match_via) <> ''",
    "decision_rates": """WITH r AS (SELECT DISTINCT match_status, atom_norm, match_via, req_group, floor(match_cosine * 20)::INT AS band FROM requirements WHERE match_status IN ('group', 'topic'))
SELECT match_status, band, count(*) AS pairs, count(*) FILTER (c.req_group <> r.req_group) AS errors, count(*) FILTER (c.req_group IS NULL OR r.req_group IS NULL) AS unsure FROM r LEFT JOIN req_cores c ON r.match_via = c.req_core GROUP BY 1, 2""",
    "item_signatures": """WITH r AS (SELECT DISTINCT posting_id, job, item_idx, atom_idx, coalesce(head_group, '') AS h FROM requirements WHERE trim(posting_id) <> ''),
p AS (SELECT posting_id, job, item_idx, array_to_string(list_sort(list(h)), '|') AS signature, count(*) AS atoms FROM r GROUP BY 1, 2, 3) SELECT signature, atoms, count(*) AS items FROM p GROUP BY 1, 2""",
    "scale_projection": """WITH c AS (SELECT count(*) AS n FROM requirements WHERE trim(req_group) <> '' GROUP BY req_group) SELECT times, count(*) FILTER (n * times >= 300) AS groups, count(*) AS all_groups FROM c, (VALUES (1), (2), (5), (10)) v(times) GROUP BY 1""",
    "concept_shortlist": f"""WITH {_CENTRE}, r AS (SELECT cn.label, vec_id, round(list_dot_product(c, v), 9) AS s FROM cn, u), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM r)
SELECT label, vec_id, rank, round(s, 6) AS cosine FROM k WHERE rank <= 5""",
    "neighbour_label_mix": f"""WITH u AS ({_UNIT}), p AS (SELECT a.vec_id, a.label = b.label AS same FROM u a JOIN u b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.vec_id) <= 10),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings GROUP BY label) SELECT round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS same, round((SELECT sum(n * n) / (sum(n) * sum(n)) FROM n), 6) AS chance FROM p""",
    "null_cosines": f"WITH {_NULLS} SELECT label, best, null_best FROM b",
    "anchor_threshold": f"WITH {_NULLS}, q AS (SELECT quantile_cont(null_best, 0.95) AS edge FROM b) SELECT round(edge, 6) AS threshold, count(*) FILTER (best >= edge) AS anchored, count(*) AS labels FROM b, q GROUP BY 1",
    "corrected_groups": """WITH r AS (SELECT DISTINCT req_id, atom_norm, req_group FROM requirements WHERE trim(req_group) <> '' AND atom_norm IS NOT NULL), w AS (SELECT DISTINCT atom_norm, req_group FROM requirements WHERE route = 'damaged' AND trim(req_group) <> '')
SELECT CASE WHEN w.req_group IS NULL THEN r.req_group ELSE 'noise' END AS req_group, count(*) AS rows FROM r LEFT JOIN w ON r.atom_norm = w.atom_norm AND r.req_group = w.req_group GROUP BY 1""",
    "topped_up_sample": """WITH p AS (SELECT posting_row, coalesce(geo_country, '') AS country FROM postings), q AS (SELECT posting_row FROM p QUALIFY row_number() OVER (PARTITION BY country ORDER BY sha256('quota|' || posting_row), posting_row) <= 3),
t AS (SELECT posting_row FROM p WHERE posting_row NOT IN (SELECT posting_row FROM q) QUALIFY row_number() OVER (ORDER BY sha256('top-up|' || posting_row), posting_row) <= greatest(0, 100 - (SELECT count(*) FROM q)))
SELECT posting_row, 'quota' AS drawn FROM q UNION ALL SELECT posting_row, 'top_up' FROM t""",
    "requirement_pairs": """WITH r AS (SELECT DISTINCT coalesce(head_group, '') AS head_group, CASE WHEN match_cosine >= 0.9 THEN 'merged' ELSE 'apart' END AS decision, atom_norm, match_via FROM requirements WHERE match_cosine >= 0.85 AND trim(match_via) <> '' AND atom_norm IS NOT NULL)
SELECT head_group, decision, atom_norm, match_via FROM r QUALIFY row_number() OVER (PARTITION BY head_group, decision ORDER BY sha256('pairs|' || atom_norm || '|' || match_via), atom_norm, match_via) <= 15""",
    "split_accuracy": f"WITH a AS ({_ACC}) SELECT coalesce(part, 'all') AS part, count(*) AS n, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a GROUP BY ROLLUP (part)",
    "routing_score": f"WITH {_ROUTE} SELECT tp, fp, fn, tn, missed, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM sc",
    "gate_table": f"""WITH a AS ({_ACC}), {_ROUTE}, m AS (SELECT 'accuracy_all' AS metric, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS value, 0.6::DOUBLE AS floor FROM a UNION ALL SELECT 'accuracy_stands', round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6), 0.4 FROM a WHERE part = 'stands'
UNION ALL SELECT 'routing_precision', round(tp / nullif(tp + fp, 0), 6), 0.5 FROM sc UNION ALL SELECT 'routing_recall', round(tp / nullif(tp + fn, 0), 6), 0.05 FROM sc) SELECT metric, value, floor, coalesce(value >= floor, FALSE) AS passed FROM m""",
    "path_parity": f"""WITH r AS (SELECT DISTINCT posting_id, job, item_idx, item_split, atom_idx, atom FROM requirements WHERE trim(posting_id) <> '' AND atom IS NOT NULL),
p AS (SELECT item_split, array_to_string(list(atom ORDER BY atom_idx, atom), '') AS joined FROM r GROUP BY posting_id, job, item_idx, item_split) SELECT count(*) AS items, count(*) FILTER ({_K.format('joined')} = {_K.format('item_split')}) AS alike FROM p""",
    "split_half_floor": f"""WITH {FACTS_SQL}, s AS (SELECT DISTINCT industry AS fn, CASE WHEN substr(sha256('halves|' || posting), 1, 1) IN ({_list('01234567')}) THEN 'a' ELSE 'b' END AS cell, cluster AS k, posting AS u FROM facts),
h AS (SELECT fn, cell, k, count(*) AS hits FROM s GROUP BY 1, 2, 3), t AS (SELECT fn, cell, count(DISTINCT u) AS total FROM s GROUP BY 1, 2), sh AS (SELECT h.fn, h.cell, k, hits, total, hits / total AS share FROM h JOIN t ON h.fn = t.fn AND h.cell = t.cell), {_DIST}
SELECT fn AS industry, round(avg(js), 6) AS js FROM d GROUP BY 1""",
}
