"""The explorer: adverts once, drop reasons, index, co-occurrence, verdicts per role, vocabulary growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.profiles import uniform

from millrace.session import cut


def advert_key(posting_id: Column, title: Column, items: Column) -> Column:
    """16 hex digits of the id, or of title and text where there is no id."""
    text = F.concat(F.lit("t:"), F.coalesce(title, F.lit("")), F.lit("\u0000"), F.coalesce(F.array_join(items, "\u0000"), F.lit("")))
    return F.substring(F.sha2(F.when(F.trim(F.coalesce(posting_id, F.lit(""))) != "", F.concat(F.lit("i:"), posting_id)).otherwise(text), 256), 1, 16)


def cache_key(code: Column, text: Column) -> Column:
    """32 hex digits of language code and text."""
    return F.substring(F.sha2(F.concat(code, F.lit("\u0000"), text), 256), 1, 32)


def unique_adverts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key in the given order, by one aggregation."""
    rest = [c for c in df.columns if c != key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}") for c in rest])


def drop_reason(counted: Column, route: Column, topic: Column, core: Column, head: Column) -> Column:
    """Why a requirement is left out, first reason wins; NULL keeps it."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~F.coalesce(counted, F.lit(True)), "not_counted").when(route == "damaged", "damaged").when(blank(topic), "no_topic").when((head == "education") & blank(core), "degree_suspect").when(F.lower(core).isin("skills", "experience", "knowledge"), "generic")


def unit_of(topic: Column) -> Column:
    """A topic as explorer unit: no prefix, plain apostrophes, single blanks, lower case."""
    t = F.regexp_replace(F.regexp_replace(topic, r"^(?:topic-|[a-z]+:)", ""), "[’`´]", "'")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def slugs(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, slug): file-safe names; later ones of the same slug get -2, -3, ..."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.col(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    w = Window.partitionBy("s").orderBy(order)
    out = df.select(name, order, base.alias("s")).withColumn("r", F.row_number().over(w))
    return out.select(name, F.when(F.col("r") == 1, F.col("s")).otherwise(F.concat("s", F.lit("-"), F.col("r").cast("string"))).alias("slug"))


def requirement_index(rows: DataFrame, obj: str, advert: str, company: str, min_ads: int, min_companies: int) -> DataFrame:
    """Objects that enough adverts of enough companies ask for."""
    out = rows.groupBy(obj).agg(F.count_distinct(advert).alias("adverts"), F.count_distinct(company).alias("companies"))
    return out.filter((F.col("adverts") >= min_ads) & (F.col("companies") >= min_companies))


def breakdown(rows: DataFrame, obj: str, advert: str, facet: str, least: int = 1) -> DataFrame:
    """Distinct adverts per object and facet value, with the share of the object's adverts."""
    slim = rows.select(obj, advert, facet).filter(f"{facet} IS NOT NULL").distinct()
    out = slim.groupBy(obj, facet).agg(F.count(F.lit(1)).alias("adverts"))
    return out.withColumn("share", F.round(F.col("adverts") / F.sum("adverts").over(Window.partitionBy(obj)), 6)).filter(F.col("adverts") >= least)


def cooccurrence(rows: DataFrame, advert: str, obj: str, min_joint: int, top: int) -> DataFrame:
    """The `top` objects (a report's own length) that stand with each object more often than by chance.

    Objects under the minimum go first: they cannot reach the joint count, and the pairs of an advert shrink with them.
    """
    slim = rows.select(advert, obj).filter(f"{advert} IS NOT NULL AND {obj} IS NOT NULL").distinct()
    counts = slim.groupBy(obj).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_joint)
    total = slim.agg(F.count_distinct(advert).alias("t"))
    sets = slim.join(counts.select(obj), obj).groupBy(advert).agg(F.array_sort(F.collect_list(obj)).alias("o")).filter("size(o) > 1")
    pairs = sets.select("o", F.posexplode("o").alias("at", "a")).select("a", F.explode(F.slice("o", F.col("at") + 2, F.size("o"))).alias("b"))
    joint = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("joint")).filter(F.col("joint") >= min_joint)
    both = joint.unionByName(joint.selectExpr("b AS a", "a AS b", "joint"))
    out = both.join(counts.select(F.col(obj).alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col(obj).alias("b"), F.col("n").alias("nb")), "b").join(F.broadcast(total))  # one row of totals
    out = out.withColumn("lift", F.col("joint") * F.col("t") / (F.col("na") * F.col("nb")))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("lift", 9)), F.desc("joint"), "b")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(F.col("a").alias("obj"), F.col("b").alias("other"), "joint", "lift", "rank")


def loo_verdicts(rows: DataFrame, role: str, advert: str, obj: str) -> DataFrame:
    """Every requirement of every advert with the share of the role's other adverts that ask for it, and a verdict."""
    slim = rows.select(role, advert, obj).distinct()
    counts = slim.groupBy(role, obj).agg(F.count(F.lit(1)).alias("c"))
    sizes = slim.select(role, advert).distinct().groupBy(role).agg(F.count(F.lit(1)).alias("n"))
    out = slim.join(counts, [role, obj]).join(sizes, role)
    share = F.when(F.col("n") > 1, (F.col("c") - 1) / (F.col("n") - 1))
    return out.withColumn("share", share).withColumn("verdict", F.when(F.col("share") >= 0.30, "standard").when(F.col("share") >= 0.10, "common").otherwise("unusual")).drop("c", "n")


def expected_missing(rows: DataFrame, role: str, advert: str, obj: str, least: float = 0.35) -> DataFrame:
    """(advert, obj): what at least that share of a role's adverts ask for and this one does not."""
    slim = rows.select(role, advert, obj).distinct()
    sizes = slim.select(role, advert).distinct().groupBy(role).agg(F.count(F.lit(1)).alias("n"))
    usual = slim.groupBy(role, obj).agg(F.count(F.lit(1)).alias("c")).join(sizes, role).filter(F.col("c") / F.col("n") >= least).select(role, obj)
    wanted = slim.select(role, advert).distinct().join(usual, role)
    return wanted.join(slim, [role, advert, obj], "left_anti").select(advert, obj)


def vocabulary_growth(rows: DataFrame, advert: str, text: str, order: list[str], steps: int) -> DataFrame:
    """(step, adverts, vocabulary): distinct texts seen after each of `steps` equal shares of the adverts in order.

    The rank of an advert comes from counts per bucket of the first order column, so no single task sorts them all.
    """
    ads = rows.groupBy(advert).agg(*[F.min(c).alias(c) for c in order])
    total = ads.count()
    ranked = ads.repartitionByRange(*order, advert).sortWithinPartitions(*order, advert)
    part = cut(ranked.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33)))
    offsets = part.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    rank = part.join(offsets.select("part", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before")), "part").select(advert, (F.col("before") + F.col("at") + 1).alias("rank"))
    first = rows.select(advert, text).join(rank, advert).groupBy(text).agg(F.min("rank").alias("first"))
    step = F.ceil(F.col("first") * steps / F.lit(total)).cast("int")
    new = first.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("new"))
    grid = rows.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    upto = Window.partitionBy(F.lit(1)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    out = grid.join(new, "step", "left").withColumn("vocabulary", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    return out.select("step", F.floor(F.col("step") * F.lit(total) / steps).cast("bigint").alias("adverts"), "vocabulary")


def heaps_fit(curve: DataFrame, tail: float = 0.2) -> DataFrame:
    """(k, beta): V = k N^beta, fitted on ln V over ln N for N >= tail x the largest N."""
    most = curve.agg(F.max("adverts").alias("m"))
    x = curve.join(F.broadcast(most)).filter((F.col("adverts") >= tail * F.col("m")) & (F.col("vocabulary") > 0)).select(F.log("adverts").alias("x"), F.log("vocabulary").alias("y"))  # one row
    fit = x.agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("a"))
    return fit.select(F.exp("a").alias("k"), "beta")


def holdout_coverage(rows: DataFrame, advert: str, text: str, test: Column, steps: int) -> DataFrame:
    """(step, coverage): share of test occurrences whose text stands in the first share of the training adverts (by hash)."""
    u = uniform(F.lit("holdout"), advert)
    first = rows.filter(~test).groupBy(text).agg(F.min(u).alias("u"))
    seen = rows.filter(test).select(text).join(first, text, "left")
    shares = [F.round(F.avg((F.coalesce("u", F.lit(2.0)) < k / steps).cast("double")), 6).alias(f"s{k}") for k in range(1, steps + 1)]
    wide = seen.agg(*shares)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"s{k}").alias("coverage")) for k in range(1, steps + 1)])).alias("r")).select("r.*")
