"""Reading and mending groups: junk drawers, merge evidence, near keys, split detectors, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def modal_value(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value per group (ties: the smaller) with its share."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(by, "rows", F.col("b.v").alias("modal"), F.round(-F.col("b.m") / F.col("rows"), 6).alias("modal_share"))


def junk_drawers(df: DataFrame, by: str, value: str, text: str, most_modal: float = 0.5, least_single: float = 0.35) -> DataFrame:
    """Groups without a main kind whose members are mostly single words."""
    single = df.groupBy(by).agg(F.round(F.avg((F.size(F.split(F.trim(text), r"\s+")) == 1).cast("double")), 6).alias("single_share"))
    return modal_value(df, by, value).join(single, by).withColumn("junk", (F.col("modal_share") < most_modal) & (F.col("single_share") >= least_single))


def one_token_apart(df: DataFrame, key: str) -> DataFrame:
    """Pairs of keys with equally many words that differ in exactly one.

    Every key is written once per word left out; equal rests with different words left out are the pairs, so keys meet by
    an equi-join and not by comparison of all with all.
    """
    words = df.select(key).distinct().withColumn("w", F.array_sort(F.array_distinct(F.split(key, " "))))
    cut = words.select(key, F.size("w").alias("n"), F.explode("w").alias("left_out"), "w").withColumn("rest", F.array_join(F.array_remove("w", F.col("left_out")), " ")).drop("w")
    other = cut.select(F.col(key).alias("other"), "n", F.col("left_out").alias("other_out"), "rest")
    pairs = cut.join(other, ["n", "rest"]).filter((F.col("left_out") != F.col("other_out")) & (F.col(key) < F.col("other")))
    return pairs.select(key, "other", "left_out", "other_out").distinct()


def vocabulary_overlap(df: DataFrame, group: str, text: str, least: float) -> DataFrame:
    """Pairs of groups whose member words overlap by Jaccard `least` or more.

    Exact prefix filter: with its words ordered from rare to common, a group of n words shares one of the first
    n - ceil(least n) + 1 with every group that overlaps enough; a word in many groups pairs only where it is that early.
    """
    words = df.select(group, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}+#]+")).alias("word")).filter("length(word) > 1").distinct()
    held = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(held, "word").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("s"))
    n = F.size("s")
    prefix = n - F.ceil(F.lit(least - 1e-6) * n).cast("int") + 1  # overlaps are compared rounded to 6 digits
    keyed = ranked.select(group, F.explode(F.slice("s", F.lit(1), F.least(n, prefix))).alias("x")).select(group, F.col("x.word").alias("word"))
    pairs = keyed.select(F.col(group).alias("a"), "word").join(keyed.select(F.col(group).alias("b"), "word"), "word").filter("a < b").select("a", "b").distinct()
    sets = words.groupBy(group).agg(F.collect_set("word").alias("s"))
    both = pairs.join(sets.select(F.col(group).alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col(group).alias("b"), F.col("s").alias("sb")), "b")
    j = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    return both.select("a", "b", F.round(j, 6).alias("jaccard")).filter(F.col("jaccard") >= least)


def split_flags(atom: Column, item: Column) -> Column:
    """The first split defect of an atom, or NULL: leading conjunction, open bracket, leaked introducer, whole long item."""
    balance = lambda c, o, e: F.length(F.regexp_replace(c, f"[^{o}]", "")) != F.length(F.regexp_replace(c, f"[^{e}]", ""))
    return (
        F.when(atom.rlike(r"(?i)^\s*(?:and|or|but|und|oder|et|ou|y|o|e)\s"), "leading_conjunction").when(balance(atom, r"\(", r"\)"), "open_bracket")
        .when(atom.rlike(r"(?i)\b(?:such as|e\.g\.|including)\s*$"), "leaked_introducer").when((atom == item) & (F.length(atom) > 60) & atom.contains(","), "whole_compound")
    )


def repeated_in_item(df: DataFrame, item: list[str], key: str) -> DataFrame:
    """Keys that stand more than once in one item."""
    return df.filter(F.trim(F.coalesce(key, F.lit(""))) != "").groupBy(*item, key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def shares_by(df: DataFrame, cluster: str, by: str, values: list[str], unit: str) -> DataFrame:
    """Share of the units of every value that ask for a cluster, and the highest over the lowest."""
    slim = df.select(cluster, by, unit).distinct()
    totals = slim.select(by, unit).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    hits = slim.groupBy(cluster, by).agg(F.count(F.lit(1)).alias("n")).join(totals, by).withColumn("share", F.col("n") / F.col("total"))
    wide = hits.groupBy(cluster).agg(*[F.round(F.coalesce(F.max(F.when(F.col(by) == v, F.col("share"))), F.lit(0.0)), 6).alias(f"share_{v}") for v in values])
    cols = [F.col(f"share_{v}") for v in values]
    return wide.withColumn("ratio", F.round(F.greatest(*cols) / F.nullif(F.least(*cols), F.lit(0.0)), 4))


def level_table(df: DataFrame, level: str, fn: str, functions: list[str], unit: str, company: str) -> DataFrame:
    """Adverts and companies per level and function, the unstated level last."""
    aggs = [a for f in functions for a in (F.count_distinct(F.when(F.col(fn) == f, F.col(unit))).alias(f"adverts_{f}"), F.count_distinct(F.when(F.col(fn) == f, F.col(company))).alias(f"companies_{f}"))]
    out = df.groupBy(F.coalesce(F.nullif(F.trim(level), F.lit("")), F.lit("(unstated)")).alias("level")).agg(*aggs, F.count_distinct(unit).alias("adverts"))
    order = Window.partitionBy(F.lit(1)).orderBy((F.col("level") == "(unstated)"), F.desc("adverts"), "level")  # one row per level
    return out.withColumn("place", F.row_number().over(order))


def catalogue_summary(catalogue: DataFrame, log: DataFrame, kind: str, at: list[str], value: str) -> DataFrame:
    """Every kind of a catalogue with its last log line, if any."""
    last = log.groupBy(kind).agg(F.max(F.struct(*at, value)).alias("l"), F.count(F.lit(1)).alias("lines"))
    return catalogue.join(last, kind, "left").select(kind, F.coalesce("lines", F.lit(0)).alias("lines"), F.col(f"l.{value}").alias("last_value"))


def probe(df: DataFrame, features: str, label: str, group: str, seed: int = 3, width: int = 1 << 12) -> DataFrame:
    """(fold, accuracy, baseline): logistic regression on hashed features, train and test split by group, with shuffled labels as control."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    rows = df.select(F.col(features).alias("f"), F.col(label).cast("string").alias("l"), F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(5)).alias("fold"), F.col(group).alias("g"))
    rows = HashingTF(inputCol="f", outputCol="features", numFeatures=width, binary=True).transform(rows)
    rows = StringIndexer(inputCol="l", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("features", "label", "fold", "g").cache()
    labels = rows.select("label").distinct().count()
    shuffled = rows.withColumn("label", F.pmod(F.xxhash64("g", "features", F.lit(seed)), F.lit(labels)).cast("double"))
    out = []
    for kind, data in (("labels", rows), ("shuffled", shuffled)):
        model = LogisticRegression(maxIter=10, regParam=0.1).fit(data.filter("fold > 0"))
        scored = model.transform(data.filter("fold = 0"))
        out.append(scored.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))
    return out[0].unionByName(out[1])
