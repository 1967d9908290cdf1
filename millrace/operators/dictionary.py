"""The frozen dictionary: building, comparing and looking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_MIN, TOPIC_MIN = 0.90, 0.80


def freeze(facts: DataFrame, space: str, core: str, group: str, topic: str) -> DataFrame:
    """One row per (space, core): occurrences, group and topic; reading it fails if a core has more than one group."""
    out = facts.groupBy(F.col(space).alias("req_space"), F.col(core).alias("req_core")).agg(
        F.count(F.lit(1)).alias("n"), F.min(group).alias("req_group"), F.min(topic).alias("req_topic"), F.count_distinct(group).alias("groups"),
    )
    ok = F.assert_true(F.col("groups") <= 1, F.concat(F.lit("more than one group: "), F.col("req_core")))
    return out.withColumn("ok", ok).filter("ok IS NULL").select("req_space", "req_core", "n", "req_group", "req_topic")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The fate of every old group: same, renamed, split or gone, with its mass and where most of it went."""
    moved = old.select("req_space", "req_core", F.col("req_group").alias("old_group"), F.col("n").alias("mass")).join(new.select("req_space", "req_core", F.col("req_group").alias("new_group")), ["req_space", "req_core"], "left")
    parts = moved.groupBy("old_group", "new_group").agg(F.sum("mass").alias("mass"))
    out = parts.groupBy("old_group").agg(F.count("new_group").alias("targets"), F.sum("mass").alias("mass"), F.min(F.when(F.col("new_group").isNotNull(), F.struct((-F.col("mass")).alias("m"), F.col("new_group").alias("g")))).alias("t"))
    fate = F.when(F.col("targets") == 0, "gone").when(F.col("targets") > 1, "split").when(F.col("t.g") == F.col("old_group"), "same").otherwise("renamed")
    return out.select("old_group", fate.alias("fate"), "mass", F.col("t.g").alias("main_target"))


def merged_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """New groups fed by more than one old group."""
    both = old.select("req_space", "req_core", F.col("req_group").alias("old_group")).join(new.select("req_space", "req_core", F.col("req_group").alias("new_group")), ["req_space", "req_core"])
    return both.groupBy("new_group").agg(F.count_distinct("old_group").alias("sources")).filter("sources > 1")


def canon(core: Column) -> Column:
    """A folded spelling: lower case, one apostrophe, no hyphens, British to American endings, no plural s."""
    c = F.regexp_replace(F.lower(F.trim(core)), "[’`´]", "'")
    c = F.regexp_replace(F.regexp_replace(c, r"[-_/]+", " "), r"\s+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"isation\b", "ization"), r"ise\b", "ize")
    return F.regexp_replace(c, r"([a-z]{3,}[^s'])s\b", "$1")


def lookup(values: DataFrame, space: str, core: str, entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """values with match, group, topic and via: exact, then alias, then folded spelling if all its entries share one group.

    Blank cores give 'empty', the rest 'nuovo' (similarity search is a step of its own, see vectors.best_two). Each stage
    is one left join; Spark broadcasts the dictionary where its size allows it.
    """
    v = values.withColumn("__canon", canon(F.col(core)))
    exact = entries.select(F.col("req_space").alias(space), F.col("req_core").alias(core), F.col("req_group").alias("eg"), F.col("req_topic").alias("et")).dropDuplicates([space, core])
    folded = entries.groupBy(F.col("req_space").alias(space), canon(F.col("req_core")).alias("__canon")).agg(F.min("req_group").alias("cg"), F.min("req_topic").alias("ct"), F.count_distinct("req_group").alias("groups"), F.min("req_core").alias("cc")).filter("groups = 1").drop("groups")
    out = v.join(exact, [space, core], "left").join(folded, [space, "__canon"], "left")
    if aliases is None:
        out = out.withColumn("ag", F.lit(None).cast("string"))
    else:
        out = out.join(aliases.select(F.col("space").alias(space), F.col("variant").alias(core), F.col("target_group").alias("ag")), [space, core], "left")
    blank = F.trim(F.coalesce(F.col(core), F.lit(""))) == ""
    via = F.when(blank, "none").when(F.col("eg").isNotNull(), "exact").when(F.col("ag").isNotNull(), "alias").when(F.col("cg").isNotNull(), "canon").otherwise("none")
    match = F.when(blank, "empty").when(via != "none", "known").otherwise("nuovo")
    return out.withColumn("match", match).withColumn("via", via).withColumn("group", F.when(~blank, F.coalesce("eg", "ag", "cg"))).withColumn("topic", F.when(~blank, F.coalesce("et", "ct"))).drop("__canon", "eg", "et", "cg", "ct", "cc", "ag")


def nearest_status(cosine: Column) -> Column:
    """What a similarity is worth: the group, the topic only, or nothing."""
    return F.when(cosine >= GROUP_MIN, "group").when(cosine >= TOPIC_MIN, "topic").otherwise("nuovo")


def casing_map(texts: DataFrame, text: str, least: int = 5, share: float = 0.90) -> DataFrame:
    """(lower, cased, n): how a word is written, from words that are not the first of their text.

    Kept where the commonest form has at least `least` occurrences and `share` of all and is not the lower-case one.
    """
    words = texts.select(F.explode(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}+#.]*\p{L}[\p{L}\p{N}+#.]*"), F.lit(0)), 2, 1 << 20)).alias("w")).filter("length(w) >= 2")
    forms = words.groupBy(F.lower("w").alias("lower"), F.col("w").alias("cased")).agg(F.count(F.lit(1)).alias("n"))
    best = forms.groupBy("lower").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), F.col("cased").alias("c"))).alias("b"))
    out = best.select("lower", F.col("b.c").alias("cased"), (-F.col("b.m")).alias("n"), "total")
    return out.filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= share) & (F.col("cased") != F.col("lower"))).select("lower", "cased", "n")


def acronyms(titles: DataFrame, title: str) -> DataFrame:
    """(acronym, expansion, n): 'Words In Full (WIF)' where the initials fit, if each acronym has one expansion and n >= 2."""
    acro = F.regexp_extract(F.col(title), r"\(([A-Z]{2,6})\)", 1)
    before = F.regexp_extract(F.col(title), r"^(.*?)\s*\([A-Z]{2,6}\)", 1)
    words = F.filter(F.split(F.regexp_replace(before, r"[^\p{L} ]", " "), r"\s+"), lambda w: w != "")
    rows = titles.select(acro.alias("acronym"), words.alias("w")).filter("acronym <> '' AND size(w) >= length(acronym)")
    rows = rows.withColumn("tail", F.expr("slice(w, size(w) - length(acronym) + 1, length(acronym))"))
    fits = F.upper(F.array_join(F.transform("tail", lambda x: F.substring(x, 1, 1)), "")) == F.col("acronym")
    found = rows.filter(fits).groupBy("acronym", F.lower(F.array_join("tail", " ")).alias("expansion")).agg(F.count(F.lit(1)).alias("n"))
    one = found.groupBy("acronym").agg(F.count(F.lit(1)).alias("k"), F.min("expansion").alias("expansion"), F.sum("n").alias("n"))
    return one.filter("k = 1 AND n >= 2").select("acronym", "expansion", "n")
