"""The pipeline: postings in, structured requirements out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.requirements import decompose_udf, split_udf
from millrace.session import cut, spread


def process(postings: DataFrame, key: str = "posting_row", items: str = "must_have", translator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per atom with its fields.

    Items are cleaned, translated by `translator` (a function from distinct (language, item) rows to the same rows with a
    column `english`; none leaves them as they are), split and decomposed. Every text function runs once per distinct text
    and the result is joined back, so repeated items cost one call.
    """
    rows = postings.select(F.col(key).alias("posting"), F.posexplode(items).alias("item_idx", "raw")).filter("trim(raw) <> ''").withColumn("item", T.clean(F.col("raw")))
    texts = spread(rows.select("item").distinct()).withColumn("language", T.detect_language(F.col("item")))
    if translator is not None:
        texts = texts.join(translator(texts.filter("language <> 'en'")).select("item", "english"), "item", "left").withColumn("text", F.coalesce("english", "item")).withColumn("translated", F.col("english").isNotNull())
    else:
        texts = texts.withColumn("text", F.col("item")).withColumn("translated", F.lit(False))
    texts = cut(texts)  # read twice below; the text functions must not run twice
    split = texts.select("text").distinct().withColumn("s", split_udf(F.col("text"))).select(F.col("text").alias("t"), "s.atoms", "s.route")
    atoms = split.select("t", "route", F.posexplode("atoms").alias("atom_idx", "atom"), F.transform("atoms", lambda a: T.nice_to_have(a)).alias("o"))
    atoms = cut(atoms.withColumn("optional", F.element_at("o", F.col("atom_idx") + 1)).withColumn("counts", F.element_at(T.counted(F.col("o")), F.col("atom_idx") + 1)).drop("o"))
    parts = atoms.select("atom").distinct().withColumn("d", decompose_udf(F.col("atom"))).select(F.col("atom").alias("a"), "d.*")
    full = atoms.join(parts, atoms["atom"] == parts["a"]).drop("a")
    named = rows.join(texts, "item").join(full, F.col("text") == F.col("t")).drop("t", "english")
    return named.select("posting", "item_idx", "item", "language", "translated", "route", "atom_idx", "atom", "optional", "counts", "years_min", "years_max", "level", "head_group", "degree", "core", "extra", "space", "key")


def inherit_years(rows: DataFrame) -> DataFrame:
    """The only years value of an item goes to its other parts, degrees and languages excepted."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("posting", "item_idx")
    only = F.when(F.min("years_min").over(w) == F.max("years_min").over(w), F.min("years_min").over(w))
    return rows.withColumn("years_min", F.coalesce("years_min", F.when(~F.col("space").isin("education", "language"), only)))


def first_per_key(rows: DataFrame) -> DataFrame:
    """Add first: the first atom of each key inside an item; atoms without a key always count."""
    from pyspark.sql.window import Window

    r = F.row_number().over(Window.partitionBy("posting", "item_idx", "key").orderBy("atom_idx"))
    return rows.withColumn("first", (r == 1) | (F.col("key") == ""))


def residue(rows: DataFrame) -> DataFrame:
    """The distinct items that look compound and were left whole, for a pluggable splitter."""
    return rows.filter("route = 'llm'").select("item").distinct()


def through_cache(pairs: DataFrame, cache: DataFrame | None, call: Callable[[DataFrame], DataFrame], key: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(all answers, new answers to append): only pairs that the cache lacks are asked."""
    if cache is None:
        fresh = call(pairs.select(*key).distinct())
        return fresh, fresh
    fresh = call(pairs.select(*key).distinct().join(cache.select(*key), key, "left_anti"))
    return cache.select(*key, value).unionByName(fresh.select(*key, value)), fresh


def input_cause(item: Column, translated: Column) -> Column:
    """The first input trouble of an item: lower case, translated or long."""
    letters = F.regexp_replace(item, r"[^\p{L}]", "")
    return F.when((F.length(letters) > 0) & (letters == F.lower(letters)), "lowercase").when(translated, "translation").when(F.length(item) > 120, "long_item")
