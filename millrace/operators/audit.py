"""Audit tables: coverage, profiles, concentration, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.base import blank_to_null


def dataset_summary(df: DataFrame, by: str, distinct: list[str], flag: Column, when: str) -> DataFrame:
    """Rows, distinct non-blank values, mean of a flag in percent, first and last time per group."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(blank_to_null(F.col(c).cast("string"))).alias(f"distinct_{c}") for c in distinct],
        F.round(F.avg(flag.cast("double")) * 100, 6).alias("flag_pct"), F.min(when).alias("first_at"), F.max(when).alias("last_at"),
    )


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, coverage_pct, distinct_values) of every column in one pass."""
    given = {c: blank_to_null(F.col(c).cast("string")) for c in columns}
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(v).alias(f"f_{c}") for c, v in given.items()], *[F.count_distinct(v).alias(f"d_{c}") for c, v in given.items()])
    parts = [F.struct(F.lit(c).alias("field"), F.col(f"f_{c}").alias("filled"), F.round(100 * F.col(f"f_{c}") / F.col("n"), 6).alias("coverage_pct"), F.col(f"d_{c}").alias("distinct_values")) for c in columns]
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def value_profile(df: DataFrame, columns: list[str], by: str, groups: list[str]) -> DataFrame:
    """(field, value, share per group): the share of each value within its field and group; absent values have share 0."""
    long = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select(by, "s.*").filter("value IS NOT NULL")
    counts = long.groupBy("field", "value").agg(*[F.count_if(F.col(by) == g).alias(f"n_{g}") for g in groups])
    w = Window.partitionBy("field")
    shares = [F.round(F.col(f"n_{g}") / F.sum(f"n_{g}").over(w), 6).alias(f"share_{g}") for g in groups]
    return counts.select("field", "value", *shares)


def employer_concentration(df: DataFrame, cell: list[str], employer: str, flag_at: float) -> DataFrame:
    """The largest employer of each cell with its share in percent; ties go to the smaller employer."""
    counts = df.filter(F.col(employer).isNotNull()).groupBy(*cell, employer).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(*cell).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("m"), F.col(employer).alias("e"))).alias("top"))
    share = F.round(100.0 * -F.col("top.m") / F.col("rows"), 1)
    return out.select(*cell, "rows", F.col("top.e").alias("top_employer"), (-F.col("top.m")).alias("top_rows"), share.alias("top_share")).withColumn("flagged", F.col("top_share") >= flag_at * 100)


def separation(df: DataFrame, by: str, value: str) -> DataFrame:
    """(group_a, group_b, common): values that two groups share, for every pair of groups."""
    sets = df.select(by, value).filter(f"{by} IS NOT NULL AND {value} IS NOT NULL").distinct()
    groups = sets.groupBy(value).agg(F.array_sort(F.collect_set(by)).alias("g"))  # at most as many entries as groups
    pairs = groups.select(F.explode("g").alias("group_a"), "g").select("group_a", F.explode("g").alias("group_b")).filter("group_a < group_b")
    return pairs.groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("common"))


def type_distribution(df: DataFrame, kind: str, text: str) -> DataFrame:
    """Occurrences and distinct texts per kind with their shares."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(text).alias("distinct_texts"))
    w = Window.partitionBy(F.lit(1))  # a few rows, one per kind
    return counts.select(kind, "occurrences", "distinct_texts", F.round(100 * F.col("occurrences") / F.sum("occurrences").over(w), 6).alias("share_pct"))


def crosstab_share(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Share of each row value within every column value."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])
    w = Window.partitionBy(F.lit(1))  # one row per row value
    return counts.select(row, *[F.round(F.col(f"n_{v}") / F.sum(f"n_{v}").over(w), 6).alias(f"share_{v}") for v in values])


def top_values(df: DataFrame, value: str, n: int, *extra: Column) -> DataFrame:
    """The n commonest values; ties go to the smaller value."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), *extra).orderBy(F.desc("n"), value).limit(n)


def hit_rate(df: DataFrame, by: str, text: str, pattern: str) -> DataFrame:
    """Share of rows whose text matches a pattern, and the number of distinct matches, per group."""
    found = F.regexp_extract(F.col(text), pattern, 0)
    hit = F.col(text).isNotNull() & (found != "")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"), F.count_distinct(F.when(hit, found)).alias("distinct_hits"))


def with_sensitivity(df: DataFrame, estimate, clean: Column, key: list[str], value: str) -> DataFrame:
    """An estimate over all rows and over clean rows only, with the difference."""
    every = estimate(df).select(*key, F.col(value).alias("all_rows"))
    only = estimate(df.filter(clean)).select(*key, F.col(value).alias("clean_rows"))
    return every.join(only, key, "left").withColumn("difference", F.round(F.col("clean_rows") - F.col("all_rows"), 6))
