"""The analysis base: repeats, exclusion chain, flags, cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: str | Column) -> Column:
    """A text column with '' and blanks as NULL, as distinct counts need it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def mark_repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Add repeat_group_size, repeat_weight = 1 / size and is_repeat_first (earliest by `order`); NULL keys form groups.

    `order` must end in a unique column, so that one row is the first.
    """
    # Size and first row come from one aggregation with map-side combine and go back by a join, so that a key with a third
    # of all rows is never sorted in one task.
    stats = df.groupBy(*key).agg(F.count(F.lit(1)).alias("repeat_group_size"), F.min(F.struct(*order)).alias("__first"))
    named = stats.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "repeat_group_size", "__first")
    same = reduce(lambda x, y: x & y, [df[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(key)])
    out = df.join(named, same).withColumn("repeat_weight", F.lit(1.0) / F.col("repeat_group_size"))
    return out.withColumn("is_repeat_first", F.struct(*order).eqNullSafe(F.col("__first"))).drop("__first", *[f"__k{i}" for i in range(len(key))])


def collapse_repeats(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest row of each key: one aggregation with map-side combine instead of a window over whole groups."""
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"b.{c}") for c in rest]).select(*df.columns)


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, removed, remaining): rows that each exclusion removes from what the earlier ones left, in one pass."""
    gone = F.lit(False)
    sums = [F.count(F.lit(1)).alias("all")]
    for i, (_, hit) in enumerate(steps):
        hit = F.coalesce(hit, F.lit(False))
        sums.append(F.count_if(hit & ~gone).alias(f"r{i}"))
        gone = gone | hit
    counts = df.agg(*sums)
    rows, left = [], F.col("all")
    for i, (name, _) in enumerate(steps):
        left = left - F.col(f"r{i}")
        rows.append(F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"), F.col(f"r{i}").alias("removed"), left.alias("remaining")))
    return counts.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def repeat_diagnostic(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(column, groups, varying, identical_pct): in how many repeat groups each content column varies."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in content]).filter("n > 1")
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"d_{c}") > 1).alias("v")) for c in content]))
    out = per.select(stack.alias("s")).groupBy("s.column").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("s.v")).alias("varying"))
    return out.withColumn("identical_pct", F.round(100 * (1 - F.col("varying") / F.col("groups")), 4))


def compare_repeat_rules(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(rule, removed): rows that each candidate key would remove."""
    counts = [(F.count(F.lit(1)) - F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key]))).alias(r) for r, key in rules.items()]
    wide = df.agg(*counts)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("removed")) for r in rules])).alias("s")).select("s.*")


def first_match(text: Column, bank: list[tuple[str, str]]) -> Column:
    """The name of the first pattern (in order) that the text contains, or NULL."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(bank):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def role_flags(df: DataFrame, title: str, shop_floor: list[tuple[str, str]], b2b: list[tuple[str, str]]) -> DataFrame:
    """Add shop_floor, b2b, shop_kind and role_family; the shop floor wins where both match."""
    text = F.lower(F.coalesce(F.col(title), F.lit("")))
    out = df.withColumn("shop_kind", first_match(text, shop_floor)).withColumn("b2b_kind", first_match(text, b2b))
    out = out.withColumn("shop_floor", F.col("shop_kind").isNotNull()).withColumn("b2b", F.col("b2b_kind").isNotNull())
    return out.withColumn("role_family", F.when(F.col("shop_floor"), "shop_floor").when(F.col("b2b"), "b2b").otherwise("unclassified"))


def cell_counts(df: DataFrame, cells: DataFrame, cell: str, fn: str, functions: list[str], least: int) -> DataFrame:
    """Rows per cell and function, zero cells included, with a verdict per function and for the pair."""
    wide = df.groupBy(cell).pivot(fn, functions).count()
    out = cells.join(wide, cell, "left").na.fill(0, functions)
    for f in functions:
        out = out.withColumn(f"{f}_ok", F.col(f) >= least)
    both = F.lit(True)
    for f in functions:
        both = both & F.col(f"{f}_ok")
    return out.withColumn("paired", both)


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bands: labels[i] holds values in (edges[i-1], edges[i]]; the last label everything above."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= edge, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)
