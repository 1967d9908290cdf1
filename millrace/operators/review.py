"""Review of runs: lookups of held-out postings, candidates, samples of pairs, routing, parity, null models."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.sampling import rank_key
from millrace.operators.vectors import SMALL_SIDE, TILE, unit


def in_months(df: DataFrame, at: str, months: list[str]) -> DataFrame:
    """The rows of the given months (yyyy-MM)."""
    return df.filter(F.date_format(at, "yyyy-MM").isin(*months))


def held_out_lookup(rows: DataFrame, posting: str, core: str, group: str, share: float, seed: str) -> DataFrame:
    """(status, same, n): cores of held-out postings looked up among those of the others; same = whether the group agrees.

    A core of the dictionary stands for the group that most of its rows have (ties: the first by name).
    """
    held = F.conv(F.substring(rank_key(seed, posting), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32))
    marked = rows.select(posting, core, group).withColumn("held", held)
    counts = marked.filter("NOT held").groupBy(core, group).agg(F.count(F.lit(1)).alias("n"))
    known = counts.groupBy(core).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(group).alias("g"))).alias("x")).select(core, F.col("x.g").alias("expected"))
    found = marked.filter("held").join(known, core, "left")
    status = F.when(F.col("expected").isNull(), "new").otherwise("known")
    return found.groupBy(status.alias("status"), (F.col("expected") == F.col(group)).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def label_candidates(rows: DataFrame, group: str, text: str, labels: DataFrame, label: str, order: str, key) -> DataFrame:
    """(group, label): labels whose key is the key of one of the group's texts; of labels with one key the first by `order`."""
    first = labels.select(F.col(label).alias("label"), F.struct(order, F.col(label).alias("l_")).alias("o"), key(F.col(label)).alias("key")).groupBy("key").agg(F.min_by("label", "o").alias("label"))
    return rows.select(group, key(F.col(text)).alias("key")).filter("key <> ''").distinct().join(first, "key").select(group, "label").distinct()


def nearest_per_entry(df: DataFrame, key: str, vector: str, entries: DataFrame, entry: str, entry_vector: str, k: int, own: bool = False) -> DataFrame:
    """(entry, key, cosine, rank): the k rows of df nearest to each entry; ties go to the smaller key; with `own` the entries
    are the rows themselves, and a row is not its own neighbour.

    Entries go out in blocks of SMALL_SIDE bytes; every batch keeps its k best per entry, so only those are ranked.
    """
    size = entries.agg(F.sum(F.size(entry_vector).cast("bigint") * 8)).first()[0] or 0
    blocks = max(1, -(-size // SMALL_SIDE))
    rows = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v")).filter("v IS NOT NULL")
    kinds = f"entry {entries.schema[entry].dataType.simpleString()}, key {df.schema[key].dataType.simpleString()}, cosine DOUBLE"
    out = None
    for b in range(blocks):
        part = entries.filter(F.pmod(F.xxhash64(entry), F.lit(blocks)) == b).select(entry, unit(F.col(entry_vector)).alias("v")).filter("v IS NOT NULL").orderBy(entry).collect()
        sent = df.sparkSession.sparkContext.broadcast(([r[0] for r in part], np.array([r[1] for r in part], dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, matrix = sent.value
            for pdf in batches:
                pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
                if not len(pdf) or not names:
                    continue
                m, keys = np.stack(pdf["v"].to_numpy()), pdf["key"].to_numpy()
                step = max(1, TILE // (8 * len(pdf)))
                for at in range(0, len(names), step):
                    c = np.round(matrix[at : at + step] @ m.T, 9)
                    if own:
                        c[np.array(names[at : at + step])[:, None] == keys[None, :]] = -np.inf
                    top = np.argsort(-c, axis=1, kind="stable")[:, :k]
                    n = top.shape[1]
                    got = pd.DataFrame({"entry": np.repeat(np.array(names[at : at + step], dtype=object), n), "key": keys[top.reshape(-1)], "cosine": np.take_along_axis(c, top, 1).reshape(-1)})
                    yield got[np.isfinite(got["cosine"])]

        found = rows.mapInPandas(best, kinds)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("entry").orderBy(F.desc("cosine"), "key")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shuffled_vectors(entries: DataFrame, entry: str, vector: str, seed: str) -> DataFrame:
    """The entries with the places of their vector in an order drawn by a digest of seed, entry and place: a null model."""
    schema = f"{entry} {entries.schema[entry].dataType.simpleString()}, {vector} ARRAY<DOUBLE>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, v in zip(pdf[entry], pdf[vector], strict=True):
                order = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"{seed}|{name}|{i}".encode()).hexdigest())
                out.append([float(v[i]) for i in order])
            yield pd.DataFrame({entry: pdf[entry], vector: out})

    return entries.select(entry, F.col(vector).cast("array<double>").alias(vector)).mapInPandas(run, schema)


def pairs_per_cell(rows: DataFrame, cell: list[str], pair: list[str], n: int, seed: str) -> DataFrame:
    """Up to n pairs of every cell, in the order of their digests."""
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("r_", *pair))
    return rows.select(*cell, *pair).distinct().withColumn("r_", rank_key(seed, *pair)).withColumn("place", place).filter(F.col("place") <= n).drop("r_")


def topped_up(sample: DataFrame, pool: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The sample with as many further rows of the pool, first by digest, as are missing to n."""
    missing = max(0, n - sample.count())
    more = pool.join(sample.select(key), key, "left_anti").withColumn("r_", rank_key(seed, key)).orderBy("r_", key).limit(missing).drop("r_")
    return sample.withColumn("drawn", F.lit("quota")).unionByName(more.withColumn("drawn", F.lit("top_up")))


def routing_score(rows: DataFrame, sent: Column, needed: Column, mass: Column) -> DataFrame:
    """How well routing finds what needs it: tp, fp, fn, tn, precision, recall and the missed mass."""
    s, d = sent.cast("int"), needed.cast("int")
    sums = rows.select(s.alias("s"), d.alias("d"), mass.alias("m")).agg(F.sum(F.col("s") * F.col("d")).alias("tp"), F.sum(F.col("s") * (1 - F.col("d"))).alias("fp"), F.sum((1 - F.col("s")) * F.col("d")).alias("fn"), F.sum((1 - F.col("s")) * (1 - F.col("d"))).alias("tn"), F.sum((1 - F.col("s")) * F.col("d") * F.col("m")).alias("missed"))
    return sums.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6)).withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6))


def gate(scores: DataFrame, metric: str, value: str, floors: dict[str, float]) -> DataFrame:
    """(metric, value, floor, passed) for every metric that has a floor; a missing value does not pass."""
    table = F.create_map(*[F.lit(x) for m, f in floors.items() for x in (m, f)])
    return scores.filter(F.col(metric).isin(*floors)).select(metric, value, table[F.col(metric)].alias("floor")).withColumn("passed", F.coalesce(F.col(value) >= F.col("floor"), F.lit(False)))
