"""Items that appear together: joint counts and lift by heavy-light decomposition.

A record holds a set of items. Items in at least heavy_share of all records are heavy; there are at most
(items per record) / heavy_share of them, whatever the input size, so their records fit a dense bit matrix per task.

* heavy x heavy: popcounts of ANDed bit rows, block by block of records
* heavy x light: the (short) record list of each light item probes the bit rows
* light x light: pairs are hashed and counted with map-side combine

The three parts are summed by one aggregation over pairs. A record is first reduced to its distinct items and, where the
caller states a minimum joint count, to items that reach it (an item in fewer records cannot be in a qualifying pair).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.joins import merged
from millrace.session import cut

#: Most heavy items (a task counts their pairs in heavy x heavy numbers; items beyond go with the light ones), and light
#: items of a record that are paired in one row (a longer list is paired piece by piece, in rows of their own).
MOST_HEAVY, LONG = 2048, 512
#: Records of one bit block; a task holds heavy_items x BLOCK / 8 bytes of bits.
BLOCK = 1 << 14


def distinct_incidence(df: DataFrame, record: str, item: str) -> DataFrame:
    """Distinct (record, item) pairs; NULL or blank records and items are left out, other values stay as written."""
    def given(c: str) -> Column:
        return F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "")

    pairs = df.filter(given(record) & given(item))
    return pairs.select(F.col(f"`{record}`").alias("record"), F.col(f"`{item}`").cast("string").alias("item")).distinct()


def _block_counts(batches: Iterator[pa.RecordBatch], heavy: int) -> Iterator[pa.RecordBatch]:
    """Counts of heavy pairs and of (heavy, light) pairs over one partition, block by block.

    Input rows: h ARRAY<INT> heavy positions, l ARRAY<STRING> light items of a record.
    """
    joint = np.zeros((heavy, heavy), dtype=np.int64)
    mixed: dict[str, np.ndarray] = {}

    def flush(rows: list, cols: list, light: dict[str, list[int]], n: int) -> None:
        if not n:
            return
        dense = np.zeros((heavy, n), dtype=np.uint8)
        if rows:
            dense[np.concatenate(rows), np.concatenate(cols)] = 1
        bits = np.packbits(dense, axis=1)
        pad = -bits.shape[1] % 8
        words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)
        for a in range(heavy):
            if words[a].any():
                joint[a, a:] += np.bitwise_count(words[a:] & words[a]).sum(axis=1, dtype=np.int64)
        for item, where in light.items():
            hit = dense[:, where].sum(axis=1, dtype=np.int64)
            if item in mixed:
                mixed[item] += hit
            else:
                mixed[item] = hit

    def emit() -> Iterator[pa.RecordBatch]:
        items = list(mixed)
        for at in range(0, len(items), 4096):
            part = items[at : at + 4096]
            counts = np.stack([mixed[i] for i in part])
            r, c = np.nonzero(counts)
            yield pa.record_batch([pa.array([-1] * len(r), pa.int32()), pa.array(c.astype(np.int32)), pa.array([part[i] for i in r], pa.string()), pa.array(counts[r, c])], names=["ha", "hb", "light", "joint"])
        mixed.clear()

    rows, cols, light, n = [], [], {}, 0
    for batch in batches:
        h, l = batch.column(0), batch.column(1)
        hv, ho = h.flatten().to_numpy(zero_copy_only=False), np.asarray(h.offsets)
        lv, lo = l.flatten().to_pylist(), np.asarray(l.offsets)
        at = 0
        while at < batch.num_rows:
            take = min(BLOCK - n, batch.num_rows - at)
            span = slice(ho[at] - ho[0], ho[at + take] - ho[0])
            rows.append(hv[span])
            cols.append(np.repeat(np.arange(n, n + take), np.diff(ho[at : at + take + 1])))
            for r in range(take):
                for k in range(lo[at + r] - lo[0], lo[at + r + 1] - lo[0]):
                    light.setdefault(lv[k], []).append(n + r)
            n += take
            at += take
            if n == BLOCK:
                flush(rows, cols, light, n)
                rows, cols, light, n = [], [], {}, 0
                if len(mixed) * heavy > 1 << 22:  # a bounded table; partial sums meet again in the aggregation
                    yield from emit()
    flush(rows, cols, light, n)
    yield from emit()
    r, c = np.nonzero(np.triu(joint, 1))
    yield pa.record_batch([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array([None] * len(r), pa.string()), pa.array(joint[r, c])], names=["ha", "hb", "light", "joint"])


def _long_pairs(records: DataFrame) -> DataFrame:
    """(item_a, item_b) of the sorted light lists of long records: pieces of LONG items meet each other by a join."""
    count = F.ceil(F.size("l") / LONG).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("l", i * LONG + 1, F.lit(LONG)))
    pieces = records.select("record", count.alias("k"), F.posexplode(cuts).alias("j", "b"))
    left = pieces.select("record", F.col("b").alias("a"), F.explode(F.sequence(F.col("j"), F.col("k") - 1)).alias("j"))
    both = merged(left, pieces.select("record", "j", "b"), ["record", "j"])
    return both.select("b", F.explode("a").alias("item_a")).select("item_a", F.explode("b").alias("item_b")).filter("item_a < item_b")


def pair_counts(df: DataFrame, record: str, item: str, min_joint: int = 1, min_share: float = 0.0, heavy_share: float = 0.01) -> DataFrame:
    """Every pair of items that share at least max(min_joint, min_share x records) records, with its lift.

    Result: item_a < item_b STRING, joint, n_a, n_b, records BIGINT, lift DOUBLE = joint x records / (n_a x n_b).
    NULL and blank records or items are left out and repeated rows count once; an empty input gives an empty result.
    Columns of df other than the two named ones play no part.
    """
    spark = df.sparkSession
    pairs = cut(distinct_incidence(df, record, item))
    by_item = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.count_distinct("record").alias("t")).first()["t"]
    least = max(1, min_joint, math.ceil(min_share * total - 1e-9))
    kept = by_item.filter(F.col("n") >= least)
    # The number of heavy items is bounded by heavy_share, not by the input, so they may go to the driver.
    heavy_rows = kept.filter(F.col("n") >= max(2.0, heavy_share * total)).orderBy(F.desc("n"), "item").limit(MOST_HEAVY).select("item").collect()
    heavy = sorted(r["item"] for r in heavy_rows)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(heavy)], "hpos INT, item STRING")
    # Items below the minimum go with a join on the item; Spark broadcasts the kept items only if their size allows it.
    rows = pairs.join(kept.select("item"), "item").join(F.broadcast(names), "item", "left")
    records = rows.groupBy("record").agg(
        F.array_sort(F.collect_list("hpos")).alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("hpos").isNull(), F.col("item")))).alias("l"),
    ).filter(F.size("h") + F.size("l") > 1)
    records = cut(records)

    counts = len(heavy)
    parts = records.select("h", "l").mapInArrow(lambda it: _block_counts(it, counts), "ha INT, hb INT, light STRING, joint BIGINT") if counts else None
    first = F.broadcast(names.selectExpr("hpos AS ha", "item AS item_a"))
    second = F.broadcast(names.selectExpr("hpos AS hb", "item AS item_b"))
    rare = (
        records.filter((F.size("l") > 1) & (F.size("l") <= LONG))
        .select("l", F.posexplode("l").alias("at", "item_a"))
        .select("item_a", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("item_b"))
        .unionByName(_long_pairs(records.filter(F.size("l") > LONG)))
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("joint"))
    )
    if parts is not None:
        dense = parts.join(second, "hb").join(first, "ha", "left")
        a, b = F.coalesce("item_a", "light"), F.col("item_b")
        dense = dense.select(F.least(a, b).alias("item_a"), F.greatest(a, b).alias("item_b"), "joint")
        rare = rare.unionByName(dense)
    joint = rare.groupBy("item_a", "item_b").agg(F.sum("joint").alias("joint")).filter(F.col("joint") >= least)
    out = joint.join(kept.selectExpr("item AS item_a", "n AS n_a"), "item_a").join(kept.selectExpr("item AS item_b", "n AS n_b"), "item_b")
    lift = F.col("joint").cast("double") * F.lit(total) / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "joint", "n_a", "n_b", F.lit(total).cast("bigint").alias("records"), lift.alias("lift"))
