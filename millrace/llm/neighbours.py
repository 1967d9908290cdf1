"""The k most similar vectors of every vector: a forest of hash-prefix trees.

Each tree gives every vector a long bit string (signs of random projections); sorted by it, the vectors that share a prefix
stand together, so a tree is a sorted array and a node is a run of it. A query descends to its longest match and ascends, by
the same number of bits in all trees, until the runs of all trees together hold `want` candidates and at least to the depth
that the trees were sized for: the number of trees follows from that depth, so that a pair of the stated similarity shares the
run of at least one tree with the stated probability. The same forest runs at every size, three levels deep at least.

The array of a tree is distributed in pieces by the first bits of the strings, as many as the ascent may still need; a piece
that is too full is cut at the sized depth, and a run that is too full into blocks of which every pair is scored (a cost
quadratic in the run, and no candidate dropped). Only 8-bit vectors travel with the trees: the residual of each is known, so
the true cosine lies between bounds, and no pair that could be among the k nearest is lost. What is left is scored exactly
with the vectors as given.

Vectors of equal direction are collapsed first; only the k + 1 smallest ids of such a group can be among anyone's k nearest.
The others are joined back as queries: the k nearest of each are the k smallest ids of its own direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.joins import merged
from millrace.session import cut, share_path, spread

BITS = 48
#: Rows of a run on average, at most; levels that a query may ascend above the sized depth; rows of a piece or block.
LEAF = 1024
CLIMB = 3
BLOCK = 8192


def usable(df: DataFrame, vec: str, embedding: str) -> DataFrame:
    """(id, unit FLOAT vector as bytes) of rows with a usable embedding; NULL, empty, all-zero or non-finite ones are out."""
    rows = df.select(F.col(f"`{vec}`").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.filter("id IS NOT NULL AND size(e) > 0").withColumn("n", F.sqrt(square))
    return rows.filter("n > 0 AND n < double('Infinity') AND NOT isnan(n)").select("id", "e", "n")


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, trees * BITS)).astype(np.float32)


def trees_needed(depth: int, cosine: float, recall: float) -> int:
    """Trees such that a pair of that cosine shares a prefix of that depth in one of them with that probability."""
    if depth <= 0:
        return 1
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _coded(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """(id, dim, codes, q, scale, off) of each vector: its strings, the 8-bit vector, its step and the length of its residual."""
    schema = rows.schema["id"].dataType.simpleString()
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim not in planes:
                    planes[dim] = _planes(dim, trees, seed)
                m = np.stack(part["e"].to_numpy()).astype(np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                codes = np.empty((len(m), trees), dtype=np.int64)
                for t in range(trees):
                    codes[:, t] = (m.astype(np.float32) @ planes[dim][:, t * BITS : (t + 1) * BITS] > 0).astype(np.int64) @ powers
                scale = np.abs(m).max(axis=1) / 127
                q = np.rint(m / scale[:, None]).astype(np.int8)
                off = np.linalg.norm(m - q * scale[:, None], axis=1) + 1e-6
                yield pd.DataFrame({"id": part["id"].to_numpy(), "dim": int(dim), "codes": list(codes), "q": [v.tobytes() for v in q], "scale": scale, "off": off})

    return rows.mapInPandas(run, f"id {schema}, dim INT, codes ARRAY<BIGINT>, q BINARY, scale FLOAT, off FLOAT")


def _run_pairs(pdf: pd.DataFrame, depth: int, k: int, least: float) -> pd.DataFrame:
    """Candidates (a, b) of one piece of a tree: each query against the run of its own length in the sorted array.

    Kept are those whose greatest possible cosine reaches `least` and the k-th best certain one of the query in this piece.
    """
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    pdf = pdf.sort_values("code", kind="stable")
    ids, code, up, own = (pdf[c].to_numpy() for c in ("id", "code", "up", "own"))
    m = np.frombuffer(b"".join(pdf["q"]), dtype=np.int8).reshape(len(pdf), -1).astype(np.float32) * pdf["scale"].to_numpy()[:, None]
    off = pdf["off"].to_numpy().astype(np.float32)
    out_a, out_b = [], []
    for climb in np.unique(up):
        shift = BITS - (depth - int(climb))
        heads = code >> shift
        starts = np.searchsorted(heads, heads, side="left")
        ends = np.searchsorted(heads, heads, side="right")
        asking = np.nonzero(up == climb)[0]
        for first in np.unique(starts[asking]):
            run = np.arange(first, ends[first])
            who = asking[(asking >= first) & (asking < ends[first])]
            for mine, theirs in {(lo, hi), (hi, lo)}:
                right = run if lo == hi else run[own[run] == theirs]
                left = who if lo == hi else who[own[who] == mine]
                for at in range(0, len(left), 1024):
                    rows = left[at : at + 1024]
                    c = m[rows] @ m[right].T
                    slack = off[rows][:, None] + off[right][None, :] + off[rows][:, None] * off[right][None, :]
                    c[rows[:, None] == right[None, :]] = -9.0
                    maybe = c + slack >= least
                    full = np.nonzero(maybe.sum(axis=1) > k)[0]
                    if len(full):
                        # More than k may reach `least`: those certainly behind k others are out.
                        floor = np.partition(c[full] - slack[full], len(right) - k, axis=1)[:, len(right) - k]
                        maybe[full] &= c[full] + slack[full] >= floor[:, None]
                    r, s = np.nonzero(maybe)
                    out_a.append(ids[rows[r]])
                    out_b.append(ids[right[s]])
    if not out_a:
        return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)}).drop_duplicates()


def nearest(df: DataFrame, vec: str = "vec_id", embedding: str = "embedding", k: int = 10, least: float = 0.9, recall: float = 0.9999, leaf: int = LEAF, want: int | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The k nearest others of every vector among those of cosine >= least; ties go to the smaller id.

    Result: a, b, cosine DOUBLE, rank INT (1 = nearest). `want` is the number of candidates that a query ascends for, 4 k by
    default. Vectors of every length are indexed; only those of equal length have a cosine. Vectors without a usable
    embedding have no neighbours. Repeated ids: the row with the smallest embedding counts.
    """
    share_path(df.sparkSession)
    spark = df.sparkSession
    want = 4 * k if want is None else want
    rows = usable(df, vec, embedding)
    rows = rows.groupBy("id").agg(F.min(F.struct("e", "n")).alias("x")).select("id", "x.e", "x.n")
    # Equal directions: one key per direction, rounded to 7 digits of the unit vector.
    unit = F.transform("e", lambda x: F.round(x / F.col("n"), 7) + F.lit(0.0))
    rows = rows.withColumn("dir", F.xxhash64(unit)).withColumn("dim", F.size("e"))
    place = F.row_number().over(Window.partitionBy("dir", "dim", "part").orderBy("id"))
    # Two-step cut to the k + 1 smallest ids of a direction: salted first, so that a hot direction is spread.
    rows = cut(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")))
    every = rows.select("id", "dir", "dim")
    kept = rows.withColumn("r", place).filter(F.col("r") <= k + 1)
    place = F.row_number().over(Window.partitionBy("dir", "dim").orderBy("id"))
    rows = cut(kept.withColumn("r", place).filter(F.col("r") <= k + 1).select("id", "e", "n", "dim", "dir", "r"))
    largest = rows.groupBy("dim").count().agg(F.max("count")).first()[0]
    schema = rows.schema["id"].dataType.simpleString()
    if largest is None:
        return spark.createDataFrame([], f"a {schema}, b {schema}, cosine DOUBLE, rank INT")
    depth = min(BITS, max(CLIMB, math.ceil(math.log2(largest / leaf))))
    trees = trees_needed(depth, least, recall)
    coded = cut(_coded(spread(rows.select("id", "e", "dim")), trees, seed))
    strings = coded.select("id", "dim", F.posexplode("codes").alias("tree", "code"))
    head = lambda bits: F.shiftright("code", BITS - bits)
    # The directory: rows of each run at the sized depth and of the runs above it.
    runs = cut(strings.groupBy("dim", "tree", head(depth).alias("node")).agg(F.count(F.lit(1)).alias("c0")))
    for up in range(1, CLIMB + 1):
        runs = runs.withColumn(f"c{up}", F.sum("c0").over(Window.partitionBy("dim", "tree", F.shiftright("node", up))))
    runs = cut(runs)
    # Ascent: the fewest bits given up, the same in all trees, for which the runs hold enough others.
    met = merged(strings.select("id", "dim", "tree", head(depth).alias("node")), runs, ["dim", "tree", "node"])
    total = met.groupBy("id").agg(*(F.sum(F.col(f"c{u}") - 1).alias(f"s{u}") for u in range(CLIMB + 1)))
    up = F.lit(CLIMB)
    for u in range(CLIMB - 1, -1, -1):
        up = F.when(F.col(f"s{u}") >= want, F.lit(u)).otherwise(up)
    total = total.select("id", up.alias("up"))
    # Of each vector, the trees in which its piece is too full, with the blocks of its run; few have any, so the vectors
    # need not meet the directory tree by tree.
    full = met.filter(F.col(f"c{CLIMB}") > block).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tree", F.ceil(F.col("c0") / block).cast("int").alias("blocks")))).alias("full"))
    placed = merged(merged(coded, total, "id"), full, "id", "left").select("id", "dim", "q", "scale", "off", "up", "full", F.posexplode("codes").alias("tree", "code"))
    placed = placed.withColumn("blocks", F.col("full")[F.col("tree")]).withColumn("whole", F.col("blocks").isNull()).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    piece = F.when(F.col("whole"), head(depth - CLIMB)).otherwise(-1 - head(depth))
    placed = placed.select("id", "dim", "tree", piece.alias("piece"), "code", F.when(F.col("whole"), F.col("up")).otherwise(0).alias("up"), "q", "scale", "off", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int").alias("own"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")
    found = placed.groupBy("dim", "tree", "piece", "lo", "hi").applyInPandas(lambda pdf: _run_pairs(pdf, depth, k, least), f"a {schema}, b {schema}")
    found = cut(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")))
    # The exact cosine, once for both directions of a pair.
    packed = rows.select("id", F.transform("e", lambda x: x.cast("float")).alias("v"), F.transform("e", lambda x: x - x.cast("float").cast("double")).alias("rest"), "n")
    plain = F.exists("rest", lambda x: x != 0)
    packed = packed.select("id", "v", F.when(plain, F.col("rest")).alias("rest"), "n")
    ends = found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    ends = ends.join(packed.withColumnsRenamed({"id": "x", "v": "vx", "rest": "rx", "n": "nx"}).hint("merge"), "x").join(packed.withColumnsRenamed({"id": "y", "v": "vy", "rest": "ry", "n": "ny"}).hint("merge"), "y")
    full = lambda v, r: F.when(F.col(r).isNull(), F.transform(v, lambda x: x.cast("double"))).otherwise(F.zip_with(v, r, lambda x, e: x.cast("double") + e))
    dot = F.aggregate(F.zip_with(full("vx", "rx"), full("vy", "ry"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ends = cut(ends.select("x", "y", (dot / (F.col("nx") * F.col("ny"))).alias("cosine")).filter(F.col("cosine") >= least))
    pairs = found.join(ends.hint("merge"), (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y"))).select("a", "b", "cosine")
    order = Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    copies = every.join(rows.select("id").hint("merge"), "id", "left_anti").withColumnRenamed("id", "a")
    firsts = rows.filter(F.col("r") <= k).select("dir", "dim", F.col("id").alias("b"), F.col("r").alias("rank"))
    return best.unionByName(merged(copies, firsts, ["dir", "dim"]).select("a", "b", F.lit(1.0).alias("cosine"), "rank"))


def nearest_exact(df: DataFrame, queries: DataFrame, vec: str = "vec_id", embedding: str = "embedding", k: int = 10, block: int = 2048) -> DataFrame:
    """The k nearest others of every id in `queries` (one column), however far they are; ties go to the smaller id.

    Every block of queries is scored against every block of vectors, so nothing is missed; the cost is queries x vectors.
    Result and treatment of unusable vectors, other lengths and repeated ids as in `nearest`.
    """
    spark = df.sparkSession
    rows = usable(df, vec, embedding)
    rows = rows.groupBy("id").agg(F.min(F.struct("e", "n")).alias("x")).select("id", "x.e", "x.n").withColumn("dim", F.size("e"))
    rows = cut(rows)
    largest = rows.groupBy("dim").count().agg(F.max("count")).first()[0]
    schema = rows.schema["id"].dataType.simpleString()
    if largest is None:
        return spark.createDataFrame([], f"a {schema}, b {schema}, cosine DOUBLE, rank INT")
    rows = rows.select("id", "dim", F.transform("e", lambda x: x / F.col("n")).alias("v"))
    asked = cut(rows.join(queries.toDF("id").distinct(), "id", "left_semi"))
    blocks, parts = max(1, math.ceil(largest / block)), max(1, math.ceil(asked.count() / block))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.withColumn("p", place(parts)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("q", place(blocks)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values("id")
            ids, m = y["id"].to_numpy(), np.stack(y["v"].to_numpy()).T
            for at in range(0, len(x), 256):
                part = x.iloc[at : at + 256]
                own = part["id"].to_numpy()
                c = np.round(np.stack(part["v"].to_numpy()) @ m, 9)
                c[own[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-c, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                out.append(pd.DataFrame({"a": np.repeat(own, n), "b": ids[best.reshape(-1)], "cosine": np.take_along_axis(c, best, 1).reshape(-1)}))
        found = pd.concat(out) if out else pd.DataFrame({"a": x["id"], "b": x["id"], "cosine": 0.0}).head(0)
        return found[np.isfinite(found["cosine"])]

    pairs = left.groupBy("dim", "p", "q").cogroup(right.groupBy("dim", "p", "q")).applyInPandas(score, f"a {schema}, b {schema}, cosine DOUBLE")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
