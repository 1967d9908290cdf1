"""Groups of records that say the same, by power-iteration spectral clustering.

1. A phrase is read as a subject (words with few partners, written as one string) and a use (words that stand with many
   different others); the words that only frame a wish are set aside. Phrases that agree in both are one node.
2. Sparse affinities, a graph with three kinds of links: nodes of one block and use whose subjects are at most two slips apart
   (the weight falls with the slips); each node to the hub of its subject, whatever its use; hubs of subjects that are at most
   two slips apart. Hubs stand for "the same product for another use" with as many links as nodes, not as pairs of nodes.
   Subjects are compared once a block, where they share a spelling with at most two letters left out (long ones: a run of 4
   letters at about the same place), so that the pairs to compare do not grow with the square of the block.
3. Power iteration: several random vectors are multiplied again and again with the row-normalised affinity matrix, one join
   and one aggregation a round. Nodes of a tightly linked set approach the same coordinates.
4. K-means in these coordinates, seeded with the affinity peaks. A node compares the centres that it and its
   neighbours are in; a hub is in the one nearest to it, so another use of the product is a real choice, and the embedding decides.
5. Members are ranked by internal affinity, the sum of their weights to members of the same cluster.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.canonical import slips
from millrace.llm.joins import merged
from millrace.session import cut, share_path, spread

#: Words that frame a wish without naming what is wished for (fixed values).
FRAMES = frozenset(
    "a able ability about advanced all an and any are around as at background basic be been can capable capability command "
    "competence competent confident could deep demonstrated demonstrable do doing excellent experience experienced expert "
    "expertise familiar familiarity first fluent for from good great hand handle handled handling-of hands have having in into is "
    "it its know knowing knowledge like long many more must of on one or our out own practical practice professional "
    "proficiency proficient proven recent run running several set skill skilled skills solid some sound strong such "
    "that the their them thorough to track tried understanding up use used user using very was well were versed with within "
    "work worked working years year your you".split()
)
#: A word counts as common if it stands with at least (number of words) ** PARTNERS different words. How often it stands
#: there plays no part: a product in many phrases still has only its other half, slips of it and its uses as partners.
PARTNERS = 0.4
#: Weight of the link between a node and the hub of its subject.
HUB = 0.05
VECTORS = 6
ROUNDS = 6
KMEANS_ROUNDS = 3
#: Subjects of more letters than this have too many spellings with two letters left out.
LONG = 24


def fold(text: str | None) -> list[str]:
    flat = unicodedata.normalize("NFKD", (text or "").casefold())
    return re.findall(r"[^\W_]+", "".join(c for c in flat if not unicodedata.combining(c)))


def _single(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _shorter(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Reader:
    """Splits a phrase into (use, subject), given the common words of the corpus."""

    def __init__(self, common: list[str]):
        self.common = frozenset(common)
        self.known: dict[str, str | None] = {}
        # Words by themselves and by each of their spellings with one letter left out.
        self.near: dict[str, list[str]] = {}
        for w in sorted(w for w in self.common | FRAMES if len(w) > 3):
            for v in _shorter(w):
                self.near.setdefault(v, []).append(w)

    def word(self, word: str) -> str | None:
        """The common word meant ('' for a frame word), or None for a rare word."""
        if word in FRAMES:
            return ""
        if _single(word) in self.common:
            return _single(word)
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            near: list[str] = []
            for form in dict.fromkeys((word, _single(word)) if len(word) > 4 else (word,) if len(word) > 3 else ()):
                maybe = {w for v in _shorter(form) for w in self.near.get(v, ())}
                near = near or sorted(w for w in maybe if slips(w, form, 1) <= 1)
            self.known[word] = None if not near else "" if near[0] in FRAMES else near[0]
        return self.known[word]

    def read(self, text: str | None) -> tuple[str, str]:
        use, subject, before = set(), [], ""
        for w in fold(text):
            found = self.word(w)
            if found == "" and before and _single(w) in self.common:
                found = _single(w)  # "payroll run": a frame word that continues a use
            before = found
            if found is None:
                # Two common words written as one.
                parts = next(((w[:i], w[i:]) for i in range(3, len(w) - 2) if _single(w[:i]) in self.common and _single(w[i:]) in self.common), None)
                if parts:
                    use.update(_single(p) for p in parts)
                else:
                    subject.append(w)
            elif found:
                use.add(found)
        return " ".join(sorted(use)), "".join(subject)


def read_phrases(df: DataFrame, phrase: str, text: str, group: str) -> DataFrame:
    """(id, text, block, use, subject) of every phrase; block is the group without case and outer blanks."""
    block = F.lower(F.trim(F.coalesce(F.col(f"`{group}`"), F.lit(""))))
    rows = df.select(F.col(f"`{phrase}`").alias("id"), F.col(f"`{text}`").alias("text"), block.alias("block")).filter("id IS NOT NULL AND text IS NOT NULL").distinct()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [sorted({_single(w) for w in fold(t) if w not in FRAMES}) for t in pdf["text"]]
            yield pd.DataFrame({"words": words})

    rows = spread(rows)
    sets = cut(rows.select("text").mapInPandas(tokens, "words ARRAY<STRING>").distinct())
    words = sets.select(F.explode("words").alias("word"), "words")
    total = words.select("word").distinct().count()
    partners = words.select("word", F.explode("words").alias("other")).filter("word <> other").distinct()
    common = partners.groupBy("word").count().filter(F.col("count") >= total**PARTNERS).select("word").orderBy("word").collect()  # at most (mean partners) x total ** (1 - PARTNERS)
    sent = rows.sparkSession.sparkContext.broadcast(Reader([r["word"] for r in common]))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [sent.value.read(t) for t in pdf["text"]]
            yield pdf.assign(use=[b[0] for b in both], subject=[b[1] for b in both])

    return rows.mapInPandas(read, rows.schema.simpleString()[7:-1].replace(":", " ") + ", use STRING, subject STRING")


def _variants(named: DataFrame) -> DataFrame:
    """(key, n): a hash of the block and of every spelling that a subject has with at most two letters left out.

    Subjects two slips apart share one: a letter lost or gained is left out on one side, one exchanged or out of order on
    both. Under 8 letters only one slip counts, so one letter is left out.
    """
    firsts = named.withColumn("i", F.explode(F.expr("sequence(0, IF(size < 8, 0, size - 1))")))
    both = firsts.withColumn("j", F.explode(F.expr("sequence(IF(i = 0, 0, i + 1), size)")))
    left = F.expr("concat(substring(subject, 1, i - 1), substring(subject, i + 1, j - i - 1), substring(subject, j + 1))")
    return both.select(F.xxhash64("block", left).alias("key"), "n")


def _shared_grams(named: DataFrame) -> DataFrame:
    """(n, m), n < m: subjects that share a run of 4 letters at about the same place."""
    grams = named.select("block", "n", "size", "subject", F.explode(F.expr("sequence(1, size - 3)")).alias("at")).select("block", "n", "size", "at", F.expr("substring(subject, at, 4)").alias("gram"))
    # The place is part of the key, so that a run of letters that many share at different places is no hot key.
    other = grams.select("block", "gram", F.explode(F.expr("sequence(at - 2, at + 2)")).alias("at"), F.col("n").alias("m"), F.col("size").alias("size2"))
    return merged(grams, other, ["block", "gram", "at"]).filter("n < m AND abs(size - size2) <= 2").select("n", "m")


def candidates(named: DataFrame, long: int = LONG) -> DataFrame:
    """(n, m), n < m: all pairs of (n, block, subject, size) that may be two slips apart; of `long` letters or fewer, hardly any others."""
    keys = _variants(named.filter(F.col("size") <= long))
    # Both sides are renamed, so that they are the same exchange, written once.
    alike = merged(keys.select("key", F.col("n").alias("a")), keys.select("key", F.col("n").alias("b")), "key").filter("a < b").select(F.col("a").alias("n"), F.col("b").alias("m"))
    return alike.unionByName(_shared_grams(named.filter(F.col("size") > long - 2))).distinct()


def subject_pairs(subjects: DataFrame, long: int = LONG) -> DataFrame:
    """(block, x, y, w) for different subjects x < y of a block, at most two slips apart, of subjects (block, subject).

    They must share a run of 4 letters at about the same place. Up to `long` letters they are found by the spellings with
    letters left out, of which there are a number a subject and few that two unlike ones share; longer ones by their runs.
    """
    named = cut(subjects.filter(F.length("subject") >= 5).select("block", "subject", F.length("subject").alias("size"), F.monotonically_increasing_id().alias("n")))
    pairs = candidates(named, long)
    pairs = merged(merged(pairs, named.select("n", "block", F.col("subject").alias("x")), "n"), named.select(F.col("n").alias("m"), "block", F.col("subject").alias("y")), ["m", "block"])
    pairs = pairs.select("block", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).withColumn("d", F.levenshtein("x", "y", 4)).filter("d >= 0")

    def run(x: str, y: str) -> bool:
        return any(x[at : at + 4] == y[at + by : at + by + 4] for by in (0, -1, 1, -2, 2) for at in range(max(0, -by), len(x) - 3))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.array([n if n <= 1 else slips(x, y) for x, y, n in zip(pdf["x"], pdf["y"], pdf["d"], strict=True)], dtype=int)
            short = np.minimum(pdf["x"].str.len(), pdf["y"].str.len())
            ok = (d <= 2) & ((d <= 1) | (short >= 8))
            ok &= np.array([k and run(x, y) for x, y, k in zip(pdf["x"], pdf["y"], ok, strict=True)], dtype=bool)
            yield pd.DataFrame({"block": pdf["block"], "x": pdf["x"], "y": pdf["y"], "w": np.exp(-1.0 * d)})[ok]

    return pairs.mapInPandas(score, "block STRING, x STRING, y STRING, w DOUBLE")


def affinities(nodes: DataFrame) -> DataFrame:
    """(a, b, w, kind) of both directions for nodes (node, block, use, subject): kind 0 same use, 1 to or between hubs."""
    named = nodes.filter("subject <> ''")
    pairs = cut(subject_pairs(named.select("block", "subject").distinct()))
    near = merged(named.select(F.col("node").alias("a"), "block", "use", F.col("subject").alias("x")), pairs, ["block", "x"])
    same = merged(near, named.select(F.col("node").alias("b"), "block", "use", F.col("subject").alias("y")), ["block", "use", "y"]).select("a", "b", "w", F.lit(0).alias("kind"))
    up = named.select(F.col("node").alias("a"), hub("subject").alias("b"), F.lit(HUB).alias("w"), F.lit(1).alias("kind"))
    across = pairs.select(hub("x").alias("a"), hub("y").alias("b"), (F.col("w") * HUB).alias("w"), F.lit(1).alias("kind"))
    edges = same.unionByName(up).unionByName(across)
    return edges.unionByName(edges.selectExpr("b AS a", "a AS b", "w", "kind"))


def hub(subject: str) -> Column:
    """The number of the hub of a subject in its block."""
    return F.xxhash64(F.lit("hub"), "block", subject)


def _random(node: Column, k: int) -> Column:
    return (F.pmod(F.xxhash64(node, F.lit(k)), F.lit(1 << 20)).cast("double") / float(1 << 20)).alias(f"x{k}")


def embed(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, x0, x1, ...): the coordinates of every linked node after so many rounds of power iteration."""
    coords = [f"x{k}" for k in range(VECTORS)]
    linked = edges.select(F.col("a").alias("node")).distinct()
    # Row-normalised affinities, with a self-loop of weight 1 that keeps the iteration from oscillating.
    loops = linked.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("w"))
    whole = edges.select("a", "b", "w").unionByName(loops)
    degree = whole.groupBy("a").agg(F.sum("w").alias("total"))
    # Kept in the partitioning of the column side, so that a round shuffles the vectors only.
    matrix = cut(merged(whole, degree, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")).repartition("b"))
    x = linked.select("node", *[_random(F.col("node"), k) for k in range(VECTORS)])
    for r in range(rounds):
        x = merged(matrix, x.withColumnRenamed("node", "b"), "b").groupBy("a").agg(*[F.sum(F.col("p") * F.col(c)).alias(c) for c in coords]).withColumnRenamed("a", "node")
        if r % 4 == 3:
            x = cut(x)
    return cut(x)


def spectral_clusters(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster) for nodes (node BIGINT, size) and edges (a, b, w, kind) in both directions."""
    coords = [f"x{k}" for k in range(VECTORS)]
    edges = cut(edges)
    x = embed(edges, rounds)
    strong = edges.filter("kind = 0")
    real = nodes.select("node", "size")
    # Affinity peaks: nodes that no neighbour of the same use exceeds in the weight of their surroundings.
    mass = merged(strong, real.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("size")).alias("around")).withColumnRenamed("a", "node")
    mass = merged(real, mass, "node", "left").select("node", F.struct((F.coalesce("around", F.lit(0.0)) + F.col("size")).alias("m"), F.col("node").alias("i")).alias("s"))
    mass = cut(mass)
    near = merged(strong.select("a", "b"), mass.withColumnsRenamed({"node": "b", "s": "t"}), "b")
    best = near.groupBy("a").agg(F.max("t").alias("t")).withColumnRenamed("a", "node")
    label = cut(merged(mass, best, "node", "left").select("node", F.when(F.col("t").isNull() | (F.col("s") >= F.col("t")), F.col("node")).otherwise(F.col("t.i")).alias("cluster")))
    for _ in range(60):  # follow the pointers to the peak; their length halves
        up = label.select(F.col("node").alias("cluster"), F.col("cluster").alias("next"))
        moved = cut(merged(label, up, "cluster").select("node", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")))
        label = moved.select("node", "cluster")
        if moved.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("the pointers to the affinity peaks did not settle")
    linked = merged(label, x.select("node"), "node", "left_semi")
    alone = merged(label, x.select("node"), "node", "left_anti")
    # Who may offer a centre to whom does not change: neighbours of real nodes, and the nodes around each hub.
    around = cut(edges.select("a", "b", "kind"))
    for _ in range(KMEANS_ROUNDS):
        placed = merged(linked, x, "node")
        centre = cut(placed.groupBy("cluster").agg(*[F.avg(c).alias(f"c{c}") for c in coords]))
        away = sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in coords)
        nearest = F.min(F.struct(F.round(away, 9).alias("d"), "cluster")).alias("m")
        # A hub is in the centre nearest to it among those next to it; every neighbour, hubs too, offers the centre it is in.
        next_to = merged(around.filter("kind = 1").select(F.col("a").alias("node"), "b"), linked.withColumnRenamed("node", "b"), "b").select("node", "cluster").distinct()
        hubs = merged(merged(next_to, x, "node"), centre, "cluster").groupBy("node").agg(nearest).select("node", "m.cluster")
        offered = merged(around.select(F.col("a").alias("node"), "b"), linked.unionByName(hubs).withColumnRenamed("node", "b"), "b").select("node", "cluster")
        seen = merged(offered, linked.select("node"), "node", "left_semi").unionByName(linked).distinct()
        moved = cut(merged(merged(seen, x, "node"), centre, "cluster").groupBy("node").agg(nearest).select("node", "m.cluster"))
        same = merged(moved, linked.withColumnRenamed("cluster", "was"), "node").filter("cluster <> was").isEmpty()
        linked = moved
        if same:
            break
    return linked.unionByName(alone)


def cluster_phrases(df: DataFrame, phrase: str = "phrase_id", text: str = "atom_norm", group: str = "head_group", rounds: int = ROUNDS) -> DataFrame:
    """Every phrase with its cluster.

    Result: id, text, block, cluster BIGINT, affinity DOUBLE (weight to other members, counting equal wordings 1 each).
    Rows with a NULL id or text are left out; a phrase that is like no other is a cluster of its own; NULL and blank groups
    form one block; repeated rows count once; an empty table gives an empty result.
    """
    share_path(df.sparkSession)
    rows = cut(read_phrases(df, phrase, text, group).withColumn("node", F.xxhash64("block", "use", "subject")))
    nodes = cut(rows.groupBy("node").agg(F.first("block").alias("block"), F.first("use").alias("use"), F.first("subject").alias("subject"), F.count(F.lit(1)).alias("size")))
    edges = cut(affinities(nodes))
    label = spectral_clusters(nodes, edges, rounds)
    inside = merged(merged(edges.filter("kind = 0"), label.withColumnsRenamed({"node": "a", "cluster": "ca"}), "a"), label.withColumnsRenamed({"node": "b", "cluster": "cb"}), "b").filter("ca = cb")
    inside = merged(inside, nodes.selectExpr("node AS b", "size"), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("size")).alias("links")).withColumnRenamed("a", "node")
    facts = merged(merged(label, nodes.select("node", "size"), "node"), inside, "node", "left")
    facts = facts.select("node", "cluster", (F.coalesce("links", F.lit(0.0)) + F.col("size") - 1).alias("affinity"))
    return merged(rows, facts, "node").select("id", "text", "block", "subject", "use", "cluster", "affinity")


def pairs_of(members: DataFrame, part: int = 2048) -> DataFrame:
    """(a, b), a < b: all pairs inside each cluster of members (id, cluster); a big cluster is cut into parts that meet each other."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    rows = merged(members.select("id", "cluster"), sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
    left = rows.select("cluster", F.col("id").alias("a"), "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    right = rows.select("cluster", F.col("id").alias("b"), F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    return merged(left, right, ["cluster", "own", "other"]).filter("a < b").select("a", "b")


def describe(members: DataFrame, top: int = 3) -> DataFrame:
    """Size and most typical members of every cluster of at least two."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("affinity", 6)), "id")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"), F.min("block").alias("block")).filter("size > 1")
    best = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    names = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda s: s["text"]).alias("typical"))
    return sizes.join(names, "cluster").select("first_id", "block", "size", "typical")
