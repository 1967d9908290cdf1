"""Texts into containers of fixed token capacity: harmonic packing.

A text of s tokens is of class j = floor(capacity / s) (at most CLASSES): any j texts of that class fit one container.
Every partition fills the containers of each class with that fixed count, on its own, so nothing is gathered. Classes run
from long texts to short ones. A text goes into the open container of its class; only where a new one would have to be opened,
the tightest gap that a container full by count has left is taken instead. What the partitions leave badly filled is packed
once more over fewer partitions.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, spread

CAPACITY = 2048
CLASSES = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern that belongs to that vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one packing task, and the fill from which a container is final after the first pass.
ROWS_PER_TASK = 200_000
FINAL_FILL = 0.97


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(df: DataFrame, doc: str, text: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every row whose text is not NULL. The vocabulary file is read once, by the driver."""
    with open(tokenizer, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = spread(df.filter(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(sent.value, pattern)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    return rows.mapInPandas(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens INT")


class Bins:
    """The containers of one task: gaps in a sorted list, one open container per class."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used: list[int] = []
        self.gaps: list[tuple[int, int]] = []
        self.open: dict[int, list[int]] = {}

    def place(self, size: int, kind: int) -> int:
        if kind not in self.open:
            k = bisect.bisect_left(self.gaps, (size, -1))
            if k < len(self.gaps):
                gap, at = self.gaps.pop(k)
                self.used[at] += size
                bisect.insort(self.gaps, (gap - size, at))
                return at
            self.used.append(0)
            self.open[kind] = [len(self.used) - 1, 0]
        at, n = self.open[kind]
        self.used[at] += size
        if n + 1 == kind:  # full by count: what is left of it becomes a gap
            bisect.insort(self.gaps, (self.capacity - self.used[at], at))
            del self.open[kind]
        else:
            self.open[kind][1] = n + 1
        return at

    def close(self) -> None:
        """Turn the open containers into gaps, between one class and the next."""
        for at, _ in self.open.values():
            bisect.insort(self.gaps, (self.capacity - self.used[at], at))
        self.open.clear()


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, classes: int = CLASSES) -> tuple[list[int], list[int]]:
    """(container of each size, tokens used by each container); sizes must not exceed the capacity."""
    bins, where, last = Bins(capacity), [0] * len(sizes), None
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        kind = min(classes, capacity // sizes[i]) if sizes[i] else classes
        if kind != last:
            bins.close()
            last = kind
        where[i] = bins.place(sizes[i], kind)
    return where, bins.used


def pack(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The container and place of every text.

    Result: container BIGINT, place INT (from 0), doc_id, part INT, first_token INT, tokens INT. A text of at most
    `capacity` tokens is one part; a longer one is cut into parts of `capacity` tokens and a rest. NULL texts give no row,
    empty ones take a place of 0 tokens, repeated rows are packed each, other columns play no part.
    """
    counts = token_counts(df, doc, text, tokenizer)
    kind = counts.schema["doc_id"].dataType.simpleString()
    whole = F.greatest(F.ceil(F.col("tokens") / capacity).cast("int"), F.lit(1))
    parts = counts.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), whole - 1)).alias("part"))
    parts = parts.select("doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.col("tokens") - F.col("part") * capacity, F.lit(capacity)).alias("tokens"))
    parts = cut(parts)
    rows = parts.count()
    schema = f"container BIGINT, place INT, doc_id {kind}, part INT, first_token INT, tokens INT, used INT"

    def fill(batches: Iterator[pd.DataFrame], base: int) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        pdf = pd.concat(got).sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable", ignore_index=True)
        where, used = pack_sizes(pdf["tokens"].tolist(), capacity)
        pdf["container"] = base + (TaskContext.get().partitionId() << 32) + pd.Series(where, dtype="int64")
        pdf["place"] = pdf.groupby("container").cumcount().astype("int32")
        pdf["used"] = [used[w] for w in where]
        yield pdf[["container", "place", "doc_id", "part", "first_token", "tokens", "used"]]

    tasks = max(1, -(-rows // rows_per_task))
    first = parts.repartition(tasks, "doc_id", "part").mapInPandas(lambda it: fill(it, 0), schema)
    if tasks == 1:
        return first.drop("used")
    first = cut(first)
    done = F.col("used") >= FINAL_FILL * capacity
    again = first.filter(~done).select("doc_id", "part", "first_token", "tokens")
    second = again.repartition(max(1, tasks // 16), "doc_id", "part").mapInPandas(lambda it: fill(it, 1 << 62), schema)
    return first.filter(done).unionByName(second).drop("used")
