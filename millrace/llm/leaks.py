"""Evaluation passages inside training text: spaced-seed hashing and substitution-tolerant verification.

A seed is a fixed mask over consecutive tokens; positions marked 0 are ignored, so a replaced word there does not hide the
match. Both masks together hit every placement of 2 replacements in 20 words and of 3 in 30 (tests/llm/test_leaks.py
proves it by enumeration).

The seeds of the test items are a table (hash, item, place). All documents are tokenised once, in one pass: a bitmap of the
item hashes, of at most 2 ** MAP_BITS bits however many items there are, lets through the document seeds that may match, and
only documents with such seeds leave the pass. The seed tables are joined by hash; around each hit the diagonal (document
position minus item position) is compared token by token and scored exactly. Nothing is collected but the bitmap.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.joins import merged
from millrace.session import cut, share_path, spread

MASKS = ("1110100111101", "111010110111")
#: The bitmap has 16 bits or more for each item seed, within these bounds (2 ** 27 bits are 16 MB).
LEAST_BITS, MAP_BITS = 16, 27
#: A piece of the bitmap: 2 ** PIECE bits.
PIECE = 16
#: Least words of a leaked passage, and the share of them that may be replaced.
MIN_WORDS = 20
REPLACED = 0.1

_INLINE = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|font|mark|small|code|sub|sup)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!][^<>]*>", re.S)
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case, without markup, punctuation, soft hyphens and line breaks."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFKC", text).replace("­", "").casefold()
    return _WORD.findall(_APOSTROPHE.sub("", text))


def _multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"seed{i}") | 1 for i in range(n)], dtype=np.uint64)


def _ids(tokens: list[str]) -> np.ndarray:
    codes, uniques = pd.factorize(np.asarray(tokens, dtype=object))
    table = np.array([xxhash.xxh64_intdigest(w) for w in uniques], dtype=np.uint64)
    return table[codes] if len(tokens) else np.zeros(0, np.uint64)


def seeds(ids: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the mask at every position of a token array."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for m, i in zip(_multipliers(len(at)), at, strict=True):
        out = out * np.uint64(31) + (ids[i : i + n] ^ (ids[i : i + n] >> np.uint64(29))) * m
    return out


def best_run(match: np.ndarray, least: int = MIN_WORDS, replaced: float = REPLACED) -> tuple[int, int]:
    """(words, matching words) of the longest stretch with both ends matching, `least` words or more and at most the
    share `replaced` not matching; (0, 0) if there is none."""
    n = len(match)
    if n < least:
        return 0, 0
    # Stretch [i, j) is good if cost(j) <= cost(i) with cost = misses - replaced x length.
    cost = np.concatenate([[0.0], np.cumsum(np.where(match, 0.0, 1.0) - replaced)])
    seen = np.concatenate([[0], np.cumsum(match)])
    starts, ends = np.nonzero(match)[0], np.nonzero(match)[0] + 1
    best = (0, 0)
    top = np.maximum.accumulate(cost[starts]) if len(starts) else cost[:0]
    for j in ends[::-1]:
        if j <= best[0]:
            break
        k = int(np.searchsorted(top, cost[j] - 1e-9))  # the first start whose cost reaches that of the end
        if k < len(starts) and (size := j - starts[k]) >= least and size > best[0]:
            best = (int(size), int(seen[j] - seen[starts[k]]))
    return best


def all_seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of both masks at every position of a token array."""
    h = [seeds(ids, mask, salt) for salt, mask in enumerate(MASKS)]
    return np.concatenate(h), np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])


def _item_tables(tests: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, tokens BINARY) of the items and (hash, item_id, place) of their seeds."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "tokens": [_ids(words(t)).tobytes() for t in pdf["text"]]})

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [all_seeds(np.frombuffer(b, dtype=np.uint64)) for b in pdf["tokens"]]
            count = [len(h) for h, _ in got]
            h = np.concatenate([h for h, _ in got]) if got else np.zeros(0, np.uint64)
            place = np.concatenate([p for _, p in got]) if got else np.zeros(0, np.int32)
            yield pd.DataFrame({"hash": h.astype(np.int64), "item_id": np.repeat(pdf["item_id"].to_numpy(), count), "place": place})

    tokens = cut(tests.mapInPandas(tokenise, f"item_id {kind}, tokens BINARY").filter(F.octet_length("tokens") >= 8 * MIN_WORDS).distinct())
    return tokens, cut(tokens.mapInPandas(hashes, f"hash BIGINT, item_id {kind}, place INT"))


def _bitmap(table: DataFrame, bits: int) -> bytes:
    """The bitmap of the hashes: bit i is set where a hash starts with the bits of i. Built piece by piece by the workers."""
    size = 1 << min(PIECE, bits)

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(size, dtype=np.uint8)
        flags[pdf["slot"].to_numpy() % size] = 1
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "flags": [np.packbits(flags).tobytes()]})

    slots = table.select(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("slot")).distinct()
    rows = slots.withColumn("piece", F.floor(F.col("slot") / size).cast("int")).groupBy("piece").applyInPandas(piece, "piece INT, flags BINARY").collect()
    out = bytearray((1 << bits) // 8)
    for r in rows:
        out[r["piece"] * size // 8 : (r["piece"] + 1) * size // 8] = r["flags"]
    return bytes(out)


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that reproduce at least MIN_WORDS consecutive words of an item, up to one in ten replaced.

    Result: doc_id, item_id, words (length of the longest such passage), same_share of that passage; one row per document
    and item. A passage begins and ends with a matching word. NULL and empty texts match nothing, items shorter than
    MIN_WORDS words are never found, repeated rows give one row, other columns play no part, empty tables give an empty
    result.
    """
    share_path(documents.sparkSession)
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL"))
    tests = items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("text IS NOT NULL").distinct()
    doc_kind, kind = docs.schema["doc_id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    tokens, table = _item_tables(tests, kind)
    bits = min(MAP_BITS, max(LEAST_BITS, (16 * table.count()).bit_length()))
    sent = spark.sparkContext.broadcast(_bitmap(table, bits))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, shift = np.frombuffer(sent.value, dtype=np.uint8), np.uint64(64 - bits)
        for pdf in batches:
            listed = [words(t) for t in pdf["text"]]
            sizes = np.array([len(t) for t in listed], dtype=np.int64)
            flat = _ids([w for t in listed for w in t])
            start = np.concatenate([[0], np.cumsum(sizes)])
            h, at = all_seeds(flat)
            slot = (h >> shift).astype(np.int64)
            hit = np.nonzero(flags[slot >> 3] & (128 >> (slot & 7)).astype(np.uint8))[0]
            h, at = h[hit], at[hit]
            d = np.searchsorted(start, at, "right") - 1
            order = np.argsort(d, kind="stable")
            h, at, d = h[order], at[order], d[order]
            if not len(d):
                continue
            have, first = np.unique(d, return_index=True)
            ends = np.append(first, len(d))[1:]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy()[have], "words": [flat[start[i] : start[i + 1]].tobytes() for i in have],
                "hash": [h[a:b].astype(np.int64) for a, b in zip(first, ends, strict=True)], "at": [(at[a:b] - start[i]).astype(np.int32) for i, a, b in zip(have, first, ends, strict=True)],
            })

    met = cut(docs.mapInPandas(scan, f"doc_id {doc_kind}, words BINARY, hash ARRAY<BIGINT>, at ARRAY<INT>").withColumn("row", F.monotonically_increasing_id()))
    hits = met.select("row", F.explode(F.arrays_zip("hash", "at")).alias("x")).select("row", "x.hash", "x.at")
    lines = merged(hits, table, "hash").select("row", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    lines = lines.groupBy("row", "item_id").agg(F.collect_list("shift").alias("shifts"))
    both = merged(merged(lines, met.select("row", "doc_id", "words"), "row"), tokens, "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, w, t, shifts in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["tokens"], pdf["shifts"], strict=True):
                text, ids, best = np.frombuffer(w, dtype=np.uint64), np.frombuffer(t, dtype=np.uint64), (0, 0)
                for shift in shifts:
                    a, b = max(0, -shift), min(len(ids), len(text) - shift)
                    if b - a >= MIN_WORDS:
                        best = max(best, best_run(ids[a:b] == text[a + shift : b + shift]))
                if best[0]:
                    rows.append((d, i, best[0], best[1] / best[0]))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "same_share"])

    found = both.select("doc_id", "item_id", "words", "tokens", "shifts").mapInPandas(verify, f"doc_id {doc_kind}, item_id {kind}, words INT, same_share DOUBLE")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("words", "same_share")).alias("x"))
    return best.select("doc_id", "item_id", "x.words", "x.same_share")
