"""Personal data in free text: found by a linear-chain CRF, replaced by typed placeholders."""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import crf
from millrace.llm.pii_table import KINDS, labelled
from millrace.session import spread

#: Share of the words in training that hide their letters.
HIDDEN = 0.2

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

_CHECK = {
    "email": lambda s: bool(re.search(r"@|\bat\b", s, re.I)) and bool(re.search(r"\.|\bdot\b", s, re.I)) and len(s) >= 6,
    "phone": lambda s: sum(c.isdigit() for c in s) >= 7 and not re.search(r"[^\W\d_]", s),
    "id_number": lambda s: sum(c.isdigit() for c in s) >= 4 and sum(c.isalnum() for c in s) >= 7,
    "address": lambda s: any(c.isdigit() for c in s) and sum(c.isalpha() for c in s) >= 4,
    "name": lambda s: sum(c.isalpha() for c in s) >= 3 and not re.search(r"[\d@<>/]", s),
}


def encode(text: str, spans: list[tuple[int, int, str]], hide: random.Random | None = None) -> tuple[list[str], list[str]]:
    """Token types and labels of a labelled text; with `hide` one word in five hides its letters."""
    types, starts, ends = crf.tokens(text)
    tags = ["O"] * len(types)
    for a, b, kind in spans:
        inside = [i for i in range(len(types)) if starts[i] < b and ends[i] > a]
        for n, i in enumerate(inside):
            tags[i] = ("I-" if n else "B-") + kind
    if hide is not None:
        types = [t + crf.BLIND if t[-1].isalnum() and hide.random() < HIDDEN else t for t in types]
    return types, tags


@functools.lru_cache(maxsize=2)
def model(fills: int = 3, seed: int = 11) -> crf.Model:
    """The field, trained from the labelled table."""
    hide = random.Random(seed)
    rows = [encode(text, spans, hide) for text, spans in labelled(fills, seed)]
    return crf.train([r[0] for r in rows], [r[1] for r in rows], LABELS)


#: Signs that end a word as written; a found stretch never ends inside a word.
_EDGE = " \t\r\n\x0b\x0c\u00a0<>(),;:\"|"
_ENDS_IN_INITIAL = re.compile(r"^[^\s,]+ \w\.?$")
_AFTER_INITIAL = re.compile(r"\.? (?:(?:van|de|von|di) )?[^\W\d_]+(?:-[^\W\d_]+)*", re.I)
_ABBREVIATED = re.compile(r"\b(?:rd|st|ave|str)\.$", re.I)


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in ",;:<>)]'\"-*•" or (text[a] in "./" and kind != "email")):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:<>([/'\"-*•" or text[b - 1] == "."):
        if text[b - 1] == "." and (kind == "name" and re.search(r"(?:^|[\s,])\w\.$", text[a:b]) or kind == "address" and _ABBREVIATED.search(text[a:b])):
            break
        b -= 1
    return a, b


def _snap(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    """The stretch widened to whole words."""
    if text[a] not in "(+":
        while a > 0 and text[a - 1] not in _EDGE + "*•":
            a -= 1
    if kind == "phone" and a > 0 and text[a - 1] == "(" and ")" in text[a:b]:
        a -= 1
    if kind == "id_number" and a > 1 and text[a - 1] == "<" and text[a - 2] == "P":
        a -= 2
    while b < len(text) and text[b] not in _EDGE + "*•":
        b += 1
    return _trim(text, a, b, kind)


def spans_of(text: str, starts: list[int], ends: list[int], path) -> list[tuple[int, int, str]]:
    """The labelled stretches of a text, of whole words and without signs at their ends; each must look like its kind."""
    raw, i, n = [], 0, len(path)
    while i < n:
        label = LABELS[path[i]]
        if label == "O":
            i += 1
            continue
        kind, j = label[2:], i + 1
        while j < n and LABELS[path[j]] == f"I-{kind}":
            j += 1
        a, b = _trim(text, starts[i], ends[j - 1], kind)
        if a < b:
            a, b = _snap(text, a, b, kind)
        if kind == "name" and (m := _AFTER_INITIAL.match(text, b)) and _ENDS_IN_INITIAL.search(text[a:b]):
            b = m.end()  # a first name and an initial are followed by the surname
        if a < b:
            # Pieces of one kind with nothing but a blank between them are one; words shared with the piece before stay there.
            if raw and raw[-1][2] == kind and (a <= raw[-1][1] or text[raw[-1][1] : a] == " "):
                raw[-1] = (raw[-1][0], max(b, raw[-1][1]), kind)
            elif not raw or a >= raw[-1][1]:
                raw.append((a, b, kind))
        i = j
    return [(a, b, kind) for a, b, kind in raw if _CHECK[kind](text[a:b])]


def detect(field: crf.Model, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The personal data of each text as (start, end, kind); equal texts are decoded once."""
    once = list(dict.fromkeys(texts))
    cut = [crf.tokens(t) for t in once]
    paths = field.decode([c[0] for c in cut])
    known = {t: spans_of(t, c[1], c[2], p) for t, c, p in zip(once, cut, paths, strict=True)}
    return [known[t] for t in texts]


def _with_spans(documents: DataFrame, doc: str, text: str, schema: str, make) -> DataFrame:
    rows = spread(documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    sent = documents.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                yield make(part, texts, detect(sent.value, texts))

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def find_personal(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, found, start): every stretch of personal data, as written, with its place.

    NULL and empty texts have none, repeated rows are treated alike, texts of any length are read whole, other columns
    play no part, an empty table gives an empty result.
    """

    def make(part, texts, spans):
        rows = [(d, k, t[a:b], a) for d, t, s in zip(part["doc_id"], texts, spans, strict=True) for a, b, k in s]
        return pd.DataFrame(rows, columns=["doc_id", "kind", "found", "start"])

    return _with_spans(documents, doc, text, "kind STRING, found STRING, start INT", make)


def redact(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, replaced): each text with personal data replaced by [EMAIL], [PHONE], ... and nothing else changed.

    A NULL text stays NULL.
    """

    def make(part, texts, spans):
        out = []
        for t, s in zip(texts, spans, strict=True):
            at, pieces = 0, []
            for a, b, k in s:
                pieces += [t[at:a], f"[{k.upper()}]"]
                at = b
            out.append("".join(pieces) + t[at:])
        given = [o if isinstance(t, str) else None for o, t in zip(out, part["text"], strict=True)]
        return pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text": given, "replaced": [len(s) for s in spans]})

    return _with_spans(documents, doc, text, "text STRING, replaced INT", make)
