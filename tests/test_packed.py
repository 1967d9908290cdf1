"""Packed fields: values, order, quotes, brackets, and the odd cases."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.packed import explode_packed, packed_values

CASES = [
    ("Ada; Basic", ["Ada", "Basic"]),
    ("Ada;; Basic ;", ["Ada", "Basic"]),
    ("Ada, 4,5 years, C", ["Ada", "4,5 years", "C"]),
    ("C/C++ / A/B tests", ["C/C++", "A/B tests"]),
    ('"Ada; B", Lisp', ["Ada; B", "Lisp"]),
    ('"say ""hi"", you" | x', ['say "hi", you', "x"]),
    ("'it's; fine'; rock 'n' roll", ["it's; fine", "rock 'n' roll"]),
    ("„eins, zwei“ • «trois | quatre» · fünf", ["eins, zwei", "trois | quatre", "fünf"]),
    ("Ada (v1, v2); Lisp [a | b]", ["Ada (v1, v2)", "Lisp [a | b]"]),
    ("a (b (c; d)); e", ["a (b (c; d))", "e"]),
    ("a\nb\tc", ["a", "b", "c"]),
    ("• a • b", ["a", "b"]),
    ("a and b or c", ["a and b or c"]),
    ('5" screen, 7" tablet', ['5" screen', '7" tablet']),
    ('"open; never closed', ['"open', "never closed"]),
    ('""; a', ["a"]),
    ("a\u0001b; c", ["a b", "c"]),
    ("  ", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text, values", CASES)
def test_values(spark, text, values):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(packed_values(F.col("t")).alias("v")).first()["v"] == values


def test_explode_keeps_other_columns_and_replaces_clashing_ones(spark):
    df = spark.createDataFrame([(1, "a; b", "old", 9), (2, None, "x", 8), (1, "a; b", "old", 9)], "id INT, f STRING, value STRING, value_idx INT")
    rows = explode_packed(df, "f").orderBy("id", "value_idx").collect()
    assert [(r["id"], r["value_idx"], r["value"]) for r in rows] == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]
    assert explode_packed(df.limit(0), "f").count() == 0


def test_very_long_texts(spark):
    long = "; ".join(f"value {i}" for i in range(50_000))
    quoted = '"' + "x; " * 100_000 + '", b'
    df = spark.createDataFrame([(long,), (quoted,)], "f STRING")
    sizes = sorted(r["n"] for r in df.select(F.size(packed_values(F.col("f"))).alias("n")).collect())
    assert sizes == [2, 50_000]


def split_by_hand(text):
    """A character machine for delimiters outside double quotes and round brackets."""
    out, cur, i, quote, depth = [], "", 0, False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            quote = not quote
        elif not quote:
            depth += (c == "(") - (c == ")" and depth > 0)
        digits = 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()
        if not quote and depth == 0 and (c in ";|" or c == "," and not digits):
            out.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return [x.strip() for x in [*out, cur] if x.strip()]


def test_against_a_character_machine(spark):
    import random

    r = random.Random(3)
    rows = []
    for _ in range(400):
        parts = [r.choice(["ab", "c 1,5 d", "(x; y)", "e (f, g)", "h", "2,3"]) for _ in range(r.randint(1, 6))]
        rows.append(("".join(p + r.choice(["; ", " | ", ", ", ";"]) for p in parts),))
    got = spark.createDataFrame(rows, "t STRING").select("t", packed_values(F.col("t")).alias("v")).collect()
    assert all(g["v"] == split_by_hand(g["t"]) for g in got)
