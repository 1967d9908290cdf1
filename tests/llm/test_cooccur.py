from collections import Counter
from itertools import combinations

import pytest

from millrace.llm.cooccur import pair_counts

SCHEMA = "rec STRING, it STRING, item STRING, joint INT"


def brute(rows):
    sets = {}
    for r, i, *_ in rows:
        if r and r.strip() and i and i.strip():
            sets.setdefault(r, set()).add(i)
    return Counter(p for s in sets.values() for p in combinations(sorted(s), 2))


@pytest.fixture(scope="module")
def rows():
    import random

    r = random.Random(5)
    out = [(f"r{r.randrange(300)}", f"i{int(r.paretovariate(0.7)) % 60}", "x", 1) for _ in range(3000)]
    return out + [(None, "i1", None, None), ("r1", None, "x", 1), (" ", "i1", "x", 1), ("r1", "  ", "x", 1), ("r1", "", "x", 1)] + out[:500]


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3, 2.0])
def test_all_parts_give_the_same_counts(spark, rows, share):
    got = pair_counts(spark.createDataFrame(rows, SCHEMA), "rec", "it", heavy_share=share)
    assert {(r["item_a"], r["item_b"]): r["joint"] for r in got.collect()} == dict(brute(rows))


def test_many_heavy_items_and_long_records(spark, rows, monkeypatch):
    from millrace.llm import cooccur

    monkeypatch.setattr(cooccur, "MOST_HEAVY", 3)
    monkeypatch.setattr(cooccur, "LONG", 4)
    got = pair_counts(spark.createDataFrame(rows, SCHEMA), "rec", "it", heavy_share=0.001)
    assert {(r["item_a"], r["item_b"]): r["joint"] for r in got.collect()} == dict(brute(rows))


def test_minimum_and_lift(spark, rows):
    got = pair_counts(spark.createDataFrame(rows, SCHEMA), "rec", "it", min_joint=5).collect()
    expected = {p: n for p, n in brute(rows).items() if n >= 5}
    assert {(r["item_a"], r["item_b"]): r["joint"] for r in got} == expected
    r = got[0]
    assert r["lift"] == pytest.approx(r["joint"] * r["records"] / (r["n_a"] * r["n_b"]))


def test_empty(spark):
    assert pair_counts(spark.createDataFrame([], SCHEMA), "rec", "it").count() == 0
    assert pair_counts(spark.createDataFrame([(None, None, None, None)], SCHEMA), "rec", "it").count() == 0


def test_one_record_with_a_third_of_all_rows(spark):
    rows = [("big", f"i{k}", "", 0) for k in range(400)] + [(f"r{k}", f"i{k % 400}", "", 0) for k in range(800)]
    got = pair_counts(spark.createDataFrame(rows, SCHEMA), "rec", "it")
    assert got.count() == 400 * 399 // 2 and got.filter("joint <> 1").count() == 0


def test_lift_of_pairs_in_one_or_two_postings(spark, tmp_path):
    from millrace.llm.q_cooccur import p1_lift

    rows = [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p2", "c"), ("p3", "a")]
    spark.createDataFrame(rows, "posting_id STRING, req_group STRING").write.parquet(f"{tmp_path}/requirements.parquet")
    got = {(r["group_a"], r["group_b"]): (r["joint"], r["n_a"], r["n_b"], r["lift"]) for r in p1_lift(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 3, 2, 1.0), ("a", "c"): (1, 3, 1, 1.0), ("b", "c"): (1, 2, 1, 1.5)}
