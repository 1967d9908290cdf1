from itertools import combinations

import numpy as np
import pytest

from millrace.llm.leaks import MASKS, best_run, find_leaks, words

ITEM = " ".join(f"w{i}" for i in range(60))
DOC = "doc_id BIGINT, text STRING, item_id STRING, words INT"


@pytest.mark.parametrize("size, misses", [(20, 2), (30, 3)])
def test_masks_hit_every_placement(size, misses):
    for at in combinations(range(size), misses):
        assert any(all(mask[i] == "0" or s + i not in at for i in range(len(mask))) for mask in MASKS for s in range(size - len(mask) + 1)), at


def brute_run(match):
    best = 0
    for i in range(len(match)):
        for j in range(i + 20, len(match) + 1):
            if match[i] and match[j - 1] and (~match[i:j]).sum() <= 0.1 * (j - i) + 1e-9:
                best = max(best, j - i)
    return best


def test_best_run_against_all_windows():
    r = np.random.default_rng(4)
    for _ in range(300):
        match = r.random(r.integers(0, 70)) < r.choice([0.6, 0.85, 0.95])
        assert best_run(match)[0] == brute_run(match)


def docs(spark):
    w = ITEM.split()
    changed = w[10:40]
    changed[7] = changed[15] = changed[22] = "other"
    far = w[10:40]
    far[3::5] = ["other"] * len(far[3::5])
    rows = [
        (1, "x y " + ITEM + " z"), (2, " ".join(w[5:25])), (3, " ".join(w[5:24])), (4, " ".join(changed)), (5, " ".join(far)), (6, None), (7, ""),
        (8, "> <b>" + "</b> ".join(x.upper() + ", " for x in w[:25])), (9, "\r\n".join(w[30:55])), (10, "a " * 200_000 + ITEM), (1, "x y " + ITEM + " z"), (11, " ".join(reversed(w))),
    ]
    return spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], DOC)


def test_cases(spark):
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (7, ITEM)], "item_id BIGINT, text STRING")
    got = {r["doc_id"]: r["words"] for r in find_leaks(docs(spark), items).collect()}
    assert got == {1: 60, 2: 20, 4: 30, 8: 25, 9: 25, 10: 60}


def test_empty_sides(spark):
    items = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert find_leaks(docs(spark), items).count() == 0
    assert find_leaks(docs(spark).limit(0), spark.createDataFrame([(7, ITEM)], items.schema)).count() == 0


def test_a_full_bitmap_gives_the_same(spark, monkeypatch):
    """A bitmap too small for the items lets every seed through; the join decides all the same."""
    from millrace.llm import leaks

    items = spark.createDataFrame([(i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(5)] + [(7, ITEM)], "item_id BIGINT, text STRING")
    text = docs(spark).unionByName(spark.createDataFrame([(50, " ".join(f"v3x{k}" for k in range(30)), "", 0)], DOC))
    whole = {tuple(r) for r in find_leaks(text, items).collect()}
    monkeypatch.setattr(leaks, "LEAST_BITS", 3)
    monkeypatch.setattr(leaks, "MAP_BITS", 3)
    assert {tuple(r) for r in find_leaks(text, items).collect()} == whole and (50, 3, 30, 1.0) in whole


def test_every_document_is_tokenised_once(spark):
    items = spark.createDataFrame([(i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(40)], "item_id BIGINT, text STRING")
    seen = spark.sparkContext.accumulator(0)
    text = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id BIGINT, text STRING")

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    find_leaks(text.mapInPandas(count, text.schema), items).collect()
    assert seen.value == 50


def test_words_drop_markup():
    assert words("A<b>b</b>c <p>It&#39;s</p><br>so-called") == ["abc", "its", "so", "called"]
