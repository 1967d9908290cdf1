import random

import pytest

from millrace.llm.packing import CAPACITY, pack, pack_sizes


@pytest.mark.parametrize("seed", range(6))
def test_containers_hold_what_fits(seed):
    r = random.Random(seed)
    sizes = [min(100, int(r.paretovariate(0.8) * 3)) for _ in range(r.randrange(1, 800))] + [0, 100, 50, 51]
    where, used = pack_sizes(sizes, 100, 20)
    filled = {}
    for s, w in zip(sizes, where, strict=True):
        filled[w] = filled.get(w, 0) + s
    assert max(filled.values()) <= 100 and all(used[w] == n for w, n in filled.items())
    assert len(used) <= 1.7 * -(-sum(sizes) // 100) + 20  # the bound of harmonic packing, with one open container a class
    assert pack_sizes(sizes, 100, 20) == (where, used)


def test_equal_sizes_reach_the_fixed_count():
    where, used = pack_sizes([25] * 400, 100, 20)
    assert len(used) == 100 and set(used) == {100}
    assert pack_sizes([], 100) == ([], [])


@pytest.mark.parametrize("rows_per_task", [1000, 3])
def test_texts(spark, rows_per_task):
    long = "word " * 5000
    rows = [(1, "a short text", 5), (2, None, 5), (3, "", 5), (4, long, 5), (5, "a short text", 5), (5, "a short text", 5)] + [(i, "some more words " * (i % 90), 1) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, container INT")
    out = pack(df, rows_per_task=rows_per_task).collect()
    total, places = {}, {}
    for r in out:
        total[r["container"]] = total.get(r["container"], 0) + r["tokens"]
        places.setdefault(r["container"], []).append(r["place"])
    assert max(total.values()) <= CAPACITY and all(sorted(p) == list(range(len(p))) for p in places.values())
    parts = sorted((r["part"], r["first_token"], r["tokens"]) for r in out if r["doc_id"] == 4)
    assert [p[1] for p in parts] == [0, 2048, 4096] and all(p[2] == CAPACITY for p in parts[:-1])
    counts = {d: sum(1 for r in out if r["doc_id"] == d) for d in (1, 2, 3, 5)}
    assert counts == {1: 1, 2: 0, 3: 1, 5: 2} and len(out) == len(rows) - 1 + 2
    assert pack(df.limit(0)).count() == 0


def test_fill_over_many_tasks(spark):
    """Lengths of every size over 12 tasks: little space is unused, though no task sees another's texts."""
    r = random.Random(3)
    df = spark.createDataFrame([(i, "some more words " * max(1, int(r.lognormvariate(3.2, 0.9)))) for i in range(6000)], "doc_id BIGINT, text STRING")
    out = pack(df, rows_per_task=500).toPandas()
    assert out["tokens"].sum() >= 0.97 * CAPACITY * out["container"].nunique()
