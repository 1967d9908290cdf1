import numpy as np
import pytest

from millrace.llm.neighbours import nearest, nearest_exact

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, a STRING, cosine DOUBLE"


def brute(ids, m, k, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    c = u @ u.T
    out = set()
    for i, a in enumerate(ids):
        near = sorted(((-round(c[i, j], 9), b) for j, b in enumerate(ids) if j != i and c[i, j] >= least))[:k]
        out |= {(int(a), int(b)) for _, b in near}
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    base = r.standard_normal((120, 16))
    return np.concatenate([base + 0.25 * r.standard_normal(base.shape) for _ in range(8)]).astype(np.float32)


def frame(spark, m, extra=()):
    rows = [(i, [float(x) for x in v], "clash", 0.5) for i, v in enumerate(m)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def test_ascending_to_the_root_is_exact(spark, vectors):
    got = {(r["a"], r["b"]) for r in nearest(frame(spark, vectors), k=5, least=0.8, want=10**9).collect()}
    assert got == brute(range(len(vectors)), vectors, 5, 0.8)


def test_every_length_has_its_own_neighbours(spark):
    rows = [(1, [1.0, 0.01], "", 0.0), (2, [1.0, 0.02], "", 0.0), (3, [1.0, 0.0, 0.0], "", 0.0), (4, [1.0, 0.01, 0.0], "", 0.0), (5, [0.0, 1.0, 0.0], "", 0.0)]
    got = {(r["a"], r["b"]) for r in nearest(spark.createDataFrame(rows, SCHEMA), k=2).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


@pytest.mark.parametrize("leaf", [32, 200])
def test_forest_reaches_the_recall(spark, vectors, leaf):
    got = {(r["a"], r["b"]) for r in nearest(frame(spark, vectors), k=5, least=0.8, recall=0.99, leaf=leaf).collect()}
    expected = brute(range(len(vectors)), vectors, 5, 0.8)
    assert len(got & expected) >= 0.98 * len(expected) and got <= brute(range(len(vectors)), vectors, 60, 0.8)


def test_unusable_vectors_and_copies(spark):
    bad = [(900, None, None, None), (901, [], "x", 0.0), (902, [0.0] * 3, "x", 0.0), (903, [1.0, 2.0], "x", 0.0), (None, [1.0, 0.0, 0.0], "x", 0.0), (904, [float("nan")] * 3, "x", 0.0)]
    copies = [(i, [1.0 + i, 0.0, 0.0], "x", 0.0) for i in range(40)]  # one direction, many lengths
    rows = spark.createDataFrame(bad + copies + copies[:5], SCHEMA)
    got = nearest(rows, k=3, least=0.9, leaf=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["a"], []).append(r["b"])
    # Only the k + 1 smallest ids of a direction can be mutual neighbours; among those, ties go to the smaller id.
    assert sorted(by[0]) == [1, 2, 3] and sorted(by[3]) == [0, 1, 2] and not set(by) & {900, 901, 902, 903, 904}
    assert nearest(rows.limit(0)).count() == 0


def test_a_full_node_is_cut_into_blocks(spark):
    r = np.random.default_rng(1)
    m = np.abs(r.standard_normal((60, 4))) * 0.001 + np.array([1.0, 1.0, 1.0, 1.0])  # all share every bit
    got = {(x["a"], x["b"]) for x in nearest(frame(spark, m), k=4, least=0.9, leaf=10, block=20).collect()}
    assert got == brute(range(60), m.astype(np.float32).astype(float), 4, 0.9)


def test_the_k_nearest_need_no_floor(spark, vectors):
    rows = frame(spark, vectors, [(990, None, "x", 0.0), (991, [0.0] * 16, "x", 0.0), (992, [1.0], "x", 0.0)])
    ids = spark.createDataFrame([(i,) for i in [*range(0, len(vectors), 20), 990, 991, 992]], "id BIGINT")
    got = {(r["a"], r["b"]) for r in nearest_exact(rows, ids, k=10, block=100).collect()}
    assert got == {p for p in brute(range(len(vectors)), vectors.astype(float), 10, -1.0) if p[0] % 20 == 0}
    assert len(got) == 10 * len(range(0, len(vectors), 20))


def test_every_copy_has_neighbours(spark):
    rows = spark.createDataFrame([(i, [1.0 + i, 0.0, 0.0], "x", 0.0) for i in range(40)], SCHEMA)
    got = {}
    for r in nearest(rows, k=3, least=0.9).collect():
        got.setdefault(r["a"], []).append((r["rank"], r["b"]))
    assert {a: sorted(b) for a, b in got.items()} == {a: list(enumerate([b for b in range(5) if b != a][:3], 1)) for a in range(40)}


def test_a_tight_cluster_keeps_the_recall(spark):
    r = np.random.default_rng(5)
    m = np.concatenate([r.standard_normal((400, 16)), r.standard_normal((1, 16)) + 0.22 * r.standard_normal((200, 16))]).astype(np.float32)
    got = {(x["a"], x["b"]) for x in nearest(frame(spark, m), k=5, least=0.9, leaf=16).collect()}
    expected = brute(range(600), m.astype(float), 5, 0.9)
    assert len(expected) > 900 and len(got & expected) >= 0.99 * len(expected)


def test_no_size_estimate_sends_a_table_to_the_driver(spark, vectors):
    """Every estimate is under this limit; a broadcast would collect a side that grows with trees x vectors on the driver."""
    runs = spark._jsparkSession.sharedState().statusStore()
    known = {e.executionId() for e in (runs.executionsList().apply(i) for i in range(runs.executionsCount()))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert nearest(frame(spark, vectors), k=5, least=0.8, leaf=32).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans = [e.physicalPlanDescription() for e in (runs.executionsList().apply(i) for i in range(runs.executionsCount())) if e.executionId() not in known]
    assert plans and not any("BroadcastExchange" in p for p in plans)
