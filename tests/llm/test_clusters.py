import random
from itertools import combinations

import pytest

from millrace.llm.canonical import slips
from millrace.llm.clusters import Reader, affinities, candidates, cluster_phrases, describe, pairs_of, spectral_clusters, subject_pairs
from millrace.llm.q_clusters import p5_found

SCHEMA = "phrase_id BIGINT, atom_norm STRING, head_group STRING, cluster STRING, text STRING"
USES = ["price lists", "payroll runs", "reporting", "load testing"]


def table():
    rows, truth, n = [], {}, 0
    names = ["gamuto ferali", "brosti kenaro", "vipela sodranu", "tulemi gorasta", "nekrova pelidu", "mozuri talene", "hadrosti biluve", "kestavo runili"]
    for k, name in enumerate(names):
        a, b = name.split()
        use = USES[k % 4]
        for text in (f"experience with {name} {use}", f"{name} {use} experience", f"proven experience of {use} using {a}-{b}", f"experience in {use} with {a}{b}", f"experience {a[:2] + a[3:]} {b} {use}", f"practical {a} {b[0] + b[2] + b[1] + b[3:]} experience in {use}"):
            n += 1
            rows.append((n, text, [" Experience", "experience"][n % 2], "clash", "clash"))
            truth[n] = k
    return rows, truth


@pytest.fixture(scope="module")
def members(spark):
    rows, truth = table()
    extra = [(900, "experience with gamuto ferali reporting", "experience", "", ""), (901, "experience with gamuto ferali price lists", "ability", "", ""), (902, None, "x", "", ""), (None, "x", "x", "", ""), (903, "", None, "", ""), (904, "zz " * 20_000, None, "", "")]
    df = spark.createDataFrame(rows + extra + rows[:4], SCHEMA)
    return cluster_phrases(df).cache(), truth


def test_same_product_and_use_meet(members):
    df, truth = members
    by = {}
    for r in df.collect():
        by.setdefault(r["cluster"], set()).add(r["id"])
    got = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    expected = {(a, b) for a, b in combinations(sorted(truth), 2) if truth[a] == truth[b]}
    # Another use (900) and another group (901) stay apart, odd texts are alone.
    assert got == expected and {900, 901, 903, 904} <= {r["id"] for r in df.collect()}


def test_description(members):
    df, _ = members
    out = describe(df).collect()
    assert len(out) == 8 and all(r["size"] == 6 and len(r["typical"]) == 3 for r in out)


def test_empty(spark):
    assert cluster_phrases(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reader_repairs_slips_and_glued_words():
    r = Reader(["price", "list", "payroll", "run"])
    assert r.read("experience with Gámuto-ferali price list") == ("list price", "gamutoferali")
    assert r.read("gamuto ferali pirce lists knowledge") == ("list price", "gamutoferali")
    assert r.read("gamutoferali pricelists") == ("list price", "gamutoferali")
    assert r.read("able to run payroll run in gamuto ferali") == ("payroll run", "gamutoferali")
    assert r.read(None) == ("", "")


def test_a_product_in_many_phrases_stays_a_product(spark, tmp_path):
    """Every product word is in 4 of 24 phrases or more, far over any share; it has few partners all the same."""
    names = ["gamuto ferali", "brosti kenaro", "vipela sodranu", "tulemi gorasta", "nekrova pelidu", "mozuri talene"]
    texts = [t for n in names for u in ("price lists", "load testing") for t in (f"experience with {n} {u}", f"{n} {u} knowledge")]
    rows = [(i, t, "experience") for i, t in enumerate(texts)] + [(900, "very good experience", "experience"), (901, "good experience", "experience")]
    spark.createDataFrame(rows, "phrase_id BIGINT, atom_norm STRING, head_group STRING").write.parquet(f"{tmp_path}/phrases.parquet")
    got = {(r["phrase_a"], r["phrase_b"]) for r in p5_found(spark, str(tmp_path)).collect()}
    assert got == {(i, i + 1) for i in range(0, 24, 2)}


def test_phrases_of_common_words_alone_are_paired(spark, tmp_path):
    rows = [(1, "aa bb experience", "x"), (2, "experience with bb aa", "x"), (3, "aa cc", "x"), (4, "aa dd", "x"), (5, "bb cc", "x"), (6, "bb dd", "x")]
    spark.createDataFrame(rows, "phrase_id BIGINT, atom_norm STRING, head_group STRING").write.parquet(f"{tmp_path}/phrases.parquet")
    assert [tuple(r) for r in p5_found(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_the_embedding_decides_between_uses(spark):
    """A node chooses between its own centre and that of another use of the product; without iterations the choice is chance."""
    both = [(n, u) for n in ("gamutoferali", "brostikenaro", "vipelasodranu") for u in USES]
    rows = [(2 * k, "x", u, n, 3) for k, (n, u) in enumerate(both)] + [(2 * k + 1, "x", u, n[:4] + n[5:], 1) for k, (n, u) in enumerate(both)]
    nodes = spark.createDataFrame(rows, "node BIGINT, block STRING, use STRING, subject STRING, size BIGINT").cache()
    edges = affinities(nodes).cache()

    def groups(rounds):
        by = {}
        for r in spectral_clusters(nodes, edges, rounds).collect():
            by.setdefault(r["cluster"], set()).add(r["node"])
        return {frozenset(x) for x in by.values()}

    settled = groups(8)
    assert settled == {frozenset((2 * k, 2 * k + 1)) for k in range(12)}
    assert groups(0) != settled


def test_pairs_of_a_big_cluster_are_cut_into_parts(spark):
    members = spark.range(50).selectExpr("id", "IF(id < 40, 1L, id) AS cluster")
    assert {tuple(r) for r in pairs_of(members, part=7).collect()} == set(combinations(range(40), 2))


def test_subjects_that_share_letters_only_are_not_compared(spark):
    """600 subjects share a run at one place: 179,700 pairs, of which next to none are two slips apart."""
    r = random.Random(1)
    rows = [(k, "x", "data" + "".join(r.choices("abcdefghijklmnoprstuvz", k=9)), 13) for k in range(600)]
    rows.append((600, "x", rows[0][2][:6] + rows[0][2][7:], 12))
    got = {tuple(p) for p in candidates(spark.createDataFrame(rows, "n BIGINT, block STRING, subject STRING, size INT")).collect()}
    assert (0, 600) in got and len(got) < 600


def test_subject_pairs_are_those_of_brute_force(spark):
    r = random.Random(2)
    texts = set()
    for size in (5, 6, 7, 8, 9, 12, 23, 24, 25, 26, 40):
        for _ in range(4):
            base = "".join(r.choices("abcdefg", k=size))
            for _ in range(8):
                w = list(base)
                for _ in range(r.randint(0, 3)):
                    at = r.randrange(len(w) - 1)
                    kind = r.randrange(4)
                    w[at : at + 2] = [[w[at + 1], w[at]], [w[at]], [w[at], "h", w[at + 1]], ["k", w[at + 1]]][kind]
                texts.add("".join(w))
    rows = [(b, t) for t in sorted(texts) for b in ("x", "y")]
    near = lambda x, y: slips(x, y) <= (2 if min(len(x), len(y)) >= 8 else 1)
    run = lambda x, y: any(x[i : i + 4] == y[j : j + 4] for i in range(len(x) - 3) for j in range(max(0, i - 2), min(i + 3, len(y) - 3)))
    expected = {(x, y) for x, y in combinations(sorted(t for t in texts if len(t) >= 5), 2) if near(x, y) and run(x, y)}
    assert len(expected) > 200
    for long in (4, 9, 24):
        got = [(p["block"], p["x"], p["y"]) for p in subject_pairs(spark.createDataFrame(rows, "block STRING, subject STRING"), long).collect()]
        assert len(got) == len(set(got)) and set(got) == {(b, x, y) for b in ("x", "y") for x, y in expected}
