import random

import pytest

from millrace.llm.canonical import BKTree, PhraseMatcher, TitleMatcher, levenshtein, match_reference, slips


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distance_and_tree_against_brute_force():
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(0, 8))) for _ in range(200)]
    for _ in range(300):
        a, b = r.choice(words), r.choice(words)
        assert levenshtein(a, b) == plain_distance(a, b)
    tree = BKTree(words)
    for q in words[:40]:
        for radius in (0, 1, 2):
            assert tree.within(q, radius) == sorted((plain_distance(w, q), w) for w in set(words) if plain_distance(w, q) <= radius)


def test_slips_count_an_exchange_once():
    assert (slips("abcd", "abdc"), slips("abcd", "abxc"), slips("abcd", "bacd"), slips("abcd", "dcba")) == (1, 2, 1, 3)


KEYS = [("data engineer", "engineer"), ("key account manager", "manager"), ("e-commerce analyst", "analyst")]


@pytest.mark.parametrize("title, key", [
    ("Senior DATA ENGINEERS (m/w/d) - Porto", "data engineer"), ("engineer for data", "data engineer"), ("Jr key acount mgr II", "key account manager"), ("Key-Account / Manager", "key account manager"),
    ("keyaccount manager", "key account manager"), ("E_COMMERCE analst 80-100%", "e-commerce analyst"), ("Data Beekeeper", None), ("Engineer", None), ("", None), (None, None), ("data " * 2000, None),
])
def test_titles(title, key):
    found = TitleMatcher(KEYS).find(title)
    assert (found and found[1]) == key


CORES = [("sql", 5), ("sql reporting", 2), ("c++", 1), ("c#", 1), ("travel planning", 3), ("route planning", 1)]


@pytest.mark.parametrize("value, core", [
    ("SQL", "sql"), ("good sql", "sql"), ("experience with sql_reporting *", "sql reporting"), ("reporting sql", "sql reporting"), ("sqlreportng!", "sql reporting"), ("C++", "c++"), ("C#", "c#"), ("d#", None),
    ("travel planing (plus)", "travel planning"), ("glass blowing", None), (" ", None), (None, None),
])
def test_phrases(value, core):
    found = PhraseMatcher(CORES).find(value)
    assert (found and found[1]) == core


def test_operator_and_shards(spark, monkeypatch):
    from millrace.llm import canonical

    values = spark.createDataFrame([("sqll reporting", "x"), (None, "y"), ("", "z"), ("sqll reporting", "w"), ("zzz", "q")], "v STRING, canon STRING")
    ref = spark.createDataFrame(CORES, "req_core STRING, n INT")
    got = {r["value"]: (r["canon"], r["distance"]) for r in match_reference(values, "v", ref, ["req_core", "n"], PhraseMatcher).collect()}
    assert got == {"sqll reporting": ("sql reporting", 1), None: ("nuovo", None), "": ("nuovo", None), "zzz": ("nuovo", None)}
    monkeypatch.setattr(canonical, "SHARD", 2)
    assert {r["value"]: (r["canon"], r["distance"]) for r in match_reference(values, "v", ref, ["req_core", "n"], PhraseMatcher).collect()} == got
    assert match_reference(values.limit(0), "v", ref, ["req_core", "n"], PhraseMatcher).count() == 0
    assert {r["canon"] for r in match_reference(values, "v", ref.limit(0), ["req_core", "n"], PhraseMatcher).collect()} == {"nuovo"}


def test_held_out_titles(spark, folder):
    """Mapped titles of the table, whose key is known: at least 98 percent are found as recorded."""
    keys = [tuple(r) for r in spark.read.parquet(f"{folder}/title_dictionary.parquet").select("title_key", "title_group").collect()]
    rows = spark.read.parquet(f"{folder}/titles.parquet").filter("trim(title_key) <> ''").select("title", "title_key").distinct().collect()
    m = TitleMatcher(keys)
    right = sum(((f := m.find(r["title"])) and f[1] or "nuovo") == r["title_key"] for r in rows)
    assert right >= 0.98 * len(rows)


def test_shards_of_the_real_lists_give_the_same(spark, folder):
    """Sixty entries a tree or all in one: the same entry for every value of the tables."""
    values = spark.read.parquet(f"{folder}/requirements.parquet").filter("coalesce(match_status, '') = ''")
    cores = spark.read.parquet(f"{folder}/req_cores.parquet")
    titles, keys = spark.read.parquet(f"{folder}/titles.parquet"), spark.read.parquet(f"{folder}/title_dictionary.parquet")
    for df, column, ref, columns, matcher in ((values, "atom_norm", cores, ["req_core", "n"], PhraseMatcher), (titles, "title", keys, ["title_key", "title_group"], TitleMatcher)):
        one = {tuple(r) for r in match_reference(df, column, ref, columns, matcher).collect()}
        assert len(one) > 10 and {tuple(r) for r in match_reference(df, column, ref, columns, matcher, shard=60).collect()} == one
