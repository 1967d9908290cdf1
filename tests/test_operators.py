"""Relational operators on fixtures with results worked out by hand, and properties that must hold."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import base, dictionary, employers, explorer, graph, groups, process, profiles, runs, sampling, vectors
from millrace.sources import readers, sinks
from millrace.plans import q_groups, q_profiles, q_runs, q_text
from millrace.streaming import admission


def test_waterfall_counts_what_earlier_steps_left(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "A", ""), (3, "", ""), (4, "B", "y"), (5, None, "z")], "id INT, a STRING, b STRING")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    out = base.waterfall(df, [("a", blank("a")), ("b", blank("b")), ("null test", F.col("a") == "B")]).collect()
    assert [(r["step"], r["removed"], r["remaining"]) for r in out] == [("a", 3, 2), ("b", 1, 1), ("null test", 1, 0)]


def test_repeats_treat_null_keys_as_a_group(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 2), (3, "k", 1)], "id INT, k STRING, t INT")
    out = {r["id"]: (r["repeat_group_size"], r["repeat_weight"], r["is_repeat_first"]) for r in base.mark_repeats(df, ["k"], ["t"]).collect()}
    assert out == {1: (2, 0.5, False), 2: (2, 0.5, True), 3: (1, 1.0, True)}
    assert sorted(r["id"] for r in base.collapse_repeats(df, ["k"], ["t"]).collect()) == [2, 3]


def test_bands_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (99.0,), (None,)], "x DOUBLE")
    assert [r["b"] for r in df.select(base.band(F.col("x"), [2, 10], ["low", "mid", "high"]).alias("b")).collect()] == ["low", "low", "mid", "high", None]


def _toy(spark):
    rows = [("f", c, k, p) for c, ps in (("x", range(30)), ("y", range(30, 60))) for p in ps for k in (["all"] + (["left"] if c == "x" else []) + (["half"] if p % 2 else []))]
    return spark.createDataFrame(rows, "fn STRING, cell STRING, k STRING, posting INT")


def test_lift_and_verdicts(spark):
    out = {(r["cell"], r["k"]): r for r in profiles.core_shell(_toy(spark), "fn", "cell", "k").collect()}
    assert out["x", "left"]["lift"] == 2.0 and out["x", "left"]["verdict"] == "shell"
    assert out["y", "half"]["lift"] == 1.0 and out["y", "half"]["verdict"] == "core"
    assert ("y", "left") not in out


def test_distances_are_symmetric_and_bounded(spark):
    shares = profiles.cell_profiles(_toy(spark), "cell", "k", "posting")
    d = profiles.profile_distances(shares, "cell", "k").first()
    p, q = {"all": 1 / 2.5, "left": 1 / 2.5, "half": 0.5 / 2.5}, {"all": 1 / 1.5, "left": 0.0, "half": 0.5 / 1.5}
    js = math.sqrt(sum(0.5 * (a * math.log2(2 * a / (a + b)) if a else 0) + 0.5 * (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in ((p[k], q[k]) for k in p)))
    assert d["js"] == pytest.approx(js) and 0 <= d["overlap"] <= 1 and 0 <= d["cosine"] <= 1
    same = spark.createDataFrame([("a", "k", 1.0), ("b", "k", 0.5), ("c", "z", 1.0)], "cell STRING, k STRING, share DOUBLE")
    out = {(r["cell_a"], r["cell_b"]): r["js"] for r in profiles.profile_distances(same, "cell", "k").collect()}
    assert out["a", "b"] == 0.0 and out["a", "c"] == 1.0


def test_bootstrap_surrounds_the_estimate(spark, folder):
    from millrace.plans.star import facts

    f = facts(spark, folder)
    point = profiles.grouped_index(profiles.cell_shares(f, "fn", "industry", "type"), ["fn"], "industry", "type").agg(F.avg("js")).first()[0]
    draws = profiles.bootstrap_index(f, "fn", "industry", "type", "posting", 10, 3)
    assert draws.count() == 30 and draws.agg(F.min("js")).first()[0] >= 0
    assert draws.agg(F.avg("js")).first()[0] == pytest.approx(point, abs=0.1)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(1000, 1001)], "a INT, b INT")
    out = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert len(out) == n + 2 and all(out[i] == 1 for i in range(1, n + 1)) and out[1001] == 1000
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_component_guard_and_aliases(spark):
    comp = graph.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a INT, b INT"))
    assert graph.guard_sizes(comp, 3).count() == 3
    with pytest.raises(Exception, match="component too large"):
        graph.guard_sizes(comp, 2).count()
    alias = graph.representatives(comp, spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "node INT, weight INT"))
    df = spark.createDataFrame([(1, "a"), (7, "b")], "k INT, v STRING")
    once = graph.apply_aliases(df, "k", alias)
    assert sorted(map(tuple, once.collect())) == [(2, "a"), (7, "b")]
    assert sorted(map(tuple, graph.apply_aliases(once, "k", alias).collect())) == [(2, "a"), (7, "b")]


def test_leader_clustering_is_greedy_by_id(spark):
    rows = [("c", 1, ["a", "b", "c"]), ("c", 2, ["a", "b", "c", "d"]), ("c", 3, ["x"]), ("c", 4, ["a", "b", "c"])]
    sets = spark.createDataFrame(rows, "company STRING, posting INT, items ARRAY<STRING>")
    assert sorted(r["posting"] for r in employers.dedup_leader(sets, "company", "posting", 0.75).collect()) == [1, 3]
    assert sorted(r["posting"] for r in employers.dedup_leader(sets, "company", "posting", 0.8).collect()) == [1, 2, 3]


def test_gini_by_hand(spark):
    out = employers.gini(spark.createDataFrame([(1,), (1,), (1,), (7,)], "n INT"), "n").first()
    x = [1, 1, 1, 7]
    assert out["gini"] == pytest.approx(sum((2 * i - 5) * v for i, v in enumerate(x, 1)) / (4 * 10)) and out["top_25_pct"] == 0.7


def test_vectors_ties_zero_and_missing(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "e INT, v ARRAY<DOUBLE>")
    df = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0])], "k INT, v ARRAY<DOUBLE>")
    out = vectors.best_two(df, "k", "v", entries, "e", "v").collect()
    assert [(r["k"], r["best"], r["best_cos"], r["second_cos"]) for r in out] == [(1, 1, 1.0, 1.0)]
    assert vectors.margin_type(spark.createDataFrame(out)).first()["type"] is None


def test_entries_in_blocks_give_the_same(spark, folder, monkeypatch):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    cents = vectors.centroids(rows, "label", "embedding")
    whole = {tuple(r) for r in vectors.best_two(rows, "vec_id", "embedding", cents, "label", "centroid").collect()}
    monkeypatch.setattr(vectors, "SMALL_SIDE", 2000)
    monkeypatch.setattr(vectors, "TILE", 500)
    assert {tuple(r) for r in vectors.best_two(rows, "vec_id", "embedding", cents, "label", "centroid").collect()} == whole


def test_one_hop_goes_up_once(spark):
    nodes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 3)], "id STRING, n INT")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d")], "a STRING, b STRING")
    assert {r["id"]: r["target"] for r in vectors.one_hop(nodes, pairs).collect()} == {"a": "a", "b": "a", "c": "b", "d": "b"}


def test_event_replay_and_drift(spark):
    log = spark.createDataFrame([("k", 1, "resolved"), ("k", 2, "rejected"), ("k", 3, "detected"), ("m", 1, "rejected"), ("m", 2, "resolved")], "key STRING, at INT, status STRING")
    assert [r["key"] for r in runs.replay(log, "key", ["at"], "status", "resolved", "rejected").collect()] == ["m"]
    lights = spark.createDataFrame([("r", i, l) for i, l in enumerate(["red", "yellow", "red", "green", "red", "red"])], "run STRING, at INT, light STRING")
    assert [r["at"] for r in runs.drift(lights, "run", "at", "light").filter("drift").collect()] == [2]


def test_statistics_against_closed_forms(spark):
    row = spark.createDataFrame([(3, 20, 0.1)], "k INT, n INT, p DOUBLE")
    tail = sum(math.comb(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(3, 21))
    assert row.select(runs.binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("t")).first()["t"] == pytest.approx(tail)
    low, high = runs.wilson(F.col("k"), F.col("n"))
    out = row.select(low.alias("l"), high.alias("h")).first()
    assert 0 < out["l"] < 0.15 < out["h"] < 0.5
    votes = spark.createDataFrame([(True, True)] * 40 + [(False, False)] * 40 + [(True, False)] * 20, "t BOOLEAN, j BOOLEAN")
    k = runs.kappa(votes, "t", "j").first()
    assert k["agreement"] == 0.8 and k["kappa"] == pytest.approx((0.8 - (0.6 * 0.4 + 0.4 * 0.6)) / (1 - (0.6 * 0.4 + 0.4 * 0.6)))
    assert runs.kappa(votes.limit(3), "t", "j").first()["kappa"] is None


def test_dictionary_refuses_two_groups_and_edits(spark, tmp_path):
    facts = spark.createDataFrame([("", "python", "Python", "t"), ("", "python", "Python", "t"), ("", "sql", "SQL", "t")], "s STRING, c STRING, g STRING, t STRING")
    frozen = dictionary.freeze(facts, "s", "c", "g", "t")
    assert {(r["req_core"], r["n"]) for r in frozen.collect()} == {("python", 2), ("sql", 1)}
    with pytest.raises(Exception, match="more than one group"):
        dictionary.freeze(facts.union(spark.createDataFrame([("", "sql", "Other", "t")], facts.schema)), "s", "c", "g", "t").count()
    manifest = sinks.write_dictionary(spark, str(tmp_path), "1", {"req_cores": frozen}, {"note": "x"})
    again, tables = sinks.load_dictionary(spark, str(tmp_path), "1")
    assert again == manifest and tables["req_cores"].count() == 2
    with pytest.raises(Exception):
        sinks.write_dictionary(spark, str(tmp_path), "1", {"req_cores": frozen}, {})
    part = next(p for p in (tmp_path / "1" / "req_cores.parquet").iterdir() if p.suffix == ".parquet")
    part.with_name(f".{part.name}.crc").unlink()  # the file system's own check would speak first
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="edited"):
        sinks.load_dictionary(spark, str(tmp_path), "1")


def test_dictionary_diff_fates(spark):
    old = spark.createDataFrame([("", "a", 5, "G"), ("", "b", 5, "G"), ("", "c", 1, "H"), ("", "d", 1, "I"), ("", "e", 1, "J")], "req_space STRING, req_core STRING, n INT, req_group STRING")
    new = spark.createDataFrame([("", "a", 5, "G"), ("", "b", 5, "K"), ("", "c", 1, "L"), ("", "d", 1, "I")], old.schema)
    assert {r["old_group"]: r["fate"] for r in dictionary.diff(old, new).collect()} == {"G": "split", "H": "renamed", "I": "same", "J": "gone"}


def test_lookup_stages(spark):
    entries = spark.createDataFrame([("", "data platform", "D", "t"), ("", "sql", "SQL", "t"), ("", "a-b", "X", "t"), ("", "a b", "Y", "t")], "req_space STRING, req_core STRING, req_group STRING, req_topic STRING")
    values = spark.createDataFrame([("", "sql"), ("", "Data-Platforms"), ("", "A_B"), ("", "structured query"), ("", " "), ("", None), ("", "zz")], "space STRING, core STRING")
    alias = spark.createDataFrame([("", "structured query", "SQL")], "space STRING, variant STRING, target_group STRING")
    out = {r["core"]: (r["match"], r["via"], r["group"]) for r in dictionary.lookup(values, "space", "core", entries, alias).collect()}
    assert out == {"sql": ("known", "exact", "SQL"), "Data-Platforms": ("known", "canon", "D"), "A_B": ("nuovo", "none", None), "structured query": ("known", "alias", "SQL"), " ": ("empty", "none", None), None: ("empty", "none", None), "zz": ("nuovo", "none", None)}


def test_explorer_pieces(spark):
    df = spark.createDataFrame([("A b", 1), ("a-B", 2), ("é!", 3)], "name STRING, pos INT")
    assert {r["name"]: r["slug"] for r in explorer.slugs(df, "name", "pos").collect()} == {"A b": "a-b", "a-B": "a-b-2", "é!": ""}
    rows = spark.createDataFrame([("r", i, k) for i in range(10) for k in (["x"] if i else []) + (["y"] if i < 2 else [])], "role STRING, ad INT, obj STRING")
    out = {(r["ad"], r["obj"]): r["verdict"] for r in explorer.loo_verdicts(rows, "role", "ad", "obj").collect()}
    assert out[5, "x"] == "standard" and out[0, "y"] == "common"
    assert [(r["ad"], r["obj"]) for r in explorer.expected_missing(rows, "role", "ad", "obj").collect()] == [(0, "x")]


def test_splits_are_stable_and_balanced(spark):
    df = spark.range(2000).selectExpr("id", "id % 2 AS s")
    a = sampling.hash_split(df, "id", 0.3, "x")
    assert 500 < a.filter("part = 'holdout'").count() < 700
    assert a.exceptAll(sampling.hash_split(df.repartition(7), "id", 0.3, "x")).count() == 0
    b = sampling.alternating_split(df, "id", ["s"], "x")
    assert b.filter("part = 'holdout'").count() == 1000


def test_greedy_matching(spark):
    df = spark.createDataFrame([(["a b", "c d"], ["c d", "a b x"]), (["q"], []), (None, ["z"])], "p ARRAY<STRING>, t ARRAY<STRING>")
    assert [r["m"] for r in df.select(sampling.greedy_matches("p", "t").alias("m")).collect()] == [2, 0, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  • Größe, ÉTÉ; ", None)], "a STRING, b STRING")
    out = df.select(T.normalise(F.col("a")).alias("n"), T.clean(F.col("a")).alias("c"), T.normalise(F.col("b")).alias("nn"), T.detect_language(F.col("b")).alias("d")).first()
    assert (out["n"], out["c"], out["nn"], out["d"]) == ("große ete", "Größe, ÉTÉ", None, None)
    cells = spark.createDataFrame([('["a", "b"]',), ("a\nb",), ("a | b",), ("a;b; ",)], "c STRING")
    assert all(r["x"] == ["a", "b"] for r in cells.select(T.cell_items(F.col("c")).alias("x")).collect())
    opt = spark.createDataFrame([([True, False],), ([True, True],)], "o ARRAY<BOOLEAN>")
    assert [r["c"] for r in opt.select(T.counted(F.col("o")).alias("c")).collect()] == [[False, True], [True, True]]


def test_process_keeps_order_and_is_stable_under_bullets_and_stops(spark):
    rows = [(1, ["- Good knowledge of Rust and Ada.", "English and German"]), (2, ["Good knowledge of Rust and Ada", "  "]), (3, None), (4, [])]
    out = process.process(spark.createDataFrame(rows, "posting_row INT, must_have ARRAY<STRING>")).collect()
    keys = {p: [r["key"] for r in sorted(out, key=lambda r: (r["item_idx"], r["atom_idx"])) if r["posting"] == p] for p in (1, 2)}
    assert keys == {1: ["Rust", "Ada", "language: English", "language: German"], 2: ["Rust", "Ada"]}


def test_cache_is_asked_for_new_pairs_only(spark):
    asked = []

    def call(df):
        rows = [r["text"] for r in df.collect()]
        asked.extend(rows)
        return spark.createDataFrame([(t, t.upper()) for t in rows], "text STRING, english STRING")

    cache = spark.createDataFrame([("a", "A")], "text STRING, english STRING")
    every, fresh = process.through_cache(spark.createDataFrame([("a",), ("b",), ("b",)], "text STRING"), cache, call, ["text"], "english")
    assert sorted(r["english"] for r in every.collect()) == ["A", "B"] and set(asked) == {"b"} and fresh.count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "raw.json").write_text('[{"vacancy_id": "1", "confidence": "0.5", "expired": "True", "created_at": "2026-05-01 10:00:00"}, {"vacancy_id": "2", "confidence": "x", "expired": "maybe", "created_at": "soon"}]')
    rows = {r["vacancy_id"]: r for r in readers.raw_export(spark, {"F": str(tmp_path / "raw.json")}).collect()}
    assert rows["1"]["confidence"] == 0.5 and rows["1"]["expired"] is True and rows["1"]["macro_function"] == "F" and rows["1"]["company"] == ""
    assert rows["2"]["confidence"] is None and rows["2"]["expired"] is None and rows["2"]["created_at"] is None
    (tmp_path / "labels.csv").write_text('ConceptURI,Preferred_Label,altLabels\nu1,one,"uno|eins"\nu2,two,\n')
    assert {(r["uri"], r["label"], r["kind"]) for r in readers.label_list(spark, str(tmp_path / "labels.csv")).collect()} == {("u1", "one", "preferred"), ("u1", "uno", "alternative"), ("u1", "eins", "alternative"), ("u2", "two", "preferred")}
    (tmp_path / "t.xml").write_text('<r xmlns:skos="s" xmlns:rdf="r"><skos:Concept rdf:about="u1"><skos:prefLabel xml:lang="en">one</skos:prefLabel><skos:altLabel xml:lang="de">eins</skos:altLabel></skos:Concept><skos:Concept rdf:about="u2"><status>obsolete</status><skos:prefLabel xml:lang="en">two</skos:prefLabel></skos:Concept></r>')
    assert {(r["uri"], r["label"], r["language"]) for r in readers.taxonomy_xml(spark, str(tmp_path / "t.xml"), ["en", "de"]).collect()} == {("u1", "one", "en"), ("u1", "eins", "de")}
    (tmp_path / "lines.jsonl").write_text('{"id": "1", "must_have": ["a"]}\nnot json\n')
    good, bad = readers.posting_lines(spark, str(tmp_path / "lines.jsonl"))
    assert [r["id"] for r in good.collect()] == ["1"] and [r["line"] for r in bad.collect()] == ["not json"]
    assert readers.resolve_column(["ConceptUri", "x"], ["uri"]) == "ConceptUri"


def test_csv_and_history(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b')], "n INT, t STRING")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["t"] == 'a "q", b'
    with pytest.raises(ValueError, match="nested"):
        sinks.write_csv(df.select(F.array("n").alias("a")), str(tmp_path / "d"))
    for _ in range(2):
        sinks.append_history(df, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 2


def test_admission_counts_an_advert_once_over_batches(spark, tmp_path):
    schema = "posting_row BIGINT, id STRING, title STRING, job STRING, must_have ARRAY<STRING>"
    src, place = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "x", "t", "j", ["a"]), (2, "x", "t", "j", ["a"]), (3, None, "t", "j", ["b"])], schema).coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    admission.admit(read(), place)
    assert spark.read.parquet(f"{place}/adverts").count() == 2
    spark.createDataFrame([(4, "x", "t", "j2", ["c"]), (5, "y", "t", "j2", ["c"])], schema).coalesce(1).write.mode("append").parquet(str(src))
    admission.admit(read(), place)
    assert sorted(r["posting_row"] for r in spark.read.parquet(f"{place}/adverts").collect()) == [1, 3, 5]


def test_overlap_through_frequent_words(spark):
    """Every word stands in more than a tenth of the groups; all pairs are found all the same."""
    sets = {f"g{i:02}": {f"w{j}" for j in range(12) if (i * 7 + j * 5) % 4 < 2 or (i + j) % 5 == 0} for i in range(24)}
    rows = spark.createDataFrame([(g, w) for g, s in sets.items() for w in s], "g STRING, t STRING")
    expected = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b}
    got = {(r["a"], r["b"]): r["jaccard"] for r in groups.vocabulary_overlap(rows, "g", "t", 0.25).collect()}
    assert got == {p: j for p, j in expected.items() if j >= 0.25} and got


def test_jobs_are_judged_on_their_own_counts(spark, tmp_path):
    rows = [("a", "damaged" if i < 119 else "rules") for i in range(2694)] + [("b", "damaged" if i < 40 else "rules") for i in range(400)] + [("c", "rules")] * 5
    spark.createDataFrame(rows, "job STRING, route STRING").write.parquet(f"{tmp_path}/requirements.parquet")
    light = {r["job"]: (r["flagged"], r["answered"], r["light"]) for r in q_runs.judge_light(spark, str(tmp_path)).collect()}
    assert light == {"a": (119, 2694, "green"), "b": (40, 400, "red"), "c": (0, 5, "grey")}
    tail = {r["job"]: (r["k"], r["tail"]) for r in q_runs.binomial_tail(spark, str(tmp_path)).collect()}
    exact = lambda n, k: float(1 - sum(math.comb(n, i) * Fraction(1, 25) ** i * Fraction(24, 25) ** (n - i) for i in range(k)))
    assert {j: k for j, (k, _) in tail.items()} == {"a": 119, "b": 40, "c": 0}
    assert tail["a"][1] == pytest.approx(exact(2694, 119), abs=2e-9) and tail["b"][1] == pytest.approx(exact(400, 40), abs=2e-9) and tail["c"][1] == 1.0
    far = spark.createDataFrame([(200_000, 8_000)], "n INT, k INT").select(runs.binomial_tail(F.col("n"), F.col("k"), F.lit(0.04)).alias("t")).first()["t"]
    assert 0.45 < far < 0.55  # (1 - p) ^ n alone would be 0


def test_components_use_all_lines(spark, tmp_path):
    rows = [(1, 10, 1, 5.0), (1, 11, 2, 1.0), (1, 12, 5, 50.0), (2, 12, 7, 2.0), (2, 13, 1, 3.0), (3, 20, 1, 50.0), (4, 30, 1, 1.0), (4, 31, 3, 1.0)]
    spark.createDataFrame(rows, "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in q_groups.connected_components(spark, str(tmp_path)).collect()} == {(10, 10), (11, 10), (12, 10), (13, 10), (30, 30), (31, 30)}


def test_every_industry_counts(spark, monkeypatch):
    rows = [(f"{i}{n}{p}", f"{i}{n}{p % 7}", i, n, "1", c, c) for i in ("MACHINERY", "BUILDING") for n in "XYZ" for p in range(60) for c in ("k", n if p % 2 else "l") if not (p == 0 and c == "k")]
    df = spark.createDataFrame(rows, "posting STRING, company STRING, industry STRING, nation STRING, level STRING, cluster STRING, type STRING")
    for q in (q_groups, q_text, q_profiles):
        monkeypatch.setattr(q, "facts", lambda *_: df)
    unit = {(r["industry"], r["cluster"]): r["posting_share"] for r in q_groups.employer_unit(spark, "").collect()}
    assert len(unit) == 10 and unit["BUILDING", "k"] == round(177 / 180, 6) and unit["MACHINERY", "l"] == 0.5
    missing = {tuple(r) for r in q_text.expected_missing(spark, "").collect()}
    expected = {(p, "k") for p in {f"{i}{n}0" for i in ("MACHINERY", "BUILDING") for n in "XYZ"}} | {(f"{i}{n}{p}", "l") for i in ("MACHINERY", "BUILDING") for n in "XYZ" for p in range(1, 60, 2)}
    assert missing == expected
    kept = {(r["industry"], r["origin"], r["target"]): r["kept"] for r in q_profiles.geo_overlap(spark, "").collect()}
    assert len(kept) == 12 and set(kept.values()) == {round((59 / 60 + 0.5) / (59 / 60 + 1), 6)}
