"""Wording, review and resampling functions on fixtures worked out by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import wording as W
from millrace.operators import profiles, review, sampling


def one(spark, column, *values):
    """The column over rows of the given texts, t being the first and u the second of each."""
    rows = [v if isinstance(v, tuple) else (v, None) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, "t STRING, u STRING").select(column).collect()]


def test_bare_heads(spark):
    assert one(spark, W.bare_head(F.col("t")), "Experience", " etc ", "gute", "Cobol", "knowledge of Cobol", None) == ["noun", "filler", "adjective", None, None, None]


def test_display(spark):
    assert one(spark, W.display(F.col("u"), F.col("t")), ("analytical", ""), ("team work", ""), ("Polish", "language"), ("Cobol", None), ("", "")) == ["Analytical skills", "Team work", "Polish", "Cobol", ""]


def test_plain_requirement(spark):
    assert one(spark, W.plain_requirement(F.col("t")), "You are able to sail", "The candidate must have patience", "Experience of experience of sales", "Cobol", None) == ["sail", "patience", "Experience of sales", "Cobol", None]


def test_repaired_translations(spark):
    assert one(spark, W.repaired(F.col("t"), F.col("u")), ("Maîtrise de Cobol", "Master's degree in Cobol"), ("Bachillerato", "Baccalaureate"), ("Führerschein B", "Leader note B"), ("Kenntnisse", "Knowledge")) == ["mastery of Cobol", "high school diploma", "driving licence B", "Knowledge"]


def test_role_alternatives(spark):
    assert one(spark, W.role_alternatives(F.col("t")), "Data or Software engineer", "Sales / Key Account managers", "Data engineer", None) == [["Data engineer", "Software engineer"], ["Sales manager", "Key Account manager"], [], []]


def test_title_and_core_variants(spark):
    assert one(spark, W.title_variants(F.col("t")), "Web Developers") == [["developer web", "#webdevelopers", "engineer web"]]
    got = one(spark, W.core_variants(F.col("t")), "Cobol 85", "Cobol (mainframe)", "Cobol language", "Cobol")
    assert [[tuple(x) for x in g] for g in got] == [[("version", "Cobol")], [("bracket", "Cobol")], [("generic", "Cobol")], []]


@pytest.mark.parametrize("core, flag", [
    ("", "empty"), (None, "empty"), ("mail a@b.example", "address"), ("Cobol (", "open_bracket"), ("3, 4", "figures_only"), ("and Cobol", "leads_with_joint"), ("Cobol and", "ends_with_joint"), ("with Cobol", "leads_with_preposition"),
    ("Cobol 3 years", "years_left"), ("good Cobol", "level_left"), ("Cobol cobol", "said_twice"), ("a b c d e f g h i j", "sentence"), ("Cobol; Fortran", "several"), ("Cobol", None),
])
def test_inspection(spark, core, flag):
    assert one(spark, W.inspection(F.col("t")), core) == [flag]


def test_further_language(spark):
    got = one(spark, W.further_language(F.col("t")), "erfarenhet och kunskap", "och att", "Cobol", None)
    assert [g and tuple(g) for g in got] == [("sv", 3), None, None, None]


def test_held_out_lookup(spark):
    rows = [(f"p{i}", f"c{i % 3}", f"g{i % 3}") for i in range(200)] + [("q", "only here", "g9")]
    df = spark.createDataFrame(rows, "posting STRING, core STRING, grp STRING")
    got = {(r["status"], r["same"]): r["n"] for r in review.held_out_lookup(df, "posting", "core", "grp", 0.3, "s").collect()}
    held = {p for p, *_ in rows if int(hashlib.sha256(f"s|{p}".encode()).hexdigest()[:8], 16) < int(0.3 * 2**32)}
    assert got.get(("known", True)) == len(held - {"q"}) and got.get(("new", None), 0) == len(held & {"q"})


def test_nearest_per_entry_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in r.standard_normal(6)]) for i in range(60)] + [(98, None), (99, [0.0] * 6)], "id INT, v ARRAY<DOUBLE>")
    whole = {tuple(x) for x in review.nearest_per_entry(rows, "id", "v", rows, "id", "v", 4, own=True).collect()}
    assert len(whole) == 240 and not any(a == b for a, b, *_ in whole)
    monkeypatch.setattr(review, "SMALL_SIDE", 1500)
    monkeypatch.setattr(review, "TILE", 900)
    assert {tuple(x) for x in review.nearest_per_entry(rows, "id", "v", rows, "id", "v", 4, own=True).collect()} == whole


def test_gate_and_routing(spark):
    rows = spark.createDataFrame([(True, True, 5), (True, False, 7), (False, True, 11), (False, False, 13)], "sent BOOLEAN, needed BOOLEAN, mass INT")
    got = review.routing_score(rows, F.col("sent"), F.col("needed"), F.col("mass")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["missed"], got["precision"], got["recall"]) == (1, 1, 1, 1, 11, 0.5, 0.5)
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", None), ("d", 1.0)], "metric STRING, value DOUBLE")
    assert {r["metric"]: r["passed"] for r in review.gate(scores, "metric", "value", {"a": 0.5, "b": 0.5, "c": 0.5}).collect()} == {"a": True, "b": False, "c": False}


def test_draw_weights_are_poisson():
    w = profiles.draw_weights([str(i) for i in range(400)], 100, 3)
    assert w.shape == (400, 100) and w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.05)
    assert (w[:, :16] == profiles.draw_weights([str(i) for i in range(400)], 16, 3)).all()


def test_value_at_a_rank(spark):
    r = np.random.default_rng(5)
    values = [int(x) for x in r.integers(-10**15, 10**15, 500)] + [7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    for rank in (0, 1, 250, 502):
        assert sampling.at_rank(df, "v", rank) == sorted(values)[rank]


def test_top_up_and_pairs(spark):
    pool = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(20)], "id INT, cell STRING")
    quota = review.pairs_per_cell(pool, ["cell"], ["id"], 2, "q").select("id", "cell")
    out = review.topped_up(quota, pool, "id", 9, "t")
    assert quota.count() == 4 and out.count() == 9 and out.select("id").distinct().count() == 9
    assert review.topped_up(quota, pool, "id", 2, "t").count() == 4
