"""Splitting and decomposing: examples in our own wording, controls, and changes of wording that must not matter."""

import pytest

from millrace.functions.requirements import canon, decompose, route, split_item

SPLITS = [
    ("Knowledge of Haskell, Erlang and Elixir", ["Knowledge of Haskell", "Knowledge of Erlang", "Knowledge of Elixir"]),
    ("Familiar with tools such as Maya or Blender", ["Familiar with Maya", "Familiar with Blender"]),
    ("Bachelor's or Master's degree in Biology or Chemistry", ["Bachelor's degree in Biology", "Bachelor's degree in Chemistry", "Master's degree in Biology", "Master's degree in Chemistry"]),
    ("MSc in Geology or a related field", ["MSc in Geology"]),
    ("Good knowledge of Spanish and Polish", ["Good knowledge of Spanish", "Good knowledge of Polish"]),
    ("Work with payment platforms (Adyen, Stripe)", ["Work with Adyen", "Work with Stripe"]),
    ("Patient, precise and curious", ["Patient", "precise", "curious"]),
    ("Experience with Kafka; knowledge of Flink", ["Experience with Kafka", "knowledge of Flink"]),
    ("Good knowledge of Excel and experience with budgets", ["Good knowledge of Excel", "experience with budgets"]),
    ("Fluent German, ideally Dutch", ["Fluent German", "ideally Dutch"]),
    ("A Bachelor's Degree, Master's Degree or PhD in Botany", ["Bachelor's degree in Botany", "Master's degree in Botany", "PhD degree in Botany"]),
    ("Bachelor of Master in Biologie of gelijkwaardig", ["Bachelor in Biologie", "Master in Biologie"]),
    ("Master's degree in botany with field experience required", ["Master's degree in botany", "field experience"]),
    ("Bachelor's degree in Botany or equivalent experience", ["Bachelor's degree in Botany", "equivalent experience"]),
]
WHOLE = ["Working in a team", "Willingness to travel", "Python for statistics, plots and reports", "Strong communication, both written and spoken", "Trade-offs between cost, time and quality"]


@pytest.mark.parametrize("item, atoms", SPLITS)
def test_split(item, atoms):
    assert split_item(item) == atoms


@pytest.mark.parametrize("item", WHOLE)
def test_left_whole(item):
    assert split_item(item) == [item] and route(item)[1] == "single"


@pytest.mark.parametrize("item", [s for s, _ in SPLITS] + WHOLE)
@pytest.mark.parametrize("change", [lambda s: "- " + s, lambda s: s + ".", lambda s: s.replace(" ", "  "), lambda s: "3) " + s])
def test_marks_do_not_matter(item, change):
    assert split_item(change(item)) == split_item(item)


def test_empty_and_very_long():
    assert split_item(None) == [] and split_item("  ") == [] and route("")[0] == []
    assert len(split_item("; ".join(f"thing {i}" for i in range(5000)))) == 5000


@pytest.mark.parametrize("text, key, head, degree", [
    ("Experience with Fortran", "Fortran", "experience", ""), ("Fortran skills", "Fortran", "competence", ""), ("3+ years of experience in logistics", "logistics", "experience", ""),
    ("Fluent French", "language: French", "language", ""), ("French (B2)", "language: French", "language", ""), ("French cuisine", "French cuisine", "", ""),
    ("M.Sc. in Geology", "education: Master in Geology", "education", "master"), ("Bac+5 in Geology", "education: Master in Geology", "education", "master"), ("PhD", "education: PhD (any field)", "education", "phd"),
    ("BAC+3 minimum", "education: Bachelor (any field)", "education", "bachelor"), ("Bac+2 to Bac+5 in Botany", "education: Degree in Botany", "education", "degree"), ("Bac + 8 in Botany", "education: PhD in Botany", "education", "phd"),
    ("B. Eng. in Botany", "education: Bachelor in Botany", "education", "bachelor"), ("M.A. in Botany", "education: Master in Botany", "education", "master"),
    ("Interest in sailing", "sailing", "", ""), ("Golang", "Go", "", ""), ("You have", "", "", ""), (None, "", "", ""),
])
def test_decompose(text, key, head, degree):
    d = decompose(text)
    assert (d["key"], d["head_group"], d["degree"]) == (key, head, degree)


def test_years_and_levels():
    d = decompose("At least 3-5 years of experience with Cobol")
    assert (d["years_min"], d["years_max"], d["core"]) == (3, 5, "Cobol")
    assert decompose("Very good knowledge of Cobol")["level"] == "good" and decompose("99 years of Cobol")["years_min"] is None


def test_canon_folds_spellings():
    assert canon("Problem-solving") == canon("problem solving") and canon("data platforms") == canon("Data platform") and canon("organisation") == canon("organization")
