"""Every query with SQL gives the same rows as DuckDB over the same tables; the others run and keep their schema."""

import re
from collections import Counter

import pandas as pd
import pytest

from millrace.functions.requirements import decompose, route
from millrace.functions.wording import INSPECTIONS
from millrace.plans import catalogue
from tests.compare import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n in catalogue.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, folder))
    sql_columns, expected = sql_rows(catalogue.ORACLES[name], folder)
    assert columns == sql_columns
    assert rows == expected


def texts(folder, name, column):
    return sorted({t for t in pd.read_parquet(f"{folder}/{name}.parquet")[column] if t is not None})


def leaders(folder):
    """The greedy rule of content_dedup_leader, employer by employer."""
    line, part, orders = (pd.read_parquet(f"{folder}/{n}.parquet") for n in ("lineitem", "part", "orders"))
    joined = line.merge(part, left_on="l_partkey", right_on="p_partkey").merge(orders, left_on="l_orderkey", right_on="o_orderkey")
    kept = {}
    for (company, posting), items in joined.groupby(["o_custkey", "o_orderkey"])["p_type"].agg(frozenset).items():
        if not any(len(items & k) / len(items | k) >= 0.75 for _, k in kept.get(company, [])):
            kept.setdefault(company, []).append((posting, items))
    return {(c, p) for c, l in kept.items() for p, _ in l}


def plain(text):
    out = re.sub(r"(?i)^\s*(?:(?:the\s+)?(?:candidate|applicant)s?\s+|you\s+|we\s+expect\s+)?(?:must\s+|should\s+|will\s+)?(?:be|are|is|have|has|having|bring)\s+(?:able\s+to\s+)?", "", text)
    return re.sub(r"\s+", " ", re.sub(r"(?i)\b(experience|knowledge)\s+(?:of|with|in)\s+\1\b", r"\1", out)).strip(" ")


def inspected(folder):
    rows = pd.read_parquet(f"{folder}/requirements.parquet")
    flags = [next((n for n, p in INSPECTIONS if re.search(p, c or "")), "none") for c in rows["core"]]
    return Counter(zip(rows["route"], flags, strict=True))


#: The rows of the queries without SQL, worked out in plain Python.
EXPECTED = {
    "split_items": lambda f: {(t, tuple(route(t)[0]), route(t)[1]) for t in texts(f, "requirements", "item")},
    "decompose": lambda f: {(t, *(decompose(t)[k] for k in ("years_min", "years_max", "level", "head_group", "degree", "core", "extra", "space", "key"))) for t in texts(f, "requirements", "atom_norm")},
    "plain_requirements": lambda f: {(t, plain(t)) for t in texts(f, "requirements", "item") if plain(t) != t},
    "inspections": lambda f: {(r, n, c) for (r, n), c in inspected(f).items()},
    "content_dedup_leader": leaders,
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_same_rows_as_python(spark, folder, name):
    rows = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in catalogue.QUERIES[name](spark, folder).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == EXPECTED[name](folder)


def test_pipeline_against_its_parts(spark, folder):
    """process_postings: the atoms of every item in order, each with the fields of its text; unsplit_items: those left whole."""
    rows = catalogue.QUERIES["process_postings"](spark, folder).toPandas()
    per = rows.sort_values("atom_idx").groupby(["posting", "item_idx"])
    assert len(per) > 100
    for _, part in per:
        atoms, how = route(part["item"].iloc[0])
        assert part["atom"].tolist() == atoms and set(part["route"]) == {how} and part["core"].tolist() == [decompose(a)["core"] for a in atoms]
        assert part[part["first"]]["key"][lambda k: k != ""].is_unique
    assert {r[0] for r in catalogue.QUERIES["unsplit_items"](spark, folder).collect()} == set(rows[rows["route"] == "llm"]["item"])


def test_scores_are_shares(spark, folder):
    for name in ("greedy_match", "probe_levels"):
        rows = catalogue.QUERIES[name](spark, folder).collect()
        assert rows and all(0 <= v <= 1 for r in rows for v in r.asDict().values() if isinstance(v, float))


def test_every_query_is_tested():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {*EXPECTED, "process_postings", "unsplit_items", "greedy_match", "probe_levels"}


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
