"""The queries of this package: the same rows as DuckDB where there is SQL, and the stated columns."""

import pytest

from millrace.llm import queries
from tests.compare import spark_rows, sql_rows

COLUMNS = {
    "p1_found": ["group_a", "group_b"], "p2_found": ["posting_row", "item_idx", "lang"], "p3_found": ["vec_a", "vec_b"], "p5_found": ["phrase_a", "phrase_b"], "p6_found": ["kept_row", "posting_row"],
    "p7_found": ["field", "row_id", "canon"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind", "found"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, folder))
    sql_columns, expected = sql_rows(queries.ORACLES[name], folder)
    assert (columns, rows) == (sql_columns, expected)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLES))
def test_runs_with_distinct_rows(spark, folder, name):
    df = queries.QUERIES[name](spark, folder).cache()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.count() == df.distinct().count()
    assert df.count() > 0
