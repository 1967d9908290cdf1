"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.packed import explode_packed
from millrace.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of every atom that holds at least two, numbered in reading order."""
    atoms = table(spark, folder, "requirements").select("req_id", "atom")
    out = explode_packed(atoms, "atom", "atom_idx", "value", least=2)
    return out.selectExpr("req_id", "atom_idx", "value AS atom").distinct()


QUERIES = {"p4_found": p4_found}
#: The same by a machine that walks every distinct atom letter by letter: q is the quote it stands in, d the bracket depth.
_WALK = r"""
WITH RECURSIVE a AS (SELECT DISTINCT atom FROM requirements WHERE atom IS NOT NULL),
m(atom, i, q, d, o) AS (
  SELECT atom, 1, '', 0, '' FROM a
  UNION ALL
  SELECT atom, i + 1,
    CASE WHEN d > 0 THEN q WHEN q = '' AND c = '"' AND NOT before THEN '"' WHEN q = '"' AND c = '"' THEN '' WHEN q = '' AND c = chr(39) AND NOT before THEN chr(39) WHEN q = chr(39) AND c = chr(39) AND NOT after THEN ''
      WHEN q = '' AND c IN ('„', '«') THEN c WHEN q = '„' AND c IN ('“', '”') THEN '' WHEN q = '«' AND c = '»' THEN '' ELSE q END,
    CASE WHEN q <> '' THEN d WHEN c IN ('(', '[') THEN d + 1 WHEN c IN (')', ']') THEN greatest(d - 1, 0) ELSE d END,
    o || CASE WHEN q <> '' OR d > 0 THEN c WHEN c IN (';', '|', chr(10), chr(13), chr(9), '•', '·') THEN chr(1) WHEN c = ',' AND NOT (p BETWEEN '0' AND '9' AND n BETWEEN '0' AND '9') THEN chr(1)
      WHEN c = '/' AND p IN (' ', chr(10), chr(9)) AND n IN (' ', chr(10), chr(9)) THEN chr(1) ELSE c END
  FROM (SELECT *, atom[i] AS c, CASE WHEN i > 1 THEN atom[i - 1] ELSE '' END AS p, atom[i + 1] AS n,
      i > 1 AND regexp_matches(atom[i - 1], '^[\p{L}\p{N}]$') AS before, regexp_matches(atom[i + 1], '^[\p{L}\p{N}]$') AS after FROM m WHERE i <= length(atom))
),
w AS (SELECT atom, list_transform(string_split(o, chr(1)), lambda v: trim(v, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS v FROM m WHERE i = length(atom) + 1),
u AS (SELECT atom, list_filter(list_transform(v, lambda x: trim(CASE WHEN length(x) < 2 THEN x WHEN x[1] = '"' AND x[-1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"')
      WHEN x[1] = chr(39) AND x[-1] = chr(39) THEN replace(substr(x, 2, length(x) - 2), chr(39) || chr(39), chr(39))
      WHEN (x[1] = '„' AND x[-1] IN ('“', '”')) OR (x[1] = '«' AND x[-1] = '»') THEN substr(x, 2, length(x) - 2) ELSE x END)), lambda x: x <> '') AS v FROM w),
r AS (SELECT atom, unnest(range(0, len(v))) AS atom_idx, unnest(v) AS value FROM u WHERE len(v) >= 2)
SELECT DISTINCT req_id, r.atom_idx::INT AS atom_idx, value AS atom FROM requirements JOIN r ON requirements.atom = r.atom
"""

ORACLES: dict[str, str] = {"p4_found": _WALK}
