"""Several values packed in one field: one row per value, position kept.

Method: the field is split on its quoted (or bracketed) spans. The spans are the odd pieces and stay literal; the pieces
between them are even and are cut at delimiters. Array folds put both back together and number the values. Everything is
built-in SQL on arrays, so it runs inside the scan stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A character that ends a value inside the fold; it is removed from the input first.
MARK = "\u0001"

_WORD = r"[\p{L}\p{N}]"

#: Quotes and brackets as (opening, closing, doubled): what stands between them is never divided.
_DOUBLE = r'(?<!' + _WORD + r')"[^"]*(?:""[^"]*)*+"(?!' + _WORD + r')'
_SINGLE = r"(?<!" + _WORD + r")'[^']*(?:(?:''|(?<=\p{L})'(?=\p{L}))[^']*)*+'(?!" + _WORD + r")"
_LOW = r"„[^„“”]*[“”]"
_CURLY = r"“[^“”]*”"
_GUILLEMETS = r"«[^«»]*»"
_GUILLEMETS_IN = r"»[^«»]*«"
_LOW_SINGLE = r"‚[^‚‘’]*[‘’]"
_CURLY_SINGLE = r"‘[^‘’]*’(?!" + _WORD + r")"
QUOTED = [_DOUBLE, _SINGLE, _LOW, _CURLY, _GUILLEMETS, _GUILLEMETS_IN, _LOW_SINGLE, _CURLY_SINGLE]
BRACKETS = [r"\([^()]*(?:\([^()]*\)[^()]*)*+\)", r"\[[^\[\]]*\]", r"\{[^{}]*\}"]
SPAN = "|".join(QUOTED + BRACKETS)

#: Delimiters of even pieces: a comma counts unless it stands between two digits, a slash only with blanks on both sides.
DELIMITER = r"[;|\n\r\t•·‣▪\x{2028}]|(?<!\d),|,(?!\d)|(?<=\s)/(?=\s)"

_BLANK = r"[\s\x{00a0}\x{200b}\x{feff}]"


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_BLANK}+|{_BLANK}+$", "")


def _unquote(value: Column) -> Column:
    """Drop the quotes around a whole value; quotes doubled inside become one."""
    body = value.substr(F.lit(2), F.length(value) - F.lit(2))
    out = F.when(value.rlike(f"^(?:{_DOUBLE})$"), F.regexp_replace(body, '""', '"'))
    out = out.when(value.rlike(f"^(?:{_SINGLE})$"), F.regexp_replace(body, "''", "'"))
    whole = "|".join(QUOTED[2:])
    return out.when(value.rlike(f"^(?:{whole})$"), body).otherwise(value)


def packed_values(field: Column) -> Column:
    """The values of one field in reading order, trimmed, unquoted and without empty ones; NULL gives an empty array."""
    text = F.regexp_replace(F.coalesce(field.cast("string"), F.lit("")), MARK, " ")
    even = F.split(text, SPAN, -1)
    odd = F.regexp_extract_all(text, F.lit(SPAN), F.lit(0))
    pieces = F.zip_with(even, odd, lambda e, o: F.concat(F.regexp_replace(e, DELIMITER, MARK), F.coalesce(o, F.lit(""))))
    raw = F.split(F.array_join(pieces, ""), MARK, -1)
    values = F.transform(raw, lambda v: _trim(_unquote(_trim(v))))
    return F.filter(values, lambda v: v != "")


def explode_packed(df: DataFrame, field: str, ordinal: str = "value_idx", value: str = "value", least: int = 1) -> DataFrame:
    """One row per value of df[field]; ordinal counts from 0. Fields with fewer than `least` values give no row.

    NULL and blank fields give no row, repeated rows give repeated results. All other columns are kept; one that has the
    name of a result column is replaced.
    """
    keep = [c for c in df.columns if c not in (ordinal, value)]
    held = "__values"
    while held in df.columns:
        held += "_"
    out = df.withColumn(held, packed_values(F.col(f"`{field}`"))).filter(F.size(held) >= least)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(held).alias(ordinal, value))
