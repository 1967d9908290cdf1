"""Problem 10: personal data inside document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.pii import find_personal, redact
from millrace.sources.tables import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every email, phone, id_number, address and name of every text, as written, once per document."""
    return find_personal(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "kind", "found").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its personal data replaced by typed placeholders."""
    return redact(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLES: dict[str, str] = {}
