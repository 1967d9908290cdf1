"""Sinks: flat exports, the versioned dictionary with its manifest, run history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def requirement_table(results: DataFrame) -> DataFrame:
    """One row per requirement of nested results (posting_id, requirements ARRAY<STRUCT>)."""
    return results.select("posting_id", F.posexplode("requirements").alias("position", "r")).select("posting_id", "position", "r.*")


def posting_rollup(rows: DataFrame) -> DataFrame:
    """One row per posting: counts per match, items kept whole, and its cores in order without repeats."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "atom_idx", F.col("core").alias("core")))), lambda s: s["core"])
    return rows.groupBy("posting_id").agg(
        F.count(F.lit(1)).alias("requirements"), F.count_distinct("item_idx").alias("items"),
        *[F.count_if(F.col("match_status") == m).alias(m) for m in ("known", "group", "topic", "nuovo")],
        F.array_join(F.array_distinct(F.filter(ordered, lambda c: F.coalesce(c, F.lit("")) != "")), " | ").alias("cores"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A flat table as CSV with a header; nested columns are refused."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    if nested:
        raise ValueError(f"nested columns: {nested}")
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append run lines as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def _digests(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, sha256) of the data files below a path, hashed on the workers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    # One row per part file of a dictionary, which freeze() keeps to a handful.
    rows = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha")).collect()
    return sorted((r["file"], r["sha"]) for r in rows)


def write_dictionary(spark: SparkSession, folder: str, version: str, tables: dict[str, DataFrame], facts: dict) -> dict:
    """Write an immutable version: one parquet per table and a manifest with the digest of every file; never overwrites."""
    base = f"{folder}/{version}"
    for name, df in tables.items():
        df.coalesce(4).write.mode("errorifexists").parquet(f"{base}/{name}.parquet")
    manifest = {"version": version, "files": dict(_digests(spark, base)), "tables": sorted(tables), **facts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value STRING").coalesce(1).write.mode("errorifexists").text(f"{base}/manifest")
    return manifest


def load_dictionary(spark: SparkSession, folder: str, version: str) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables) of a version; an edited file is refused."""
    base = f"{folder}/{version}"
    manifest = json.loads(spark.read.text(f"{base}/manifest").first()["value"])
    if dict(_digests(spark, base)) != manifest["files"]:
        raise ValueError(f"dictionary {version} was edited after it was frozen")
    return manifest, {t: spark.read.parquet(f"{base}/{t}.parquet") for t in manifest["tables"]}


def metric_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A wide table of numbers as (keys, metric, value) rows."""
    parts = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(*parts)).alias("m")).select(*keys, "m.metric", "m.value")
