"""Incremental work as Structured Streaming: admission of adverts, drift of lights, counts by time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.explorer import advert_key
from millrace.session import ensure_checkpoint_dir, share_path


def table_stream(spark: SparkSession, folder: str, name: str, files: int = 8) -> DataFrame:
    """A table as a stream of its files."""
    share_path(spark)
    place = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(place).schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream reads folders
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(place)


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def run(stream: DataFrame, batch, place: str) -> None:
    """Run a stream over what is there now, batch by batch."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def admit(stream: DataFrame, place: str, gate=None) -> None:
    """Append the adverts of a stream that are new by their key; rows that `gate` refuses are left out.

    A batch is written to a folder of its own number, so a batch that is run again after a failure replaces itself.
    """
    keyed = stream.withColumn("advert_key", advert_key(F.col("id"), F.col("title"), F.col("must_have")))

    def batch(df: DataFrame, number: int) -> None:
        rows = df if gate is None else df.filter(gate)
        rows = rows.groupBy("advert_key").agg(F.min(F.struct("posting_row", "id", "title", "job")).alias("b")).select("advert_key", "b.*")
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/adverts")
        if number and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            # One read of all batches before, the keys only; a batch that is run again does not see itself.
            schema = rows.select("advert_key").schema.add("batch", "integer")
            known = spark.read.schema(schema).option("basePath", f"{place}/adverts").parquet(f"{place}/adverts").filter(F.col("batch") < number)
            rows = rows.join(known.select("advert_key"), "advert_key", "left_anti")
        rows.write.mode("overwrite").parquet(f"{place}/adverts/batch={number}")

    run(keyed, batch, place)


def drift_stream(stream: DataFrame, key: str, at: str, light: str, runs: int = 3) -> DataFrame:
    """(key, at) of events that are the `runs`-th off-green one in a row; the state holds the length of the row only."""
    kind = stream.schema[key].dataType.simpleString()
    when = stream.schema[at].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(at)
        hits = []
        for t, l in zip(rows[at], rows[light], strict=True):
            row = row + 1 if l in ("yellow", "red") else 0
            if row >= runs:
                hits.append(t)
        state.update((row,))
        yield pd.DataFrame({key: [k[0]] * len(hits), at: hits})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} {when}", "row INT", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, kind: str, window: str, late: str) -> DataFrame:
    """Counts and sums per time window and kind, with a watermark for late rows."""
    timed = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def collect_stream(stream: DataFrame, place: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into parquet and read the result."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")
