"""Streams of events: windowed aggregation with watermarks, sessions, and scoring by fitted models.

An extension: the surveyed operators have no streams. Sources are files that arrive in a folder (Parquet); the same
transformations take any streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.core.scratch import scratch_root, stored


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_a_trigger: int = 100) -> DataFrame:
    """The Parquet files of one table as a stream, their times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{sf_dir}/{name}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, by..., aggregates) of windows side by side; rows later than the watermark are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(*aggregates)
    return found.select(F.col("window.start").alias("start"), *by, *(c for c in found.columns if c not in ("window", *by)))


def sliding(events: DataFrame, width: str, every: str, late: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width, every), *by).agg(*aggregates)
    return found.select(F.col("window.start").alias("start"), *by, *(c for c in found.columns if c not in ("window", *by)))


def sessions(events: DataFrame, gap: str, late: str, key: str, *aggregates: Column) -> DataFrame:
    """(key, start, end, aggregates) of stretches of a key's events with no gap of the given length."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(*aggregates)
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *(c for c in found.columns if c not in ("session_window", key)))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream has given once all files that lie there are read, as a stored table.

    Complete mode: the last state of the aggregation; append mode: all rows that were emitted.
    """
    spark = stream.sparkSession
    parts: list[DataFrame] = []

    def keep(batch: DataFrame, _: int) -> None:
        if mode == "complete":
            parts.clear()
        parts.append(stored(batch, name))

    from uuid import uuid4

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch_root(spark)}/quillon/stream-{name}-{uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not parts:
        return spark.createDataFrame([], stream.schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def scored(events: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream with a fitted model's columns: any stateless transformation of DataFrames serves."""
    return score(events)
