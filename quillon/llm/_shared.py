"""Helpers that the training-data operators share: word patterns, shared scratch tables, let-bindings."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.core import scratch

#: Rows that Spark hands to a Python worker at a time while a stored table is made: texts may be long.
ARROW_ROWS = 1_000
ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: White space that separates words, inside a Java character class and as the class itself.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """Every white-space character as one plain space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r]", " ")


def words(text: Column) -> Column:
    """The words of the whole text in order; none for a null or blank text."""
    return F.array_remove(F.split(spaced(text), " "), "")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    While it is written Arrow batches hold ARROW_ROWS rows at most; the session's own setting is put back.
    """
    spark = df.sparkSession
    before = spark.conf.get(ARROW_CONF)
    spark.conf.set(ARROW_CONF, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        return scratch.stored(df, name)
    finally:
        spark.conf.set(ARROW_CONF, before)


def one_each(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each value of key, the least by the columns: repeated keys do not add rows to a bounded sample."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select(key, "_row.*")


#: Ids up to which a side of a join is broadcast, some 3 MB; beyond it the join shuffles.
BROADCAST_IDS = 200_000


def small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcasting if its size allows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, giving memory that it has freed back to the system at its end: a Python worker outlives its tasks."""

    def tidy(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps its own counsel
            pass

    return tidy
