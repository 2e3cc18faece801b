"""Registration of queries: a name, a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The embeddings with double components, as most oracles start.
E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    """Six decimals, and no negative zero: sums depend on their order beyond that."""
    return F.round(c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (doubles), label."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
