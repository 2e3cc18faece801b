"""Sums of products over a table, computed where the rows are: only small matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """n, the sum of weights, X'X, X'Y and Y'Y of the rows of a table."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray


def stacked(column: pa.Array) -> np.ndarray:
    """A list<double> Arrow column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def moments(df: DataFrame, x: Column, y: Column, weight: Column | None = None) -> Moments:
    """The moments of array columns x and y (both array<double>), rows with nulls left out.

    Each task adds up the matrix of its own rows and sends one flat row; those are added cell by cell in Spark.
    """
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(x.alias("x"), y.alias("y"), w.cast("double").alias("w")).where("x is not null and y is not null and w is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.hstack([stacked(batch.column(0)), stacked(batch.column(1))])
            n += len(z)
            part = (z * batch.column(2).to_numpy()[:, None]).T @ z
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([len(total)], pa.int32()), pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["d", "n", "cells"])

    parts = rows.mapInArrow(partial, "d int, n long, cells array<double>")
    cells = parts.select("d", F.lit(0).alias("_"), F.posexplode("cells").alias("cell", "v")).groupBy("d", "cell").agg(F.sum("v").alias("v")).collect()
    if not cells:
        raise ValueError("no rows to learn from")
    d = cells[0]["d"]
    m = np.zeros(d * d)
    for r in cells:
        m[r["cell"]] = r["v"]
    m = m.reshape(d, d)
    first = rows.select(F.size("x").alias("k")).first()["k"]
    n = parts.agg(F.sum("n")).first()[0] if weight is None else rows.count()
    return Moments(int(n), m[:first, :first], m[:first, first:], m[first:, first:])


def covariance(df: DataFrame, x: Column, ddof: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) of an array column.

    Rows are shifted by one of them first, which keeps the subtraction of squares from losing digits.
    """
    shift = df.where(x.isNotNull()).select(x.alias("x")).first()
    if shift is None:
        raise ValueError("no rows to learn from")
    from quillon.functions.vectors import array_of

    moved = F.zip_with(x, array_of(shift["x"]), lambda a, b: a - b)
    m = moments(df, F.concat(F.array(F.lit(1.0)), moved), F.array(F.lit(1.0)))
    mean = m.xx[0, 1:] / m.n
    cov = (m.xx[1:, 1:] - m.n * np.outer(mean, mean)) / max(1, m.n - ddof)
    return mean + np.asarray(shift["x"]), cov, m.n
