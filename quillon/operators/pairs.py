"""All-pairs work in blocks: a query set against all rows, and sums over pairs, without a Cartesian product.

Rows of either side get a block number, as many as the rows call for; every pair of blocks is one key of an ordinary
join or group, so a key holds two blocks whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V


#: Rows of either side of a block pair.
ROWS_A_BLOCK = 500


def against_all(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each query beside each row, the rows' columns as they are and the queries' prefixed q_.

    Both sides are dealt to blocks of some ROWS_A_BLOCK rows, counted first, so a key holds as much at any size. A row
    is copied once for each block of the other side, which is a small part of the pairs that come out.
    """
    sides = {}
    for name, df in (("_q", queries), ("_r", rows)):
        n = max(1, -(-df.count() // ROWS_A_BLOCK))
        sides[name] = (F.pmod(F.xxhash64(*df.columns), F.lit(n)), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    asked = queries.withColumn("_q", sides["_q"][0]).withColumn("_r", sides["_r"][1])
    dealt = rows.withColumn("_r", sides["_r"][0]).withColumn("_q", sides["_q"][1])
    asked = asked.select("_q", "_r", *(F.col(c).alias(f"q_{c}") for c in queries.columns))
    return dealt.join(asked, ["_q", "_r"]).drop("_q", "_r")


def pairwise_distances(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, metric: str | Callable[[Column, Column], Column] = "euclidean") -> DataFrame:
    """(q_id, id, distance) of every query and row; an id's distance to itself is 0."""
    pairs = against_all(queries.select(id_col, vector), rows.select(id_col, vector))
    found = V.metric(metric)(F.col(f"q_{vector}"), F.col(vector))
    return pairs.select(f"q_{id_col}", id_col, F.when(F.col(f"q_{id_col}") == F.col(id_col), F.lit(0.0)).otherwise(found).alias("distance"))


def gram(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, kernel: Callable[[Column, Column], Column]) -> DataFrame:
    """Kernel values of every query and row."""
    pairs = against_all(queries.select(id_col, vector), rows.select(id_col, vector))
    return pairs.select(f"q_{id_col}", id_col, kernel(F.col(f"q_{vector}"), F.col(vector)).alias("k"))


def label_distances(df: DataFrame, id_col: str, vector: str, label: str, rows_a_block: int = 1_000) -> DataFrame:
    """(id, own, label, total, n): for each row and label, the sum of Euclidean distances to the rows of that label.

    Distances of two blocks are one matrix product in a task; only sums leave it. The row itself counts, at 0.
    """
    blocks = max(1, -(-df.count() // rows_a_block))
    placed = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    left = placed.select("*", other.alias("other")).select(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "id", "v", "label")
    right = placed.select("*", other.alias("other")).select(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "v", "label")

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = part[part.side == 0], part[part.side == 1]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"id": [], "own": [], "label": [], "total": [], "n": []})
        a, b = np.stack(mine.v.to_numpy()), np.stack(theirs.v.to_numpy())
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        d2[mine.id.to_numpy()[:, None] == theirs.id.to_numpy()[None, :]] = 0
        names, where = np.unique(theirs.label.to_numpy(), return_inverse=True)
        hot = np.zeros((len(theirs), len(names)))
        hot[np.arange(len(theirs)), where] = 1
        found = np.sqrt(np.maximum(d2, 0)) @ hot
        n = len(mine)
        return pd.DataFrame({"id": np.repeat(mine.id.to_numpy(), len(names)), "own": np.repeat(mine.label.to_numpy(), len(names)), "label": np.tile(names, n), "total": found.ravel(), "n": np.tile(hot.sum(0), n)})

    parts = left.unionAll(right).groupBy("i", "j").applyInPandas(sums, "id long, own long, label long, total double, n double")
    return parts.groupBy("id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
