"""Regulation from expression over pseudo-time: X = W exp(b t), A = W B W^+ (Q31, Q32)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass
class Scode:
    """Random coordinate search on b; for each b, W is a ridge solve on sums over cells.

    Cells are rows (time, expression array). Each step needs Z'Z and Z'X, with Z = exp(b t) of every cell: one
    aggregation, of which only D x D and D x genes numbers reach the driver. Times are first counted into at most
    `steps` levels, so that a step sees the levels' sums and not the cells again.
    """

    dimension: int = 4
    max_iter: int = 100
    low: float = -10.0
    high: float = 2.0
    ridge: float = 1e-4
    steps: int = 1_000
    seed: int = 0
    b: np.ndarray = field(default_factory=lambda: np.empty(0))
    w: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    a: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    history: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, time: str, expression: str) -> Scode:
        span = df.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
        width = (span["b"] - span["a"]) / self.steps or 1.0
        level = F.least(F.floor((F.col(time) - F.lit(span["a"])) / F.lit(width)), F.lit(self.steps - 1))
        long = df.select(level.alias("level"), F.col(time).alias("t"), F.posexplode(expression).alias("gene", "x"))
        cells = long.groupBy("level", "gene").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("t"), F.sum("x").alias("x")).collect()
        total = df.select(F.aggregate(expression, F.lit(0.0), lambda s, x: s + x * x).alias("s")).agg(F.sum("s")).first()[0]
        levels = sorted({r["level"] for r in cells})
        at = {v: i for i, v in enumerate(levels)}
        genes = max(r["gene"] for r in cells) + 1
        t, n, x = np.zeros(len(levels)), np.zeros(len(levels)), np.zeros((len(levels), genes))
        for r in cells:
            t[at[r["level"]]], n[at[r["level"]]], x[at[r["level"]], r["gene"]] = r["t"], r["n"], r["x"]
        rng = np.random.default_rng(self.seed)

        def solve(b: np.ndarray) -> tuple[np.ndarray, float]:
            z = np.exp(np.outer(t, b))
            zz, zx = (z * n[:, None]).T @ z + self.ridge * np.eye(len(b)), z.T @ x
            w = np.linalg.solve(zz, zx)
            return w, float(total - 2 * (w * zx).sum() + (w * ((z * n[:, None]).T @ z @ w)).sum())

        self.b = rng.uniform(self.low, self.high, self.dimension)
        self.w, best = solve(self.b)
        for _ in range(self.max_iter):
            tried = self.b.copy()
            tried[rng.integers(self.dimension)] = rng.uniform(self.low, self.high)
            w, loss = solve(tried)
            if loss < best:
                self.b, self.w, best = tried, w, loss
            self.history.append(best)
        self.w = self.w.T
        self.a = self.w @ np.diag(self.b) @ np.linalg.pinv(self.w)
        return self

    def predict(self, time: np.ndarray) -> np.ndarray:
        """Q32: expression at given times, one row each."""
        return np.exp(np.outer(np.asarray(time, float), self.b)) @ self.w.T

    def strongest(self, spark, top: int = 10) -> DataFrame:
        """Q32: (target, regulator, strength) of the entries of A of greatest size."""
        rows = [(i, j, float(self.a[i, j])) for i in range(len(self.a)) for j in range(len(self.a)) if i != j]
        df = spark.createDataFrame(rows, "target int, regulator int, strength double")
        return df.orderBy(F.abs("strength").desc(), "target", "regulator").limit(top)


