"""Support vector classifiers by sequential minimal optimisation.

The optimisation is sequential over pairs of rows, so one problem runs in one task; several (one for each class)
run side by side as groups. Rows of the Gram matrix are computed as they are asked for and the last ones kept, so a task
needs the vectors and a bounded store; its time grows with the square of the rows. Scoring streams over any number of
rows against the support vectors.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.linalg import stacked
from quillon.operators.regression import kernel_values


#: Rows of a sweep that are looked at together, to compute those of the Gram matrix that they will ask for.
AHEAD = 64


def signs(labels: np.ndarray) -> tuple[np.ndarray, list]:
    """The two classes, in sorted order, as -1 and 1."""
    classes = sorted(set(labels.tolist()))
    if len(classes) != 2:
        raise ValueError(f"two classes are needed, there are {len(classes)}")
    return np.where(labels == classes[1], 1.0, -1.0), classes


class GramRows:
    """Rows of a Gram matrix on demand, the most recent ones kept up to a number of bytes."""

    def __init__(self, name: str, x: np.ndarray, kept_bytes: int = 1 << 27, **parameters: float):
        self.name, self.x, self.parameters, self.norms = name, x, parameters, (x * x).sum(1)
        self.most, self.kept = max(2, kept_bytes // (8 * max(1, len(x)))), OrderedDict()

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.kept:
            self.kept.move_to_end(i)
        else:
            self.kept[i] = kernel_values(self.name, self.x[i : i + 1], self.x, self.norms, **self.parameters)[0]
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[i]

    def ask(self, rows: np.ndarray) -> None:
        """Computes the rows that are not kept as one product, which reads the vectors once for all of them."""
        rows = [i for i in rows[: self.most // 2].tolist() if i not in self.kept]
        if len(rows) > 1:
            for i, k in zip(rows, kernel_values(self.name, self.x[rows], self.x, self.norms, **self.parameters), strict=True):
                self.kept[i] = k.copy()  # a view would keep its whole block
            while len(self.kept) > self.most:
                self.kept.popitem(last=False)

    def diagonal(self) -> np.ndarray:
        if self.name == "gaussian":
            return np.ones(len(self.x))
        return np.array([kernel_values(self.name, r, r, **self.parameters)[0, 0] for r in self.x[:, None]])


def smo(k: np.ndarray | GramRows, t: np.ndarray, c: float = np.inf, sweeps: int = 100, tol: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """(a, b) of the dual problem with Gram matrix k (or its rows) and labels t; c = inf is the hard margin.

    Rows that violate the optimality conditions are paired with the row whose error differs most; the errors are
    kept up to date rather than recomputed. Both ends of a step are clipped to the box.
    """
    rng, n = np.random.default_rng(seed), len(t)
    a, b = np.zeros(n), 0.0
    e, own = -t.copy(), k.diagonal()
    for _ in range(sweeps):
        changed, order = 0, rng.permutation(n)
        for at, i in enumerate(order):
            if at % AHEAD == 0 and isinstance(k, GramRows):
                some = order[at : at + AHEAD]
                gap = e[some] * t[some]
                k.ask(some[((gap < -tol) & (a[some] < c)) | ((gap > tol) & (a[some] > 0))])
            r = e[i] * t[i]
            if not ((r < -tol and a[i] < c) or (r > tol and a[i] > 0)):
                continue
            ki = k[i]
            for j in (int(np.argmax(np.abs(e - e[i]))), *rng.integers(0, n, 8).tolist()):
                if i == j:
                    continue
                same = t[i] == t[j]
                low = max(0.0, a[i] + a[j] - c) if same else max(0.0, a[j] - a[i])
                high = min(c, a[i] + a[j]) if same else min(c, c + a[j] - a[i])
                bend = own[i] + own[j] - 2 * ki[j]
                if high - low < 1e-12 or bend <= 1e-12:
                    continue
                new = float(np.clip(a[j] + t[j] * (e[i] - e[j]) / bend, low, high))
                step = new - a[j]
                if abs(step) < 1e-9 * (new + a[j] + 1e-9):
                    continue
                di = -t[i] * t[j] * step
                b1 = b - e[i] - t[i] * di * own[i] - t[j] * step * ki[j]
                b2 = b - e[j] - t[i] * di * ki[j] - t[j] * step * own[j]
                a[i] += di
                a[j] = new
                was, b = b, b1 if 0 < a[i] < c else b2 if 0 < a[j] < c else (b1 + b2) / 2
                e += t[i] * di * ki + t[j] * step * k[j] + (b - was)
                changed += 1
                break
        if not changed:
            break
    return a, b


@dataclass
class Svm:
    """S13 (soft margin, box C), S14 (C = inf) and S15 (one against the rest where there are more classes)."""

    kernel: str = "gaussian"
    parameters: dict = field(default_factory=dict)
    c: float = 10.0
    sweeps: int = 100
    max_rows: int | None = None
    #: (class, bias, coefficients a * t, places of its support vectors among the rows by id) for each problem
    problems: list[tuple] = field(default_factory=list)
    #: The support vectors of all problems, once each, and their coefficients by problem
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    coefficients: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    classes: list = field(default_factory=list)

    def fit(self, df: DataFrame, id_col: str, vector: str, label: str) -> Svm:
        rows = df.select(id_col, F.col(vector).alias("v"), F.col(label).alias("label"))
        self.classes = sorted(r[0] for r in rows.select("label").distinct().collect())
        if self.max_rows is not None and rows.count() > self.max_rows:
            raise ValueError(f"a support vector problem takes at most {self.max_rows} rows")
        wanted = self.classes[1:] if len(self.classes) == 2 else self.classes
        asked = F.explode(F.array(*(F.lit(c) for c in wanted)))
        name, parameters, c, sweeps = self.kernel, self.parameters, self.c, self.sweeps

        def solve(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(id_col)
            x = np.stack(part.v.to_numpy())
            t = np.where(part.label == part.against.iloc[0], 1.0, -1.0)
            a, b = smo(GramRows(name, x, **parameters), t, c, sweeps)
            used = np.flatnonzero(a > 1e-8)
            return pd.DataFrame({"against": [part.against.iloc[0]], "b": [b], "at": [(a * t)[used].tobytes()], "used": [used.tobytes()]})

        kind = df.schema[label].dataType.simpleString()
        solved = rows.withColumn("against", asked).groupBy("against").applyInPandas(solve, f"against {kind}, b double, at binary, used binary")
        found = [(r["against"], r["b"], np.frombuffer(bytes(r["at"])), np.frombuffer(bytes(r["used"]), np.int64)) for r in solved.collect()]
        x = stacked(rows.orderBy(id_col).select("v").toArrow().column(0))
        self.problems = [(name, b, at, used) for name, b, at, used in sorted(found, key=lambda p: self.classes.index(p[0]))]
        which = np.unique(np.concatenate([used for *_, used in self.problems])) if self.problems else np.empty(0, np.int64)
        self.vectors, self.coefficients = x[which], np.zeros((len(which), len(self.problems)))
        for i, (_, _, at, used) in enumerate(self.problems):
            self.coefficients[np.searchsorted(which, used), i] = at
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        """One decision value for each problem, a bounded number of kernel values at a time, each for all problems."""
        bias = np.array([b for _, b, *_ in self.problems])
        out = np.tile(bias, (len(x), 1))
        for i in range(0, len(x), 256):
            for j in range(0, len(self.vectors), 1024):
                out[i : i + 256] += kernel_values(self.kernel, x[i : i + 256], self.vectors[j : j + 1024], **self.parameters) @ self.coefficients[j : j + 1024]
        return out

    def predict(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        """(id, predicted): the label (not its index); of two classes the second where the decision is above 0."""
        kind, model = df.schema[id_col].dataType.simpleString(), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = model.decide(stacked(batch.column(1)))
                which = (d[:, 0] > 0).astype(int) if len(model.problems) == 1 else d.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(model.classes[i]) for i in which])], [id_col, "predicted"])

        return df.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, predicted string")


@dataclass
class Rvm:
    """S16, an extension (the surveyed class is a stub): the relevance vector machine for regression.

    Every training row and a bias have a weight with a precision of its own; precisions and the noise are
    re-estimated from the posterior until they rest, and weights whose precision passes `prune` are dropped.
    """

    kernel: str = "gaussian"
    parameters: dict = field(default_factory=dict)
    alpha: float = 1.0
    beta: float = 1.0
    max_iter: int = 100
    prune: float = 1e9
    max_rows: int = 5_000
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    used: np.ndarray = field(default_factory=lambda: np.empty(0, int))

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), kernel_values(self.kernel, x, self.points, **self.parameters)])

    def fit(self, df: DataFrame, id_col: str, vector: str, y: str) -> Rvm:
        rows = df.select(id_col, vector, F.col(y).cast("double").alias("_y")).orderBy(id_col).limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"at most {self.max_rows} training rows")
        self.points, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        whole = self._design(self.points)
        used, alpha, beta = np.arange(whole.shape[1]), np.full(whole.shape[1], self.alpha), self.beta
        mean = np.zeros(len(used))
        for _ in range(self.max_iter):
            phi = whole[:, used]
            spread = np.linalg.inv(np.diag(alpha) + beta * phi.T @ phi)
            mean = beta * spread @ phi.T @ t
            gamma = 1 - alpha * np.diag(spread)
            fresh = gamma / np.maximum(mean**2, 1e-300)
            beta = float((len(t) - gamma.sum()) / max(((t - phi @ mean) ** 2).sum(), 1e-300))
            keep = fresh < self.prune
            settled = keep.all() and np.allclose(fresh, alpha, rtol=1e-4)
            used, alpha, mean = used[keep], fresh[keep], mean[keep]
            if settled:
                break
        phi = whole[:, used]
        mean = beta * np.linalg.inv(np.diag(alpha) + beta * phi.T @ phi) @ phi.T @ t
        self.used, self.weights, self.beta = used, mean, beta
        return self

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return self._design(x)[:, self.used] @ self.weights
