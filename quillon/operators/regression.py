"""Linear, ridge, LASSO, Bayesian and kernel regression: sums in Spark, small solves on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.linalg import Moments, moments, stacked
from quillon.operators.preprocessing import basis


def _target(y: str | list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in ([y] if isinstance(y, str) else y)))


@dataclass
class Linear:
    """Least squares on a basis of a feature array; several targets may be fitted at once."""

    features: Callable[[], Column]
    ridge: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    @classmethod
    def on(cls, vector: str, basis_name: str = "none", ridge: float = 0.0, **parameters):
        made = basis(basis_name, **parameters)
        return cls(lambda: made(F.col(vector)), ridge)

    def sums(self, df: DataFrame, y: str | list[str]) -> Moments:
        return moments(df, self.features(), _target(y))

    def solve(self, m: Moments) -> np.ndarray:
        """(X'X + ridge I) w = X'y, the bias included in the penalty; least norm where it is singular."""
        a = m.xx + self.ridge * np.eye(len(m.xx))
        return np.linalg.lstsq(a, m.xy, rcond=None)[0]

    def fit(self, df: DataFrame, y: str | list[str]):
        self.weights = self.solve(self.sums(df, y))
        return self

    def predict(self, target: int = 0) -> Column:
        return V.dot(self.features(), V.array_of(self.weights[:, target]))


def prox(w: Column, alpha: Column, rho: float, lamda: float) -> Column:
    """Soft thresholding of w + alpha / rho at lamda / rho."""
    at, level = w + alpha / F.lit(rho), F.lit(lamda / rho)
    return F.when(at > level, at - level).when(at < -level, at + level).otherwise(F.lit(0.0))


@dataclass
class Lasso(Linear):
    """LASSO by ADMM over the Gram matrix, which is summed once. weights is ADMM's w; sparse is its z."""

    lamda: float = 1e-3
    rho: float = 1e-3
    tol: float = 1e-7
    max_iter: int = 100
    sparse: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def solve(self, m: Moments) -> np.ndarray:
        left = np.linalg.inv(m.xx + self.rho * np.eye(len(m.xx)))
        alpha, z, w = np.ones_like(m.xy), np.ones_like(m.xy), np.zeros_like(m.xy)
        for _ in range(self.max_iter):
            w = left @ (m.xy - alpha + self.rho * z)
            at = w + alpha / self.rho
            fresh = np.sign(at) * np.maximum(np.abs(at) - self.lamda / self.rho, 0)
            moved = np.abs(fresh - z).max()
            z = fresh
            alpha = alpha + self.rho * (w - z)
            if moved < self.tol and np.abs(w - z).max() < self.tol:
                break
        self.sparse = z
        return w


@dataclass
class Bayesian(Linear):
    """The Gaussian posterior of the weights under precision alpha of the prior and beta of the noise."""

    alpha: float = 1.0
    beta: float = 25.0
    spread: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def solve(self, m: Moments) -> np.ndarray:
        self.spread = np.linalg.inv(self.alpha * np.eye(len(m.xx)) + self.beta * m.xx)
        return self.beta * self.spread @ m.xy

    def deviation(self) -> Column:
        """The standard deviation of a prediction."""

        def total(phi: Column) -> Column:
            quadratic = F.lit(0.0)
            for i, row in enumerate(self.spread):
                quadratic = quadratic + phi[i] * V.dot(phi, V.array_of(row))
            return F.sqrt(F.lit(1.0 / self.beta) + quadratic)

        return V.let(self.features(), total)


@dataclass
class Evidence(Bayesian):
    """Alpha and beta by iterating the evidence approximation; every step works on the sums alone."""

    beta: float = 1.0
    max_iter: int = 100
    history: list[tuple[float, float]] = field(default_factory=list)

    def solve(self, m: Moments) -> np.ndarray:
        values = np.linalg.eigvalsh(m.xx)
        for _ in range(self.max_iter):
            mean = super().solve(m)
            own = self.beta * values
            gamma = float((own / (self.alpha + own)).sum())
            sse = float((m.yy - 2 * mean.T @ m.xy + mean.T @ m.xx @ mean)[0, 0])
            alpha, beta = gamma / float((mean * mean).sum()), (m.n - gamma) / sse
            settled = np.allclose([alpha, beta], [self.alpha, self.beta])
            self.alpha, self.beta = alpha, beta
            self.history.append((alpha, beta))
            if settled:
                break
        return super().solve(m)

    def log_evidence(self, m: Moments) -> float:
        """Ln p(y | alpha, beta)."""
        mean, d = super().solve(m), len(m.xx)
        a = self.alpha * np.eye(d) + self.beta * m.xx
        sse = float((m.yy - 2 * mean.T @ m.xy + mean.T @ m.xx @ mean)[0, 0])
        energy = self.beta / 2 * sse + self.alpha / 2 * float((mean * mean).sum())
        return d / 2 * np.log(self.alpha) + m.n / 2 * np.log(self.beta) - energy - np.linalg.slogdet(a)[1] / 2 - m.n / 2 * np.log(2 * np.pi)


def kernel_values(name: str, a: np.ndarray, b: np.ndarray, norms: np.ndarray | None = None, out: np.ndarray | None = None, **p: float) -> np.ndarray:
    """The kernels of functions.vectors on matrices of rows, for solvers that run on a bounded set.

    norms: the squared ones of b; out: a matrix for the products, which the Gaussian kernel works in to the end.
    """
    dot, l1 = np.matmul(a, b.T, out=out), None
    if name == "gaussian":
        sq = np.multiply(dot, -2, out=dot)
        sq += (a * a).sum(1)[:, None]
        sq += ((b * b).sum(1) if norms is None else norms)[None, :]
        np.maximum(sq, 0, out=sq)
        sq /= -2 * p.get("sigma", 1.0) ** 2
        return np.exp(sq, out=sq)
    sq = np.maximum((a * a).sum(1)[:, None] + ((b * b).sum(1) if norms is None else norms)[None, :] - 2 * dot, 0)
    if name in ("exponential", "laplacian"):
        l1 = np.abs(a[:, None, :] - b[None, :, :]).sum(2)
    match name:
        case "linear":
            return dot + p.get("c", 0.0)
        case "polynomial":
            return (p.get("alpha", 1.0) * dot + p.get("c", 0.0)) ** p.get("d", 3.0)
        case "exponential":
            return np.exp(-l1 / (2 * p.get("sigma", 0.1) ** 2))
        case "laplacian":
            return np.exp(-l1 / p.get("sigma", 0.1))
        case "sigmoid":
            return np.tanh(p.get("alpha", 1.0) * dot + p.get("c", 0.0))
        case "rational_quadratic":
            return 1 - sq / (sq + p.get("c", 1.0))
        case "multiquadric":
            return np.sqrt(sq + p.get("c", 1.0))
        case "inverse_multiquadric":
            return 1 / np.sqrt(sq + p.get("c", 1.0))
        case "log":
            return -np.log((np.abs(a[:, None, :] - b[None, :, :]) ** p.get("d", 3.0)).sum(2) + 1)
    raise KeyError(f"{name!r} is no kernel")


@dataclass
class KernelRegression:
    """Theta solves (K'K + lamda I) theta = K'y over the training rows, of which there may be max_rows.

    The solve is cubic in the rows, so more of them is an error, not a sample: aggregate them first. Prediction
    streams over any number of rows.
    """

    lamda: float
    kernel: str = "gaussian"
    parameters: dict = field(default_factory=dict)
    max_rows: int = 5_000
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    theta: np.ndarray = field(default_factory=lambda: np.empty(0))

    def fit(self, df: DataFrame, vector: str, y: str) -> KernelRegression:
        rows = df.select(vector, F.col(y).cast("double").alias("_y")).orderBy(vector, "_y").limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"kernel regression takes at most {self.max_rows} training rows")
        self.points = np.array([r[0] for r in rows])
        k = kernel_values(self.kernel, self.points, self.points, **self.parameters)
        self.theta = np.linalg.lstsq(k.T @ k + self.lamda * np.eye(len(k)), k.T @ np.array([r[1] for r in rows]), rcond=None)[0]
        return self

    def predict(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        points, theta, name, parameters = self.points, self.theta, self.kernel, self.parameters
        kind = df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kernel_values(name, stacked(batch.column(1)), points, **parameters) @ theta)], [id_col, "predicted"])

        return df.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, predicted double")
