"""Hidden Markov models.

Recurrences of discrete models are folds over an array column, inside the JVM; models of any kind also run as
numpy recurrences over Arrow batches of sequences. Baum-Welch adds up each sequence's sufficient statistics in
Spark and only renormalises on the driver. All work is in logarithms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.clustering import KMeans, covariance_as, covariance_full, log_normal


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


# -- folds over array<int> observations; log parameters are constants of the plan


def _step(before: Column, columns: list[Column], log_b: list[Column], o: Column) -> Column:
    return F.array(*(V.logsumexp(F.zip_with(before, a, lambda x, y: x + y)) + b[o] for a, b in zip(columns, log_b, strict=True)))


def _parameters(initial: np.ndarray, transit: np.ndarray, emit: np.ndarray):
    with np.errstate(divide="ignore"):
        return np.log(initial), np.log(transit), np.log(emit)


def forward(obs: Column, initial: np.ndarray, transit: np.ndarray, emit: np.ndarray) -> Column:
    """Array of log alpha, one array of states for each observation; an empty sequence gives an empty array."""
    pi, a, b = _parameters(initial, transit, emit)
    log_b, into = [V.array_of(r) for r in b], [V.array_of(c) for c in a.T]
    first = F.array(*(F.lit(float(p)) + r[obs[0]] for p, r in zip(pi, log_b, strict=True)))
    folded = F.aggregate(F.slice(obs, 2, F.greatest(F.size(obs) - 1, F.lit(0))), F.array(first), lambda acc, o: F.concat(acc, F.array(_step(F.element_at(acc, -1), into, log_b, o))))
    return F.when(F.size(obs) > 0, folded).otherwise(F.array().cast("array<array<double>>"))


def backward(obs: Column, transit: np.ndarray, emit: np.ndarray) -> Column:
    """Array of log beta, in the order of the observations."""
    _, a, b = _parameters(np.ones(len(transit)), transit, emit)
    log_b, out_of = [V.array_of(r) for r in b], [V.array_of(r) for r in a]
    last = V.array_of(np.zeros(len(transit)))

    def step(acc: Column, o: Column) -> Column:
        ahead = V.let(acc[0], lambda beta: F.array(*(beta[k] + log_b[k][o] for k in range(len(log_b)))))
        return V.let(ahead, lambda x: F.concat(F.array(F.array(*(V.logsumexp(F.zip_with(x, r, lambda p, q: p + q)) for r in out_of))), acc))

    folded = F.aggregate(F.reverse(F.slice(obs, 2, F.greatest(F.size(obs) - 1, F.lit(0)))), F.array(last), step)
    return F.when(F.size(obs) > 0, folded).otherwise(F.array().cast("array<array<double>>"))


def log_likelihood(obs: Column, initial: np.ndarray, transit: np.ndarray, emit: np.ndarray) -> Column:
    """The logarithm of a sequence's probability; null for an empty one."""
    return V.let(forward(obs, initial, transit, emit), lambda a: F.when(F.size(a) > 0, V.logsumexp(F.element_at(a, -1))))


def posterior(alpha: Column, beta: Column) -> Column:
    """Gamma, the probabilities of the states at each place."""

    def softmax(x: Column) -> Column:
        return V.let(x, lambda s: V.let(V.logsumexp(s), lambda n: F.transform(s, lambda v: F.exp(v - n))))

    return F.zip_with(alpha, beta, lambda a, b: softmax(F.zip_with(a, b, lambda x, y: x + y)))


def viterbi(obs: Column, initial: np.ndarray, transit: np.ndarray, emit: np.ndarray) -> Column:
    """struct(log_probability, states): the likeliest path, first states of equals."""
    pi, a, b = _parameters(initial, transit, emit)
    log_b, into = [V.array_of(r) for r in b], [V.array_of(c) for c in a.T]
    first = F.array(*(F.lit(float(p)) + r[obs[0]] for p, r in zip(pi, log_b, strict=True)))
    step = lambda w, o: F.array(*(F.array_max(F.zip_with(w, c, lambda x, y: x + y)) + r[o] for c, r in zip(into, log_b, strict=True)))
    best = F.aggregate(F.slice(obs, 2, F.greatest(F.size(obs) - 1, F.lit(0))), F.array(first), lambda acc, o: F.concat(acc, F.array(step(F.element_at(acc, -1), o))))
    columns = F.array(*into)

    def path(w: Column) -> Column:
        end = F.element_at(w, -1)
        start = F.array(V.argmax(end))
        back = F.aggregate(F.reverse(F.slice(w, 1, F.size(w) - 1)), start, lambda acc, x: V.let(F.zip_with(x, F.element_at(columns, acc[0] + 1), lambda p, q: p + q), lambda s: F.concat(F.array(V.argmax(s)), acc)))
        return F.struct(F.array_max(end).alias("log_probability"), back.alias("states"))

    return F.when(F.size(obs) > 0, V.let(best, path))


def map_states(gamma: Column) -> Column:
    """struct(score, states): the likeliest state at each place, and the sum of their probabilities."""
    return F.struct(F.aggregate(gamma, F.lit(0.0), lambda s, g: s + F.array_max(g)).alias("score"), F.transform(gamma, V.argmax).alias("states"))


# -- models


def passes(log_pi: np.ndarray, log_a: np.ndarray, log_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log alpha and beta of one sequence from its (places, states) log emissions."""
    n, k = log_b.shape
    alpha, beta = np.empty((n, k)), np.zeros((n, k))
    alpha[0] = log_pi + log_b[0]
    for t in range(1, n):
        alpha[t] = logsumexp(alpha[t - 1][:, None] + log_a, 0) + log_b[t]
    for t in range(n - 2, -1, -1):
        beta[t] = logsumexp(log_a + (log_b[t + 1] + beta[t + 1])[None, :], 1)
    return alpha, beta


def best_path(log_pi: np.ndarray, log_a: np.ndarray, log_b: np.ndarray) -> tuple[float, np.ndarray]:
    n, k = log_b.shape
    w = np.empty((n, k))
    w[0] = log_pi + log_b[0]
    for t in range(1, n):
        w[t] = (w[t - 1][:, None] + log_a).max(0) + log_b[t]
    states = np.empty(n, int)
    states[-1] = w[-1].argmax()
    for t in range(n - 2, -1, -1):
        states[t] = (w[t] + log_a[:, states[t + 1]]).argmax()
    return float(w[-1].max()), states


@dataclass
class Hmm:
    """Common to all emissions. Subclasses say log_emissions, statistics, update, draw and how to start."""

    n_states: int = 3
    seed: int = 0
    update: str = "ite"
    initial: np.ndarray = field(default_factory=lambda: np.empty(0))
    transit: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    history: list[float] = field(default_factory=list)

    #: Names of the parameters that files hold.
    names = ("initial", "transit")

    def start(self, df: DataFrame, obs: str) -> None:
        """Random parameters."""
        rng = np.random.default_rng(self.seed)
        if not len(self.initial):
            self.initial = rng.dirichlet(np.ones(self.n_states))
        if not len(self.transit):
            self.transit = rng.dirichlet(np.ones(self.n_states), self.n_states)

    def check(self) -> None:
        """ValueError unless the distributions are ones."""
        k = self.n_states
        if self.initial.shape != (k,) or self.transit.shape != (k, k):
            raise ValueError("initial needs n_states numbers, transit n_states times n_states")
        if not np.isclose(self.initial.sum(), 1) or not np.allclose(self.transit.sum(1), 1) or (self.initial < 0).any() or (self.transit < 0).any():
            raise ValueError("initial and the rows of transit must be distributions")

    def to_json(self) -> str:
        return json.dumps({n: np.asarray(getattr(self, n)).tolist() for n in self.names})

    def load_json(self, text: str):
        for n, v in json.loads(text).items():
            if n not in self.names:
                raise KeyError(f"{n!r} is no parameter")
            setattr(self, n, np.array(v))
        self.check()
        return self

    def places(self, seq: list) -> np.ndarray:
        """A sequence's observations as an array."""
        return np.array(seq)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def renew(self, s: np.ndarray) -> None:
        raise NotImplementedError

    def draw(self, state: int, rng: np.random.Generator):
        raise NotImplementedError

    def logs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            return np.log(self.initial), np.log(self.transit), self.log_emissions(x)

    def expect(self, df: DataFrame, obs: str) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """One pass: (log likelihood, first states, transitions (H03), emission statistics), summed over sequences."""
        model, k = self, self.n_states

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for seq in batch.column(0).to_pylist():
                    if not seq:
                        continue
                    x = model.places(seq)
                    pi, a, b = model.logs(x)
                    alpha, beta = passes(pi, a, b)
                    score = float(logsumexp(alpha[-1], 0))
                    gamma = np.exp(alpha + beta - score)
                    xi = np.exp(alpha[:-1, :, None] + a[None] + (b[1:] + beta[1:])[:, None, :] - score).sum(0) if len(x) > 1 else np.zeros((k, k))
                    part = np.concatenate([[score], gamma[0], xi.ravel(), model.statistics(x, gamma)])
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["cells"])

        cells = df.select(obs).mapInArrow(partial, "cells array<double>").select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not cells:
            raise ValueError("no sequences to learn from")
        s = np.array([r["v"] for r in cells])
        return float(s[0]), s[1 : 1 + k], s[1 + k : 1 + k + k * k].reshape(k, k), s[1 + k + k * k :]

    def fit(self, df: DataFrame, obs: str, max_iter: int = 10, tol: float = 1e-4):
        """Baum-Welch until the log likelihood moves by less than tol. `update` names what is learned: i, t, e."""
        rows = df.select(obs).persist()
        self.start(rows, obs)
        self.check()
        for _ in range(max_iter):
            score, first, moves, emitted = self.expect(rows, obs)
            if "i" in self.update:
                self.initial = first / first.sum()
            if "t" in self.update:
                sums = moves.sum(1, keepdims=True)
                self.transit = np.where(sums > 0, moves / np.maximum(sums, 1e-300), self.transit)
            if "e" in self.update:
                self.renew(emitted)
            self.history.append(score)
            if len(self.history) > 1 and abs(self.history[-1] - self.history[-2]) < tol:
                break
        rows.unpersist()
        return self

    def score(self, df: DataFrame, obs: str) -> float:
        """The log likelihood of all sequences."""
        return self.expect(df, obs)[0]

    def decode(self, df: DataFrame, seq_id: str, obs: str, algorithm: str = "viterbi") -> DataFrame:
        """(seq_id, log_likelihood, score, states, gamma) of each sequence; empty ones have nulls."""
        if algorithm not in ("viterbi", "map"):
            raise KeyError(f"{algorithm!r} is no algorithm; there are 'viterbi' and 'map'")
        model, kind = self, df.schema[seq_id].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for seq in batch.column(1).to_pylist():
                    if not seq:
                        out.append((None, None, None, None))
                        continue
                    pi, a, b = model.logs(model.places(seq))
                    alpha, beta = passes(pi, a, b)
                    whole = float(logsumexp(alpha[-1], 0))
                    gamma = np.exp(alpha + beta - whole)
                    score, states = best_path(pi, a, b) if algorithm == "viterbi" else (float(gamma.max(1).sum()), gamma.argmax(1))
                    out.append((whole, score, states.tolist(), gamma.tolist()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                kinds = [pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [seq_id, "log_likelihood", "score", "states", "gamma"])

        return df.select(seq_id, obs).mapInArrow(run, f"`{seq_id}` {kind}, log_likelihood double, score double, states array<int>, gamma array<array<double>>")

    def sample(self, n: int, seed: int = 0) -> tuple[list, list[int]]:
        """N observations and their states; the first state is the likeliest initial one."""
        rng = np.random.default_rng(seed)
        state, states, out = int(np.argmax(self.initial)), [], []
        for _ in range(n):
            states.append(state)
            out.append(self.draw(state, rng))
            state = int(rng.choice(self.n_states, p=self.transit[state]))
        return out, states


@dataclass
class Multinomial(Hmm):
    """Symbols 0, 1, ...; H13 is the same with two of them."""

    n_symbols: int | None = None
    emit: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    names = ("initial", "transit", "emit")

    def start(self, df: DataFrame, obs: str) -> None:
        super().start(df, obs)
        span = df.select(F.explode(obs).alias("o")).agg(F.min("o").alias("a"), F.max("o").alias("b")).first()
        if span["a"] is None or span["a"] < 0:
            raise ValueError("symbols must be whole numbers from 0")
        self.n_symbols = self.n_symbols or int(span["b"]) + 1
        if span["b"] >= self.n_symbols:
            raise ValueError(f"symbols must be below {self.n_symbols}")
        if not len(self.emit):
            self.emit = np.random.default_rng(self.seed + 1).dirichlet(np.ones(self.n_symbols), self.n_states)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.emit[:, x]).T

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        out = np.zeros((self.emit.shape[1], self.n_states))
        np.add.at(out, x, gamma)
        return out.T.ravel()

    def renew(self, s: np.ndarray) -> None:
        s = s.reshape(self.n_states, -1)
        self.emit = s / np.maximum(s.sum(1, keepdims=True), 1e-300)

    def draw(self, state: int, rng: np.random.Generator) -> int:
        return int(rng.choice(self.emit.shape[1], p=self.emit[state]))

    def counts(self, df: DataFrame, seq_id: str, obs: str) -> DataFrame:
        """(seq_id, symbol, state, share): the expected share of a sequence's places with a symbol in a state."""
        told = self.decode(df, seq_id, obs).join(df.select(seq_id, obs), seq_id)
        long = told.select(seq_id, F.size(obs).alias("n"), F.posexplode(F.arrays_zip(F.col(obs).alias("o"), F.col("gamma").alias("g"))).alias("place", "x"))
        long = long.select(seq_id, "n", F.col("x")["o"].alias("symbol"), F.posexplode(F.col("x")["g"]).alias("state", "p"))
        return long.groupBy(seq_id, "symbol", "state").agg((F.sum("p") / F.first("n")).alias("share"))


@dataclass
class Bernoulli(Multinomial):
    """H13"""

    n_symbols: int | None = 2


@dataclass
class Binomial(Hmm):
    """Counts of successes among n trials, each state with its own chance."""

    trials: int = 10
    theta: np.ndarray = field(default_factory=lambda: np.empty(0))
    names = ("initial", "transit", "theta")

    def start(self, df: DataFrame, obs: str) -> None:
        super().start(df, obs)
        if not len(self.theta):
            self.theta = np.random.default_rng(self.seed + 1).uniform(0.1, 0.9, self.n_states)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, self.trials + 1)))])
        choose = factorials[self.trials] - factorials[x] - factorials[self.trials - x]
        p = np.clip(self.theta, 1e-12, 1 - 1e-12)
        return choose[:, None] + x[:, None] * np.log(p) + (self.trials - x)[:, None] * np.log1p(-p)

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ gamma, (self.trials - x) @ gamma])

    def renew(self, s: np.ndarray) -> None:
        hit, miss = s[: self.n_states], s[self.n_states :]
        self.theta = hit / np.maximum(hit + miss, 1e-300)

    def draw(self, state: int, rng: np.random.Generator) -> int:
        return int(rng.binomial(self.trials, self.theta[state]))


@dataclass
class Mss(Hmm):
    """Pairs (m, u) of counts; the first state succeeds with theta, the second with 1 - theta."""

    n_states: int = 2
    theta: float = 0.0
    names = ("initial", "transit", "theta")

    def start(self, df: DataFrame, obs: str) -> None:
        super().start(df, obs)
        if not self.theta:
            self.theta = float(np.random.default_rng(self.seed + 1).uniform(0.55, 0.9))

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        p = float(np.clip(self.theta, 1e-12, 1 - 1e-12))
        m, u = x[:, 0], x[:, 1]
        return np.stack([m * np.log(p) + u * np.log1p(-p), u * np.log(p) + m * np.log1p(-p)], 1)

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        hit = gamma[:, 0] @ x[:, 0] + gamma[:, 1] @ x[:, 1]
        return np.array([hit, x.sum() - hit], float)

    def renew(self, s: np.ndarray) -> None:
        self.theta = float(s[0] / max(s.sum(), 1e-300))

    def draw(self, state: int, rng: np.random.Generator) -> list[int]:
        m = int(rng.binomial(10, self.theta if state == 0 else 1 - self.theta))
        return [m, 10 - m]


@dataclass
class Gaussian(Hmm):
    """Vectors; covariances are full, tied, diag or spherical, with priors on means and covariances.

    The start is K-Means over all observations and their common covariance. A component that is null (as the logarithm
    of 0) is not observed: the others count by their marginal density, and sums take its expectation given them.
    """

    kind: str = "diag"
    means_prior: float = 0.0
    means_weight: float = 0.0
    cov_prior: float = 1e-2
    cov_weight: float = 1.0
    means: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    covars: np.ndarray = field(default_factory=lambda: np.empty(0))
    names = ("initial", "transit", "means", "covars")

    def start(self, df: DataFrame, obs: str) -> None:
        super().start(df, obs)
        if len(self.means):
            return
        whole = F.forall("x", lambda v: v.isNotNull())
        flat = df.select(F.explode(obs).alias("x")).where(whole).withColumn("id", F.monotonically_increasing_id())
        self.means = KMeans(self.n_states, max_iter=20, seed=self.seed).fit(flat, "id", "x").centres
        from quillon.operators.linalg import covariance

        _, cov, _ = covariance(flat, F.col("x"))
        self.covars = covariance_as(cov + 1e-3 * np.eye(len(cov)), self.kind, self.n_states)

    def places(self, seq: list) -> np.ndarray:
        return np.array([[None] * self.means.shape[1] if v is None else v for v in seq], float)

    def _observed(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which components, which rows) for each set of components that some rows have."""
        sets, where = np.unique(~np.isnan(x), axis=0, return_inverse=True)
        for i, seen in enumerate(sets):
            yield seen, np.flatnonzero(where.ravel() == i)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        covs = [self.covars] * self.n_states if self.kind == "tied" else self.covars
        out = np.zeros((len(x), self.n_states))
        for seen, rows in self._observed(x):
            if not seen.any():
                continue
            part = (lambda c: c) if self.kind == "spherical" else (lambda c, seen=seen: c[seen]) if self.kind == "diag" else (lambda c, seen=seen: c[np.ix_(seen, seen)])
            out[rows] = np.stack([log_normal(x[rows][:, seen], m[seen], part(c), self.kind) for m, c in zip(self.means, covs, strict=True)], 1)
        return out

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        k, d = self.n_states, self.means.shape[1]
        out = np.zeros((k, d + 1, d + 1))
        for seen, rows in self._observed(x):
            if seen.all():
                z = np.hstack([np.ones((len(rows), 1)), x[rows]])
                out += np.einsum("nk,ni,nj->kij", gamma[rows], z, z)
                continue
            gone = ~seen
            for i, (m, c) in enumerate(zip(self.means, covariance_full(self.covars, self.kind, k, d), strict=True)):
                gain = np.linalg.solve(c[np.ix_(seen, seen)], c[np.ix_(seen, gone)])
                z = np.hstack([np.ones((len(rows), 1)), x[rows]])
                z[:, 1:][:, gone] = m[gone] + (x[rows][:, seen] - m[seen]) @ gain
                out[i] += np.einsum("n,ni,nj->ij", gamma[rows, i], z, z)
                out[i, 1:, 1:][np.ix_(gone, gone)] += gamma[rows, i].sum() * (c[np.ix_(gone, gone)] - c[np.ix_(gone, seen)] @ gain)
        return out.ravel()

    def renew(self, s: np.ndarray) -> None:
        k, d = self.n_states, self.means.shape[1]
        s = s.reshape(k, d + 1, d + 1)
        n, sx, sxx = s[:, 0, 0], s[:, 0, 1:], s[:, 1:, 1:]
        means = (self.means_weight * self.means_prior + sx) / np.maximum(self.means_weight + n, 1e-300)[:, None]
        prior = self.means_weight * np.einsum("ki,kj->kij", means - self.means_prior, means - self.means_prior)
        spread = sxx - np.einsum("ki,kj->kij", sx, means) - np.einsum("ki,kj->kij", means, sx) + n[:, None, None] * np.einsum("ki,kj->kij", means, means)
        base = self.cov_prior * np.eye(d) + prior + spread
        weight = max(self.cov_weight - 1, 0)
        if self.kind == "tied":
            self.covars = (self.cov_prior * np.eye(d) + (prior + spread).sum(0)) / max(weight + n.sum(), 1e-5)
        else:
            full = base / np.maximum(weight + n, 1e-5)[:, None, None]
            self.covars = full if self.kind == "full" else np.einsum("kii->ki", full) if self.kind == "diag" else np.einsum("kii->k", full) / d
        self.means = means

    def draw(self, state: int, rng: np.random.Generator) -> list[float]:
        full = covariance_full(self.covars, self.kind, self.n_states, self.means.shape[1])[state]
        return rng.multivariate_normal(self.means[state], full).tolist()


@dataclass
class GaussianMixture(Hmm):
    """H16, an extension (the surveyed class has a constructor only): each state emits from a mixture of diagonal Gaussians."""

    n_mix: int = 2
    floor: float = 1e-3
    weights: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    means: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 0)))
    covars: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 0)))
    names = ("initial", "transit", "weights", "means", "covars")

    def start(self, df: DataFrame, obs: str) -> None:
        super().start(df, obs)
        if len(self.means):
            return
        k, m = self.n_states, self.n_mix
        flat = df.select(F.explode(obs).alias("x")).withColumn("id", F.monotonically_increasing_id())
        centres = KMeans(k * m, max_iter=20, seed=self.seed).fit(flat, "id", "x").centres
        from quillon.operators.linalg import covariance

        _, cov, _ = covariance(flat, F.col("x"))
        self.means = centres.reshape(k, m, -1)
        self.weights = np.full((k, m), 1 / m)
        self.covars = np.tile(np.diag(cov) + self.floor, (k, m, 1))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """(places, states, parts): ln weight + ln density."""
        with np.errstate(divide="ignore"):
            return np.stack([np.stack([np.log(w) + log_normal(x, mu, c, "diag") for w, mu, c in zip(ws, mus, cs, strict=True)], 1) for ws, mus, cs in zip(self.weights, self.means, self.covars, strict=True)], 1)

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        return logsumexp(self.parts(x), 2)

    def statistics(self, x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        part = self.parts(x)
        share = np.exp(part - logsumexp(part, 2)[:, :, None]) * gamma[:, :, None]
        z = np.hstack([np.ones((len(x), 1)), x, x * x])
        return np.einsum("nkm,nd->kmd", share, z).ravel()

    def renew(self, s: np.ndarray) -> None:
        d = self.means.shape[2]
        s = s.reshape(self.n_states, self.n_mix, 2 * d + 1)
        n = np.maximum(s[:, :, :1], 1e-12)
        self.weights = (n / n.sum(1, keepdims=True))[:, :, 0]
        self.means = s[:, :, 1 : d + 1] / n
        self.covars = np.maximum(s[:, :, d + 1 :] / n - self.means**2, self.floor)

    def draw(self, state: int, rng: np.random.Generator) -> list[float]:
        m = int(rng.choice(self.n_mix, p=self.weights[state]))
        return rng.normal(self.means[state, m], np.sqrt(self.covars[state, m])).tolist()
