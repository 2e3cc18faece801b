"""K-Means in its three namings, Gaussian mixtures, DBSCAN and the accuracy of a clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.core.ordering import running_sum
from quillon.core.scratch import stored
from quillon.functions import vectors as V
from quillon.operators.graph import connected_components
from quillon.operators.linalg import stacked


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """struct(d, k): the squared distance to the nearest centre, and its index (the first of equals)."""
    options = [F.struct(V.sq_distance(vector, V.array_of(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    return F.array_min(F.array(*options))


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """nearest() for the rows of a matrix, a bounded number of them at a time."""
    out = np.empty(len(x), np.int64)
    at_once = max(1, 4_000_000 // max(1, centres.size))
    for at in range(0, len(x), at_once):
        gap = x[at : at + at_once, None, :] - centres[None]
        out[at : at + at_once] = (gap * gap).sum(2).argmin(1)
    return out


def assign(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """df with `cluster` and `sq_distance` to its centre."""
    found = df.withColumn("_n", nearest(F.col(vector), centres))
    return found.withColumn("cluster", F.col("_n.k")).withColumn("sq_distance", F.col("_n.d")).drop("_n")


def initial_centres(df: DataFrame, id_col: str, vector: str, k: int, init: str | np.ndarray = "k++", seed: int = 0) -> np.ndarray:
    """Given centres, 'random' ones uniform in the features' bounds, or 'k++'.

    k++ draws each next centre with probability in proportion to the distance (not its square) to the nearest
    centre so far. The draw is one aggregation: of all rows, the one with the greatest ln(u) / distance, u a hash
    of the id and the seed as a uniform number; that is the same weighted draw.
    """
    if not isinstance(init, str):
        return np.asarray(init, float)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    if init == "random":
        span = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("dim").collect()
        low, high = np.array([r["a"] for r in span]), np.array([r["b"] for r in span])
        return np.random.default_rng(seed).uniform(low, high, (k, len(low)))
    if init != "k++":
        raise KeyError(f"{init!r} is no way to start; there are 'k++' and 'random'")
    centres: list[list[float]] = []
    for step in range(k):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(step), "id"), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        weight = F.sqrt(nearest(F.col("v"), np.array(centres))["d"]) if centres else F.lit(1.0)
        scored = rows.withColumn("w", weight).where("w > 0").select("v", (F.ln(u) / F.col("w")).alias("s"), "id")
        best = scored.agg(F.max_by("v", F.struct("s", "id")).alias("v")).first()["v"]
        if best is None:
            break
        centres.append(best)
    return np.array(centres)


@dataclass
class KMeans:
    """Lloyd's iterations. 'elkan' and 'hamerly' name the same result: their bounds save distances to a
    few centres, which cost less here than carrying the bounds through a shuffle would.

    inertia adds distances for 'lloyd' and squared distances for the other two; both are kept.
    """

    k: int = 8
    init: str | np.ndarray = "k++"
    algorithm: str = "lloyd"
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    centres: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    history: list[float] = field(default_factory=list)

    def step(self, df: DataFrame, id_col: str, vector: str, centres: np.ndarray, weight: Column) -> np.ndarray:
        """Weighted means of the clusters; an empty one takes a row far from its centre, the i-th empty the i-th farthest."""
        k, d = centres.shape

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, d + 2))  # rows, weight and weighted sums of each cluster
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, w = stacked(batch.column(0)), batch.column(1).to_numpy()
                own = nearest_rows(x, centres)
                z = np.hstack([np.ones((len(x), 1)), w[:, None], x * w[:, None]])
                for c in np.unique(own):
                    total[c] += z[own == c].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["cells"])

        rows = df.where(F.col(vector).isNotNull()).select(vector, weight.cast("double").alias("_w"))
        cells = rows.mapInArrow(partial, "cells array<double>").select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not cells:
            return centres
        sums = np.array([r["v"] for r in cells]).reshape(k, d + 2)
        new = np.where(sums[:, 1:2] > 0, sums[:, 2:] / np.maximum(sums[:, 1:2], 1e-300), centres)
        empty = np.flatnonzero(sums[:, 0] == 0)
        if len(empty):
            far = assign(df, vector, centres).orderBy(F.col("sq_distance").desc(), id_col).select(vector).limit(len(empty)).collect()
            for c, r in zip(empty, far, strict=False):
                new[c] = r[0]
        return new

    def fit(self, df: DataFrame, id_col: str, vector: str, weight: str | None = None) -> KMeans:
        if self.algorithm not in ("lloyd", "elkan", "hamerly"):
            raise KeyError(f"{self.algorithm!r} is no algorithm")
        w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
        rows = df.select(id_col, vector, *([weight] if weight else [])).persist()
        self.centres = initial_centres(rows, id_col, vector, self.k, self.init, self.seed)
        for _ in range(self.max_iter):
            new = self.step(rows, id_col, vector, self.centres, w)
            moved = float(np.sqrt(((new - self.centres) ** 2).sum(1)).sum())
            self.centres = new
            self.history.append(moved)
            if moved < self.tol:
                break
        rows.unpersist()
        return self

    def transform(self, df: DataFrame, vector: str) -> DataFrame:
        return assign(df, vector, self.centres)


def greedy_accuracy(counts: list[tuple[object, object, int]]) -> float:
    """The share of rows on cells taken greedily from the (truth, cluster) table, each row and column once."""
    left, total, hit = sorted(counts, key=lambda c: (-c[2], str(c[0]), str(c[1]))), sum(c[2] for c in counts), 0
    while left:
        truth, cluster, n = left[0]
        hit += n
        left = [c for c in left if c[0] != truth and c[1] != cluster]
    return hit / total if total else 0.0


def cluster_accuracy(df: DataFrame, truth: str, cluster: str) -> float:
    """D14 over a DataFrame: only the table of counts is collected."""
    rows = df.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("n")).collect()
    return greedy_accuracy([(r[0], r[1], r[2]) for r in rows])


# -- DBSCAN


def epsilon_pairs(df: DataFrame, id_col: str, vector: str, eps: float, dims: int, rows_a_block: int = 4_000) -> DataFrame:
    """(a, b) ids within eps of each other, both ways and each with itself: a band join over grid cells.

    Distances are those of whole vectors. The grid is laid over the first dims components only, which are never
    farther apart than the vectors: cells have side eps, so partners lie in the 3^dims cells around; rows stay in their cell and
    are compared with copies dealt to the neighbours. Both sides of a cell are cut into blocks, so a task compares two blocks
    however many rows a cell holds: one matrix product finds the candidates, differences decide.
    """
    cells = F.transform(F.slice(vector, 1, dims), lambda x: F.floor(x / F.lit(eps)))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), cells.alias("cell"))
    around = rows
    for d in range(dims):
        shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        around = around.withColumn("_s", shift)
        around = around.withColumn("cell", _shifted(d)).drop("_s")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(rows_a_block))
    home = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("own"))
    sizes = stored(around.groupBy("cell").agg(F.count(F.lit(1)).alias("met")).join(home, "cell").select("cell", blocks("own").alias("own"), blocks("met").alias("met")), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = lambda side, n: side.join(sizes, "cell").withColumn("_at", F.pmod(F.xxhash64("id"), F.col(n)))
    left = placed(rows, "own").select("cell", F.col("_at").alias("i"), each("met").alias("j"), F.lit(0).alias("side"), "id", "v")
    right = placed(around, "met").select("cell", each("own").alias("i"), F.col("_at").alias("j"), F.lit(1).alias("side"), "id", "v")

    def near(part: pa.Table) -> pa.Table:
        mine, theirs = (part.filter(pc.equal(part["side"], side)) for side in (0, 1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(mine) and len(theirs):
            x, y = stacked(mine["v"]), stacked(theirs["v"])
            norms = (y * y).sum(1)
            for at in range(0, len(x), 500):
                some = x[at : at + 500]
                own = (some * some).sum(1)
                slack = 1e-9 * (1 + own[:, None] + norms[None, :])  # more than the product's rounding
                i, j = np.nonzero(own[:, None] + norms[None, :] - 2 * some @ y.T <= eps * eps + slack)
                for k in range(0, len(i), 100_000):
                    p, q = i[k : k + 100_000], j[k : k + 100_000]
                    close = np.sqrt(((some[p] - y[q]) ** 2).sum(1)) <= eps
                    found.append((p[close] + at, q[close]))
        i, j = (np.concatenate([f[n] for f in found] or [np.empty(0, int)]) for n in (0, 1))
        return pa.table({"a": mine["id"].take(pa.array(i)), "b": theirs["id"].take(pa.array(j))})

    kind = df.schema[id_col].dataType.simpleString()
    return left.unionAll(right).groupBy("cell", "i", "j").applyInArrow(near, f"a {kind}, b {kind}")


def _shifted(dim: int) -> Column:
    return F.transform("cell", lambda c, i: F.when(i == dim, c + F.col("_s")).otherwise(c))


def dbscan(df: DataFrame, id_col: str, vector: str, eps: float = 0.5, min_samples: int = 5, dims: int = 2) -> DataFrame:
    """(id, core, cluster): clusters are numbered by their least core id, noise is -1.

    A row is core if min_samples rows, itself included, lie within eps. Core rows within eps share a cluster; a
    border row joins the lowest-numbered cluster next to it. Vectors count whole; dims is that of the search grid.
    """
    near = stored(epsilon_pairs(df, id_col, vector, eps, dims), "near")
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("id"))
    inside = near.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b").select("a", "b")
    linked = connected_components(inside.where("a < b"), "dbscan")
    roots = core.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    numbers = running_sum(roots.select("root").distinct(), ["root"], out="cluster").select("root", (F.col("cluster") - 1).cast("int").alias("cluster"))
    cored = roots.join(numbers, "root").select("id", "cluster")
    border = near.join(cored.select(F.col("id").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("border"))
    rows = df.select(F.col(id_col).alias("id")).join(cored, "id", "left").join(border, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.col("cluster").isNotNull().alias("core"), F.coalesce("cluster", "border", F.lit(-1)).cast("int").alias("cluster"))


# -- Gaussian mixtures


def log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, kind: str = "full") -> np.ndarray:
    """Log densities of rows under one Gaussian; kinds full, tied (a matrix), diag (a vector), spherical (a number).

    A matrix that is not positive definite gets 1e-7 on its diagonal; if that does not help, ValueError.
    """
    d = x.shape[1]
    if kind in ("diag", "spherical"):
        var = np.maximum(np.broadcast_to(np.asarray(cov, float), (d,)), np.finfo(float).tiny)
        return -0.5 * (d * np.log(2 * np.pi) + np.log(var).sum() + ((x - mean) ** 2 / var).sum(1))
    if kind not in ("full", "tied"):
        raise KeyError(f"{kind!r} is no kind of covariance")
    for jitter in (0.0, 1e-7):
        try:
            low = np.linalg.cholesky(cov + jitter * np.eye(d))
        except np.linalg.LinAlgError:
            continue
        z = np.linalg.solve(low, (x - mean).T)
        return -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(low)).sum()
    raise ValueError("the covariance is not positive definite")


def covariance_as(tied: np.ndarray, kind: str, n: int) -> np.ndarray:
    """One full matrix as the parameters of n components of a kind."""
    d = len(tied)
    if kind == "spherical":
        return np.full(n, np.trace(tied) / d)
    if kind == "diag":
        return np.tile(np.diag(tied), (n, 1))
    if kind == "tied":
        return tied
    if kind == "full":
        return np.tile(tied, (n, 1, 1))
    raise KeyError(f"{kind!r} is no kind of covariance")


def covariance_full(cov: np.ndarray, kind: str, n: int, d: int) -> np.ndarray:
    """The n full matrices that parameters of a kind stand for."""
    cov = np.asarray(cov, float)
    if kind == "spherical":
        return cov[:, None, None] * np.eye(d)
    if kind == "diag":
        return np.stack([np.diag(c) for c in cov])
    return np.tile(cov, (n, 1, 1)) if kind == "tied" else cov


@dataclass
class GaussianMixture:
    """EM with full covariances that start as the identity."""

    k: int = 8
    init: str | np.ndarray = "k++"
    max_iter: int = 100
    tol: float = 1e-4
    seed: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    means: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    covariances: np.ndarray = field(default_factory=lambda: np.empty((0, 0, 0)))

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.log(w) + log_normal(x, m, c) for w, m, c in zip(self.weights, self.means, self.covariances, strict=True)], 1)

    def sums(self, df: DataFrame, vector: str) -> tuple[np.ndarray, float]:
        """One pass: per component the sums of g, g x and g x x', and the log likelihood."""
        model = self

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, score = None, 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = stacked(batch.column(0))
                joint = model.log_joint(x)
                top = joint.max(1, keepdims=True)
                norm = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
                g = np.exp(joint - norm)
                score += float(norm.sum())
                z = np.hstack([np.ones((len(x), 1)), x])
                part = np.einsum("nk,ni,nj->kij", g, z, z)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([score])], ["cells", "score"])

        parts = df.select(vector).where(F.col(vector).isNotNull()).mapInArrow(partial, "cells array<double>, score double")
        cells = parts.select(F.posexplode(F.concat("cells", F.array("score"))).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.array([r["v"] for r in cells])
        d = self.means.shape[1] + 1
        return flat[:-1].reshape(self.k, d, d), float(flat[-1])

    def fit(self, df: DataFrame, id_col: str, vector: str) -> GaussianMixture:
        rows = df.select(id_col, vector).persist()
        self.means = initial_centres(rows, id_col, vector, self.k, self.init, self.seed)
        self.k, d = self.means.shape
        self.weights, self.covariances = np.full(self.k, 1 / self.k), np.tile(np.eye(d), (self.k, 1, 1))
        for _ in range(self.max_iter):
            s, _ = self.sums(rows, vector)
            n = np.maximum(s[:, 0, 0], 1e-12)
            means = s[:, 0, 1:] / n[:, None]
            moved = float(np.sqrt(((means - self.means) ** 2).sum(1)).mean())
            self.covariances = s[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :] + 1e-9 * np.eye(d)
            self.means, self.weights = means, n / n.sum()
            if moved < self.tol:
                break
        rows.unpersist()
        return self

    def log_likelihood(self, df: DataFrame, vector: str) -> float:
        return self.sums(df, vector)[1]

    def responsibilities(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        """(id, g array, cluster): cluster is the most likely component, the first of equals."""
        model, kind = self, df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                joint = model.log_joint(stacked(batch.column(1)))
                g = np.exp(joint - joint.max(1, keepdims=True))
                g /= g.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g.tolist(), pa.list_(pa.float64())), pa.array(g.argmax(1), pa.int32())], [id_col, "g", "cluster"])

        return df.select(id_col, vector).mapInArrow(run, f"`{id_col}` {kind}, g array<double>, cluster int")
