"""Samplers and generators of test data (P01 to P08): one chain or block for each input row, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def chains(spark: SparkSession, n_chains: int, per_chain: int, draw: Callable[[np.random.Generator, int], np.ndarray], seed: int = 0) -> DataFrame:
    """(chain, step, x): per_chain draws of each of n_chains independent chains, each with its own seed.

    draw(rng, n) gives n rows of one chain. A chain is sequential; chains are spread over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for chain in part.id:
                x = np.atleast_2d(draw(np.random.default_rng([seed, int(chain)]), per_chain))
                yield pd.DataFrame({"chain": int(chain), "step": range(len(x)), "x": list(x.astype(float))})

    return spark.range(n_chains).repartition(max(1, min(n_chains, 64))).mapInPandas(run, "chain int, step int, x array<double>")


def rejection(p: Callable[[np.ndarray], np.ndarray], q: Callable[[np.ndarray], np.ndarray], propose: Callable[[np.random.Generator, int], np.ndarray], k: float, domain: np.ndarray):
    """A draw function that keeps proposals with probability p / (k q); ValueError unless p <= k q on the domain."""
    if (p(domain) > k * q(domain) + 1e-12).any():
        raise ValueError("p must not exceed k times q")

    def draw(rng: np.random.Generator, n: int) -> np.ndarray:
        kept: list[np.ndarray] = []
        have = 0
        while have < n:
            x = propose(rng, max(64, 2 * (n - have)))
            x = x[rng.random(len(x)) * k * q(x) < p(x)]
            kept.append(x)
            have += len(x)
        return np.concatenate(kept)[:n, None]

    return draw


def metropolis(log_p: Callable[[np.ndarray], float], start: np.ndarray, scale: float, burn_in: int = 0, accepted_only: bool = False):
    """A Metropolis chain with normal steps. A rejected step repeats the state; accepted_only leaves repeats out,
    which is not a sample of the target."""

    def draw(rng: np.random.Generator, n: int) -> np.ndarray:
        x, out = np.array(start, float), []
        here = log_p(x)
        skipped = 0
        while len(out) < n:
            near = x + rng.normal(0, scale, x.shape)
            there = log_p(near)
            moved = np.log(rng.random()) < there - here
            if moved:
                x, here = near, there
            if moved or not accepted_only:
                if skipped < burn_in:
                    skipped += 1
                else:
                    out.append(x.copy())
        return np.array(out)

    return draw


def gibbs_ball(dimension: int, radius: float = 1.0, burn_in: int = 0):
    """Uniform in a ball, one coordinate at a time from the chord that the others leave."""

    def draw(rng: np.random.Generator, n: int) -> np.ndarray:
        x, out = np.zeros(dimension), np.empty((n, dimension))
        for step in range(n + burn_in):
            for i in range(dimension):
                half = np.sqrt(max(0.0, radius**2 - (x @ x - x[i] ** 2)))
                x[i] = rng.uniform(-half, half)
            if step >= burn_in:
                out[step - burn_in] = x
        return out

    return draw


# -- test data, seeded


def noisy_sine(size: int, low: float = 0.0, high: float = 1.0, noise: float = 0.1, seed: int = 0) -> pd.DataFrame:
    """Id, x, y = sin(2 pi x) + noise."""
    rng = np.random.default_rng(seed)
    x = np.linspace(low, high, size)
    return pd.DataFrame({"id": range(size), "x": x, "y": np.sin(2 * np.pi * x) + rng.normal(0, noise, size)})


def blobs(size: int, classes: int, dims: int = 2, sigma: float = 0.7, seed: int = 0) -> pd.DataFrame:
    """Isotropic classes around random centres."""
    rng = np.random.default_rng(seed)
    centres, label = rng.normal(0, 3, (classes, dims)), rng.integers(0, classes, size)
    return pd.DataFrame({"id": range(size), "features": list(centres[label] + rng.normal(0, sigma, (size, dims))), "label": label})


def cakes(size: int, classes: int, low: float = 0.0, high: float = 5.0, same: bool = True, noise: float = 0.0, seed: int = 0) -> pd.DataFrame:
    """Pie slices between two radii; without `same` the radii shift from class to class."""
    rng = np.random.default_rng(seed)
    label = np.arange(size) % classes
    angle = (label + rng.random(size)) * 2 * np.pi / classes
    r = rng.uniform(low, high, size) + (0 if same else label)
    xy = np.stack([r * np.cos(angle), r * np.sin(angle)], 1) + rng.normal(0, noise, (size, 2))
    return pd.DataFrame({"id": range(size), "features": list(xy), "label": label})


def whirlpool(size: int, low: float = 0.0, high: float = 4.0, seed: int = 0) -> pd.DataFrame:
    """Two arms of a spiral."""
    rng = np.random.default_rng(seed)
    t, label = rng.uniform(low, high, size), np.arange(size) % 2
    angle = t + np.pi * label
    return pd.DataFrame({"id": range(size), "features": list(np.stack([t * np.cos(angle), t * np.sin(angle)], 1)), "label": label})


def strands(count: int, size: int, acid: str = "DNA", weights: list[float] | None = None, motif: str = "", seed: int = 0) -> pd.DataFrame:
    """Random sequences over A, T (U in RNA), G, C, each with the motif at a random place if there is one."""
    rng = np.random.default_rng(seed)
    letters = list("AUGC" if acid == "RNA" else "ATGC")
    rows = []
    for i in range(count):
        s = "".join(rng.choice(letters, size, p=weights))
        if motif:
            at = int(rng.integers(0, size - len(motif) + 1))
            s = s[:at] + motif + s[at + len(motif) :]
        rows.append((i, s))
    return pd.DataFrame(rows, columns=["id", "seq"])
