"""Driver loops around Spark steps: iteration with a stopping rule, its history, timing, registries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass
class History:
    """(step, metric, value) of an iteration."""

    rows: list[tuple[int, str, float]] = field(default_factory=list)

    def add(self, step: int, **metrics: float) -> None:
        self.rows += [(step, k, float(v)) for k, v in metrics.items()]

    def last(self, metric: str) -> float | None:
        return next((v for _, m, v in reversed(self.rows) if m == metric), None)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step int, metric string, value double")


def iterate(step: Callable[[Any], tuple[Any, float]], state: Any, max_iter: int = 100, tol: float = 1e-4, history: History | None = None) -> tuple[Any, History]:
    """state after step(state) -> (state, change) until the change is below tol or max_iter steps were made."""
    if max_iter < 0 or tol < 0:
        raise ValueError("max_iter and tol must not be negative")
    history = history or History()
    for i in range(max_iter):
        state, change = step(state)
        history.add(i, change=change)
        if change < tol:
            break
    return state, history


def above(history: History, metric: str, threshold: float) -> bool:
    """Whether a metric's last value passed a threshold."""
    value = history.last(metric)
    return value is not None and value > threshold


def timed(run: Callable[..., Any], *args: Any, repetitions: int = 10, seed: int = 0, **kwargs: Any) -> float:
    """The mean wall time of run(*args, seed=...) over seeds that follow each other."""
    took = []
    for i in range(repetitions):
        began = time.perf_counter()
        run(*args, seed=seed + i, **kwargs)
        took.append(time.perf_counter() - began)
    return sum(took) / max(1, len(took))


def generator(seed: int | np.random.Generator | None) -> np.random.Generator:
    """A seed, a generator or nothing as a generator."""
    return seed if isinstance(seed, np.random.Generator) else np.random.default_rng(seed)


class Registry(dict):
    """Names to makers; a callable stands for itself, an unknown name is a KeyError that lists the known ones."""

    def __init__(self, genre: str, **makers: Callable[..., Any]):
        super().__init__(makers)
        self.genre = genre

    def make(self, name: str | Callable[..., Any], **parameters: Any) -> Any:
        if callable(name):
            return name(**parameters) if parameters else name
        if name not in self:
            raise KeyError(f"{name!r} is no {self.genre}; there are {', '.join(self)}")
        return self[name](**parameters)


def one_of(**given: tuple[Any, tuple]) -> None:
    """U16: KeyError for an argument that is not among its allowed values."""
    for name, (value, allowed) in given.items():
        if value not in allowed:
            raise KeyError(f"{name} is {value!r}; allowed are {', '.join(map(repr, allowed))}")
