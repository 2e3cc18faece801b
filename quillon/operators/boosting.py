"""Combining models that are already fitted, given as columns of their outputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.linalg import moments


def combined(outputs: list[str], alpha: np.ndarray) -> Column:
    """The linear combination of models' outputs."""
    total = F.lit(0.0)
    for name, a in zip(outputs, alpha, strict=True):
        total = total + F.lit(float(a)) * F.col(name)
    return total


def masked(vector: Column, mask: list[int]) -> Column:
    """The features that one model is shown."""
    return F.array(*(vector[i] for i in mask))


def l2_boost(df: DataFrame, outputs: list[str], y: str, rounds: int = 10) -> np.ndarray:
    """Each round adds to the model h with the greatest <r, h> / |h| (signed) the step <r, h> / |h|^2.

    Inner products of outputs and target are summed once; the rounds work on those K x K numbers.
    """
    m = moments(df, F.array(*(F.col(c).cast("double") for c in outputs)), F.array(F.col(y).cast("double")))
    alpha, size = np.zeros(len(outputs)), np.diag(m.xx)
    for _ in range(rounds):
        left = m.xy[:, 0] - m.xx @ alpha
        best = int(np.argmax(left / np.sqrt(size)))
        alpha[best] += left[best] / size[best]
    return alpha


def _patterns(df: DataFrame, outputs: list[str], y: str) -> DataFrame:
    """Rows that agree in all outputs and the label, counted once; kept, since every round sums over them."""
    return df.groupBy(*(F.col(c).cast("double").alias(c) for c in outputs), F.col(y).cast("double").alias(y)).agg(F.count(F.lit(1)).alias("_n")).persist()


def _score(outputs: list[str], alpha: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, a in zip(outputs, alpha, strict=True):
        total = total + F.lit(float(a)) * F.col(c)
    return total


def ada_boost(df: DataFrame, outputs: list[str], y: str, rounds: int = 10) -> np.ndarray:
    """B03, an extension (only a constructor was asked for): AdaBoost over outputs and labels in {-1, 1}.

    A row's weight follows from the sum so far, exp(-y * sum of alpha h), so a round is one aggregation and only the
    errors of the outputs come back.
    """
    rows, alpha = _patterns(df, outputs, y), np.zeros(len(outputs))
    for _ in range(rounds):
        w = F.col("_n") * F.exp(-F.col(y) * _score(outputs, alpha))
        sums = rows.agg(F.sum(w), *(F.sum(F.when(F.col(c) != F.col(y), w).otherwise(0.0)) for c in outputs)).first()
        if sums[0] is None:
            break
        errors = np.array(sums[1:]) / sums[0]
        best = int(np.argmin(errors))
        e = float(np.clip(errors[best], 1e-12, 1 - 1e-12))
        if e >= 0.5:
            break
        alpha[best] += 0.5 * np.log((1 - e) / e)
    rows.unpersist()
    return alpha


def logit_boost(df: DataFrame, outputs: list[str], y: str, rounds: int = 10) -> np.ndarray:
    """B04, an extension like B03: each round fits the working response of the logistic loss by one output.

    Labels are in {-1, 1}; the score is the sum of alpha h and P(y = 1) = 1 / (1 + exp(-2 score)). A round is one
    aggregation: the loss left by an output is sum w z^2 - (sum w z h)^2 / sum w h^2.
    """
    rows, alpha = _patterns(df, outputs, y), np.zeros(len(outputs))
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * _score(outputs, alpha)))
        working = rows.withColumn("_p", p).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-10)) * F.col("_n"))
        z = ((F.col(y) + 1) / 2 - F.col("_p")) * F.col("_n") / F.col("_w")
        working = working.withColumn("_z", F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z)))
        wz = F.col("_w") * F.col("_z")
        sums = working.agg(*(F.sum(wz * F.col(c)) for c in outputs), *(F.sum(F.col("_w") * F.col(c) * F.col(c)) for c in outputs)).first()
        if sums[0] is None:
            break
        cross, size = np.array(sums[: len(outputs)]), np.maximum(np.array(sums[len(outputs) :]), 1e-300)
        best = int(np.argmax(cross * cross / size))
        alpha[best] += cross[best] / size[best] / 2
    rows.unpersist()
    return alpha
