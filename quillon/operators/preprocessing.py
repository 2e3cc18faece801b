"""Scaling, encoding, bases, splits and batches over DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.core.ordering import running_sum
from quillon.functions import vectors as V


def sample_weight(weight: str | None) -> Column:
    """A weight column with nulls as 1, or ones where there is none."""
    return F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))


def squared_error(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """One row (mse, rmse), weighted if a weight column is named; nulls for an empty table."""
    w, e = sample_weight(weight), F.col(truth) - F.col(predicted)
    mse = F.try_divide(F.sum(w * e * e), F.sum(w))
    return df.agg(mse.alias("mse")).select("mse", F.sqrt("mse").alias("rmse"))


def bounds(df: DataFrame, vector: str, margin: float = 0.01) -> DataFrame:
    """Per feature (dim, low, high), widened on either side by margin times the range."""
    long = df.select(F.posexplode(vector).alias("dim", "x"))
    span = long.groupBy("dim").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    wide = (F.col("most") - F.col("least")) * F.lit(margin)
    return span.select("dim", (F.col("least") - wide).alias("low"), (F.col("most") + wide).alias("high"))


def grid(limits: DataFrame, n: int) -> DataFrame:
    """N evenly spaced points for every row of bounds(), both ends included."""
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    points = limits.select("dim", "low", "high", at.alias("step"))
    return points.select("dim", "step", (F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / F.lit(max(1, n - 1))).alias("x"))


def _over(df: DataFrame, value: str, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """df with group statistics joined on: partial sums before a shuffle, where a window would send a group to one task."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in stats.items()))))  # one row
    found = df.groupBy(*by).agg(*(c.alias(k) for k, c in stats.items()))
    renamed = found.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), *stats)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(renamed, condition).drop(*(f"_g{i}" for i in range(len(by))))


def normalise(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "normalised") -> DataFrame:
    """The value over the sum of its group (null where that is 0)."""
    found = _over(df, value, by, {"_sum": F.sum(value)})
    return found.withColumn(out, F.try_divide(F.col(value), F.col("_sum"))).drop("_sum")


def standardise(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    """(value - min) / (max - min) of its group, 0 where all are equal."""
    found = _over(df, value, by, {"_min": F.min(value), "_max": F.max(value)})
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min")), F.when(F.col(value).isNotNull(), F.lit(0.0)))
    return found.withColumn(out, scaled).drop("_min", "_max")


def log_normalise(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "log_normalised") -> DataFrame:
    """The value less the logarithm of its group's sum of exponentials, shifted by the group's maximum."""
    found = _over(df, value, by, {"_max": F.max(value)})
    shifted = found.withColumn("_e", F.exp(F.col(value) - F.col("_max")))
    total = _over(shifted, "_e", by, {"_sum": F.sum("_e")})
    return total.withColumn(out, F.col(value) - F.col("_max") - F.ln("_sum")).drop("_max", "_e", "_sum")


def categories(df: DataFrame, column: str, origin: int = 0) -> DataFrame:
    """(value, code), codes running from origin in the order of the values; nulls have no code.

    One row for each distinct value, numbered by ranges of values.
    """
    distinct = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return running_sum(distinct, ["value"], out="code").select("value", (F.col("code") - 1 + origin).cast("int").alias("code"))


def encode(df: DataFrame, column: str, origin: int = 0, out: str = "code") -> DataFrame:
    """Df with the codes of a column (null for null)."""
    codes = categories(df, column, origin)
    return df.join(codes.select(F.col("value").alias("_v"), F.col("code").alias(out)), F.col(column) == F.col("_v"), "left").drop("_v")


def decode(df: DataFrame, code: str, codes: DataFrame, out: str = "value") -> DataFrame:
    """The reverse of encode()."""
    return df.join(codes.select(F.col("value").alias(out), F.col("code").alias("_c")), F.col(code) == F.col("_c"), "left").drop("_c")


def one_hot(code: Column, n: int, origin: int = 0) -> Column:
    """An array of n zeros with a 1 at the code."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + origin == code).cast("int"))


def inverse_permutation(df: DataFrame, index: str, value: str) -> DataFrame:
    """The permutation that undoes index -> value."""
    return df.select(F.col(value).alias(index), F.col(index).alias(value))


# -- bases: a function of (x, parameters) for every combination of parameter lists, then side by side


def _combined(vector: Column, bases: list[Callable[[Column], Column]], bias: bool) -> Column:
    parts = [F.transform(vector, b) for b in bases]
    return F.concat(*([V.array_of([1.0])] if bias else []), *parts)


def _bell(m: float, s: float) -> Callable[[Column], Column]:
    return lambda x: F.exp(-(x - F.lit(m)) * (x - F.lit(m)) / F.lit(2.0 * s * s))


def _step(m: float, s: float) -> Callable[[Column], Column]:
    return lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - F.lit(m)) / F.lit(s)))


def _power(e: float) -> Callable[[Column], Column]:
    return lambda x: F.pow(x, F.lit(float(e)))


def gaussian_basis(vector: Column, mu: Sequence[float], sigma: Sequence[float], bias: bool = True) -> Column:
    """exp(-(x - mu)^2 / (2 sigma^2)) for all pairs of mu and sigma (D27), after a bias of 1."""
    return _combined(vector, [_bell(m, s) for m, s in itertools.product(mu, sigma)], bias)


def sigmoid_basis(vector: Column, mu: Sequence[float], sigma: Sequence[float], bias: bool = True) -> Column:
    """1 / (1 + exp(-(x - mu) / sigma))."""
    return _combined(vector, [_step(m, s) for m, s in itertools.product(mu, sigma)], bias)


def polynomial_basis(vector: Column, exponent: Sequence[float], bias: bool = True) -> Column:
    """X to each exponent."""
    return _combined(vector, [_power(e) for e in exponent], bias)


def identity_basis(vector: Column, bias: bool = True) -> Column:
    """X itself."""
    return _combined(vector, [lambda x: x], bias)


#: D32
BASES = {"gaussian": gaussian_basis, "sigmoid": sigmoid_basis, "polynomial": polynomial_basis, "none": identity_basis}


def basis(name: str, **parameters) -> Callable[[Column], Column]:
    if name not in BASES:
        raise KeyError(f"{name!r} is no basis; there are {', '.join(BASES)}")
    return lambda vector: BASES[name](vector, **parameters)


# -- splits and batches


def train_test_split(df: DataFrame, id_col: str, test: float | int = 0.3, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Df with `fold`, 'test' for an exact number of rows and 'train' for the others.

    A fraction is rounded up, as is usual; a whole number is the number of test rows. Rows are taken in the order
    of a seeded hash of their id (ties by id), in each stratum if a column is named. The place of a row in that
    order is counted in two levels, so no task numbers the whole table.
    """
    by = [stratify] if stratify else []
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), id_col)).withColumn("_run", F.shiftrightunsigned("_h", 52))
    counts = hashed.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = counts.select(*by, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"))
    inside = Window.partitionBy(*by, "_run").orderBy(F.shiftrightunsigned("_h", 1), id_col)
    ranked = hashed.withColumn("_in", F.row_number().over(inside)).join(offsets, [*by, "_run"])
    most = F.lit(int(test)) if isinstance(test, int) else F.ceil(F.col("_all") * F.lit(float(test)))
    return ranked.withColumn("fold", F.when(F.col("_before") + F.col("_in") <= most, "test").otherwise("train")).drop("_h", "_run", "_in", "_before", "_all")


def folds(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """Df with `fold` 0 .. k - 1 from a seeded hash of the id."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(k)).cast("int"))


def cross_validation(df: DataFrame, id_col: str, k: int, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], float], seed: int = 0) -> float:
    """The mean score over k folds, each scored by the model fitted on all the others."""
    dealt = folds(df, id_col, k, seed)
    return sum(score(fit(dealt.where(F.col("fold") != i)), dealt.where(F.col("fold") == i)) for i in range(k)) / k


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """Df with the number of the contiguous batch that a position (from 0) falls in."""
    return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def sequence_bounds(df: DataFrame, seq_id: str, length: str) -> DataFrame:
    """(start, end) of each sequence when sequences of given lengths lie end to end, in the order of their ids."""
    ends = running_sum(df.select(seq_id, F.col(length).cast("long").alias("_length")), [seq_id], F.col("_length"), "end")
    return ends.select(seq_id, (F.col("end") - F.col("_length")).alias("start"), "end")


def cdf(df: DataFrame, value: str, by: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """(by..., value, share): the share of rows that are <= each distinct value (>= with reverse).

    Values are counted first, so the running sum sees one row for each distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(value).desc() if reverse else F.col(value).asc()
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*by, value, (F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy(*by))).alias("share"))


def error_rates(df: DataFrame, label: str, score: str, num: int = 50) -> DataFrame:
    """(threshold, false_rejections, false_acceptances) at num thresholds between the least and greatest score.

    A positive (label 1) is falsely rejected below the threshold, a negative falsely accepted at or above it.
    Scores are first counted in the num - 1 intervals between thresholds; rates are running sums of these counts.
    """
    span = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    step = (F.col("_high") - F.col("_low")) / F.lit(num - 1)
    at = F.when(step == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(score) - F.col("_low")) / step), F.lit(num - 1))).cast("int")
    counted = df.crossJoin(F.broadcast(span)).select(at.alias("step"), (F.col(label) == 1).cast("long").alias("p")).groupBy("step").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("n"))
    steps = span.select(F.explode(F.sequence(F.lit(0), F.lit(num - 1))).alias("step"), (F.col("_low")).alias("low"), step.alias("size"))
    rows = steps.join(counted, "step", "left").select("step", "low", "size", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    below, all_ = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return rows.select(
        (F.col("low") + F.col("size") * F.col("step")).alias("threshold"),
        F.try_divide(F.coalesce(F.sum("p").over(below), F.lit(0)), F.sum("p").over(all_)).alias("false_rejections"),
        (F.lit(1.0) - F.try_divide(F.coalesce(F.sum("n").over(below), F.lit(0)), F.sum("n").over(all_))).alias("false_acceptances"),
    )
