"""Expressions on ARRAY<DOUBLE> columns: norms, products, distances, kernels. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def array_of(values: Iterable[float]) -> Column:
    """A constant array<double>."""
    return F.array(*(F.lit(float(x)) for x in values)).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    """The squared Euclidean norm."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def unit(a: Column) -> Column:
    """A / |a|; a zero vector stays null-free as zeros."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """The paired Euclidean distance."""
    return F.sqrt(sq_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    """The sum of absolute differences (the documented intent; the defective form takes one argument)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Half the squared distance of the unit vectors, which is 1 - cos; null for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


#: Metrics by name; a caller may pass any (Column, Column) -> Column instead.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "sqeuclidean": sq_distance, "manhattan": manhattan, "cosine": cosine}


def metric(name: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    if callable(name):
        return name
    if name not in METRICS:
        raise KeyError(f"{name!r} is no metric; there are {', '.join(METRICS)}")
    return METRICS[name]


# -- kernels (K00 to K10): name -> parameters -> (Column, Column) -> Column


def linear(c: float = 0.0):
    return lambda a, b: dot(a, b) + F.lit(c)


def polynomial(alpha: float = 1.0, c: float = 0.0, d: float = 3.0):
    return lambda a, b: F.pow(F.lit(alpha) * dot(a, b) + F.lit(c), F.lit(d))


def gaussian(sigma: float = 1.0):
    return lambda a, b: F.exp(-sq_distance(a, b) / F.lit(2.0 * sigma * sigma))


def exponential(sigma: float = 0.1):
    return lambda a, b: F.exp(-manhattan(a, b) / F.lit(2.0 * sigma * sigma))


def laplacian(sigma: float = 0.1):
    return lambda a, b: F.exp(-manhattan(a, b) / F.lit(sigma))


def hyperbolic_tangent(alpha: float = 1.0, c: float = 0.0):
    return lambda a, b: F.tanh(F.lit(alpha) * dot(a, b) + F.lit(c))


def rational_quadratic(c: float = 1.0):
    return lambda a, b: let(sq_distance(a, b), lambda s: F.lit(1.0) - s / (s + F.lit(c)))


def multiquadric(c: float = 1.0):
    return lambda a, b: F.sqrt(sq_distance(a, b) + F.lit(c))


def inverse_multiquadric(c: float = 1.0):
    return lambda a, b: F.lit(1.0) / F.sqrt(sq_distance(a, b) + F.lit(c))


def log(d: float = 3.0):
    powered = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(d))), F.lit(0.0), lambda s, x: s + x)
    return lambda a, b: -F.ln(powered(a, b) + F.lit(1.0))


KERNELS = {
    "linear": linear,
    "polynomial": polynomial,
    "gaussian": gaussian,
    "exponential": exponential,
    "laplacian": laplacian,
    "sigmoid": hyperbolic_tangent,
    "rational_quadratic": rational_quadratic,
    "multiquadric": multiquadric,
    "inverse_multiquadric": inverse_multiquadric,
    "log": log,
}


def kernel(name: str | Callable[[Column, Column], Column], **parameters: float) -> Callable[[Column, Column], Column]:
    """A kernel by name and parameters, or the callable itself."""
    if callable(name):
        return name
    if name not in KERNELS:
        raise KeyError(f"{name!r} is no kernel; there are {', '.join(KERNELS)}")
    return KERNELS[name](**parameters)


# -- numbers


def argmax(a: Column) -> Column:
    """The first index (from 0) of the greatest element; null for an empty array."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)


def argmin(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)).cast("int") - 1)


def logsumexp(a: Column) -> Column:
    """Ln of the sum of exponentials, shifted by the greatest element; -inf for -inf only."""
    shifted = lambda m: m + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m)))
    return let(F.array_max(a), lambda m: F.when(m == F.lit(float("-inf")), m).otherwise(shifted(m)))


def log_mask_zero(x: Column) -> Column:
    """Ln x with ln 0 = -inf (Spark's own ln(0) is null)."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def largest_divisor(n: Column) -> Column:
    """The greatest divisor of n below n itself; 1 for n = 1 and primes."""
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(1))
    return F.array_max(F.filter(F.sequence(F.lit(1), half), lambda d: n % d == 0))
