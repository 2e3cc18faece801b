"""Feed-forward networks: activations, losses, regularisers, optimisers, layers, training.

Formulas that act on columns are expressions. Optimiser rules are written once over plain arithmetic, so the same
rule updates numpy weights and folds over a column. Layers are numpy over batches; scoring streams in Arrow
batches, and training is by mini-batches on the driver, which holds a bounded number of rows at a time, or by full-batch
gradients summed in Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.core.scratch import stored
from quillon.functions import vectors as V
from quillon.operators.linalg import stacked

# -- activations on array columns


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _softmax(a: Column) -> Column:
    return V.let(F.transform(a, lambda x: F.exp(x - F.array_max(a))), lambda e: F.transform(e, lambda x: x / V.total(e)))


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda a: a,
    "softmax": _softmax,
    "tanh": lambda a: F.transform(a, F.tanh),
    "relu": lambda a: F.transform(a, lambda x: F.greatest(x, F.lit(0.0))),
    "sigmoid": lambda a: F.transform(a, _sigmoid),
}
#: Derivatives of the element-wise ones.
DERIVATIVES: dict[str, Callable[[Column], Column]] = {
    "linear": lambda a: F.transform(a, lambda x: F.lit(1.0)),
    "tanh": lambda a: F.transform(a, lambda x: F.lit(1.0) - F.tanh(x) * F.tanh(x)),
    "relu": lambda a: F.transform(a, lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))),
    "sigmoid": lambda a: F.transform(a, lambda x: _sigmoid(x) * (F.lit(1.0) - _sigmoid(x))),
}

# -- losses and metrics over a table


def _entropy(truth: Column, predicted: Column) -> Column:
    return -F.aggregate(F.zip_with(truth, predicted, lambda t, p: t * F.ln(p + F.lit(1e-7))), F.lit(0.0), lambda s, x: s + x)


LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "mean_squared_error": V.sq_distance,
    "categorical_crossentropy": _entropy,
    "softmax_categorical_crossentropy": _entropy,
}
GRADIENTS: dict[str, Callable[[Column, Column], Column]] = {
    "mean_squared_error": lambda t, p: F.zip_with(p, t, lambda a, b: a - b),
    "categorical_crossentropy": lambda t, p: F.zip_with(t, p, lambda a, b: -a / (b + F.lit(1e-7))),
    "softmax_categorical_crossentropy": lambda t, p: F.zip_with(p, t, lambda a, b: a - b),
}


def categorical_accuracy(truth: Column, predicted: Column) -> Column:
    """1.0 where the greatest entries stand at the same place."""
    return (V.argmax(truth) == V.argmax(predicted)).cast("double")


# -- regularisers (N23): (loss, gradient) of a weight


def regulariser(name: str, l1: float = 0.01, l2: float = 0.01) -> tuple[Callable, Callable]:
    kinds = {"none": (0.0, 0.0), "l1": (l1, 0.0), "l2": (0.0, l2), "l1l2": (l1, l2)}
    if name not in kinds:
        raise KeyError(f"{name!r} is no regulariser; there are {', '.join(kinds)}")
    a, b = kinds[name]

    def loss(w):
        return F.abs(w) * F.lit(a) + w * w * F.lit(b) if isinstance(w, Column) else a * np.abs(w).sum() + b * (w * w).sum()

    def gradient(w):
        return F.signum(w) * F.lit(a) + w * F.lit(2 * b) if isinstance(w, Column) else a * np.sign(w) + 2 * b * w

    return loss, gradient


# -- optimisers

NUMPY = SimpleNamespace(sqrt=np.sqrt, maximum=np.maximum, abs=np.abs)
COLUMNS = SimpleNamespace(sqrt=F.sqrt, maximum=F.greatest, abs=F.abs)


@dataclass(frozen=True)
class Optimiser:
    """rule(w, g, state, t, math) -> (w, state) for step t = 1, 2, ...; slots says how many state values there are."""

    slots: int
    rule: Callable
    decay: float = 0.0
    clipnorm: float | None = None
    clipvalue: float | None = None

    def clipped(self, grads: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients scaled to a norm and cut to a value, where asked for."""
        if self.clipnorm is not None:
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            if norm > self.clipnorm:
                grads = [g * (self.clipnorm / norm) for g in grads]
        return [np.clip(g, -self.clipvalue, self.clipvalue) for g in grads] if self.clipvalue is not None else grads


def paced(rate: float, decay: float, t):
    """The learning rate of step t."""
    return rate / (1.0 + decay * (t - 1))


def gradient_descent(learning_rate: float = 0.01, decay: float = 0.0, **kw) -> Optimiser:
    return Optimiser(0, lambda w, g, s, t, m: (w - g * paced(learning_rate, decay, t), []), decay, **kw)


def sgd(learning_rate: float = 0.01, momentum: float = 0.0, nesterov: bool = False, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        step = g * paced(learning_rate, decay, t)
        v = s[0] * momentum - step
        return (w + v * momentum - step if nesterov else w + v), [v]

    return Optimiser(1, rule, decay, **kw)


def rmsprop(learning_rate: float = 0.001, rho: float = 0.9, epsilon: float = 1e-7, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        a = s[0] * rho + g * g * (1 - rho)
        return w - g * paced(learning_rate, decay, t) / (m.sqrt(a) + epsilon), [a]

    return Optimiser(1, rule, decay, **kw)


def adagrad(learning_rate: float = 0.01, epsilon: float = 1e-7, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        a = s[0] + g * g
        return w - g * paced(learning_rate, decay, t) / (m.sqrt(a) + epsilon), [a]

    return Optimiser(1, rule, decay, **kw)


def adadelta(learning_rate: float = 1.0, rho: float = 0.95, epsilon: float = 1e-7, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        a = s[0] * rho + g * g * (1 - rho)
        step = g * m.sqrt(s[1] + epsilon) / m.sqrt(a + epsilon)
        return w - step * paced(learning_rate, decay, t), [a, s[1] * rho + step * step * (1 - rho)]

    return Optimiser(2, rule, decay, **kw)


def adam(learning_rate: float = 0.001, beta_1: float = 0.9, beta_2: float = 0.999, amsgrad: bool = False, epsilon: float = 1e-7, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        first, second = s[0] * beta_1 + g * (1 - beta_1), s[1] * beta_2 + g * g * (1 - beta_2)
        rate = paced(learning_rate, decay, t) * m.sqrt(1 - _power(beta_2, t)) / (1 - _power(beta_1, t))
        top = m.maximum(s[2], second) if amsgrad else second
        return w - first * rate / (m.sqrt(top) + epsilon), [first, second, top]

    return Optimiser(3, rule, decay, **kw)


def adamax(learning_rate: float = 0.002, beta_1: float = 0.9, beta_2: float = 0.999, epsilon: float = 1e-7, decay: float = 0.0, **kw) -> Optimiser:
    def rule(w, g, s, t, m):
        first, top = s[0] * beta_1 + g * (1 - beta_1), m.maximum(s[1] * beta_2, m.abs(g))
        return w - first * (paced(learning_rate, decay, t) / (1 - _power(beta_1, t))) / (top + epsilon), [first, top]

    return Optimiser(2, rule, decay, **kw)


def nadam(learning_rate: float = 0.001, beta_1: float = 0.9, beta_2: float = 0.999, epsilon: float = 1e-7, **kw) -> Optimiser:
    """The schedule's product is taken over two steps only, as the rule was specified: momenta of t and t + 1."""

    def rule(w, g, s, t, m):
        now, ahead = beta_1 * (1 - 0.5 * _power(0.96, t * 0.004)), beta_1 * (1 - 0.5 * _power(0.96, (t + 1) * 0.004))
        first, second = s[0] * beta_1 + g * (1 - beta_1), s[1] * beta_2 + g * g * (1 - beta_2)
        mixed = g / (1 - now) * (1 - now) + first / (1 - now * ahead) * ahead
        return w - mixed * learning_rate / (m.sqrt(second / (1 - _power(beta_2, t))) + epsilon), [first, second]

    return Optimiser(2, rule, **kw)


def _power(base: float, t):
    return F.pow(F.lit(base), t) if isinstance(t, Column) else base**t


OPTIMISERS = {"gradient_descent": gradient_descent, "sgd": sgd, "rmsprop": rmsprop, "adagrad": adagrad, "adadelta": adadelta, "adam": adam, "adamax": adamax, "nadam": nadam}


def descended(w: Column, gradient: Callable[[Column], Column], optimiser: Optimiser, steps: int) -> Column:
    """N25 to N32 as a fold: a weight column after so many steps down a gradient."""
    names = [f"s{i}" for i in range(optimiser.slots)]
    start = F.struct(w.cast("double").alias("w"), *(F.lit(0.0).alias(n) for n in names))

    def step(acc: Column, t: Column) -> Column:
        new, state = optimiser.rule(acc["w"], gradient(acc["w"]), [acc[n] for n in names], t.cast("double"), COLUMNS)
        return F.struct(new.alias("w"), *(s.alias(n) for s, n in zip(state, names, strict=True)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["w"])


# -- initialisers


def fans(shape: tuple[int, ...]) -> tuple[float, float]:
    """Fan in and out: a dense kernel is (out, in), a convolution's (height, width, in, out)."""
    if len(shape) == 2:
        return shape[1], shape[0]
    field_ = int(np.prod(shape[:-2]))
    return shape[-2] * field_, shape[-1] * field_


def initialise(name: str, shape: tuple[int, ...], seed: int | None = None, **p: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    truncated = lambda size, sd: _truncated(rng, size) * sd

    def scaled(scale: float, mode: str, distribution: str) -> np.ndarray:
        into, out = fans(shape)
        spread = scale / max(1.0, {"fan_in": into, "fan_out": out, "fan_avg": (into + out) / 2}[mode])
        if distribution == "uniform":
            return rng.uniform(-np.sqrt(3 * spread), np.sqrt(3 * spread), shape)
        return truncated(shape, np.sqrt(spread) / 0.87962566103423978)

    match name:
        case "zeros":
            return np.zeros(shape)
        case "ones":
            return np.ones(shape)
        case "constant":
            return np.full(shape, p.get("value", 0.0))
        case "identity":
            return p.get("gain", 1.0) * np.eye(*shape)
        case "random_normal":
            return rng.normal(p.get("mean", 0.0), p.get("stddev", 0.05), shape)
        case "random_uniform":
            return rng.uniform(p.get("minval", -0.05), p.get("maxval", 0.05), shape)
        case "truncated_normal":
            return p.get("mean", 0.0) + truncated(shape, p.get("stddev", 0.05))
        case "variance_scaling":
            return scaled(p.get("scale", 1.0), p.get("mode", "fan_in"), p.get("distribution", "normal"))
        case "glorot_normal" | "glorot_uniform":
            return scaled(1.0, "fan_avg", name.split("_")[1])
        case "he_normal" | "he_uniform":
            return scaled(2.0, "fan_in", name.split("_")[1])
        case "lecun_normal" | "lecun_uniform":
            return scaled(1.0, "fan_in", name.split("_")[1])
        case "orthogonal":
            flat = (int(np.prod(shape[:-1])), shape[-1])
            u, _, v = np.linalg.svd(rng.normal(size=flat), full_matrices=False)
            return p.get("gain", 1.0) * (u if u.shape == flat else v).reshape(shape)
    raise KeyError(f"{name!r} is no initialiser")


def _truncated(rng: np.random.Generator, size) -> np.ndarray:
    """Standard normals within two deviations."""
    out = rng.normal(size=size)
    while (far := np.abs(out) > 2).any():
        out[far] = rng.normal(size=int(far.sum()))
    return out


# -- forward passes as columns


def dense(x: Column, weights: np.ndarray, bias: np.ndarray, activation: str = "linear") -> Column:
    """activation(W x + b), W of shape (out, in)."""
    rows = F.array(*(V.dot(x, V.array_of(w)) + F.lit(float(b)) for w, b in zip(weights, bias, strict=True)))
    return V.let(rows, ACTIVATIONS[activation])


def conv2d(image: Column, shape: tuple[int, int, int], kernel: np.ndarray, bias: np.ndarray, strides: tuple[int, int] = (1, 1), same: bool = False) -> Column:
    """A flat (height, width, channels) image column convolved with a kernel (h, w, in, out), flat again.

    Same padding surrounds the image with zeros, more of them after than before where their number is odd.
    """
    h, w, c = shape
    kh, kw, _, out = kernel.shape
    sh, sw = strides
    oh, ow = (-(-h // sh), -(-w // sw)) if same else ((h - kh) // sh + 1, (w - kw) // sw + 1)
    top, left = (max(0, (oh - 1) * sh + kh - h) // 2, max(0, (ow - 1) * sw + kw - w) // 2) if same else (0, 0)

    def value(p: Column) -> Column:
        f, at = p % out, F.floor(p / out).cast("int")
        i, j = F.floor(at / ow).cast("int") * sh - top, (at % ow) * sw - left
        total = F.element_at(V.array_of(bias), f + 1)
        for a in range(kh):
            for b in range(kw):
                for ch in range(c):
                    inside = (i + a >= 0) & (i + a < h) & (j + b >= 0) & (j + b < w)
                    pixel = F.when(inside, F.get(image, ((i + a) * w + j + b) * c + ch)).otherwise(F.lit(0.0))
                    total = total + pixel * F.element_at(V.array_of(kernel[a, b, ch]), f + 1)
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(oh * ow * out - 1)), value)


def max_pool2d(image: Column, shape: tuple[int, int, int], pool: tuple[int, int] = (2, 2)) -> Column:
    """The greatest of each block; rows and columns that fill no block are left out."""
    h, w, c = shape
    ph, pw = pool
    oh, ow = h // ph, w // pw

    def value(p: Column) -> Column:
        ch, at = p % c, F.floor(p / c).cast("int")
        i, j = F.floor(at / ow).cast("int") * ph, (at % ow) * pw
        return F.greatest(*(F.get(image, ((i + a) * w + j + b) * c + ch) for a in range(ph) for b in range(pw))) if ph * pw > 1 else F.get(image, (i * w + j) * c + ch)

    return F.transform(F.sequence(F.lit(0), F.lit(oh * ow * c - 1)), value)


# -- layers over batches


def _act(name: str, z: np.ndarray) -> np.ndarray:
    match name:
        case "relu":
            return np.maximum(z, 0)
        case "tanh":
            return np.tanh(z)
        case "sigmoid":
            return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        case "softmax":
            e = np.exp(z - z.max(-1, keepdims=True))
            return e / e.sum(-1, keepdims=True)
    return z


def _back(name: str, z: np.ndarray, a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The gradient before an activation from the one after it."""
    match name:
        case "relu":
            return d * (z > 0)
        case "tanh":
            return d * (1 - a * a)
        case "sigmoid":
            return d * a * (1 - a)
        case "softmax":
            return a * (d - (d * a).sum(-1, keepdims=True))
    return d


@dataclass
class Layer:
    weights: dict[str, np.ndarray] = field(default_factory=dict, kw_only=True)
    grads: dict[str, np.ndarray] = field(default_factory=dict, kw_only=True)

    def build(self, shape: tuple[int, ...], seed: int) -> tuple[int, ...]:
        return shape

    def forward(self, x: np.ndarray, training: bool) -> np.ndarray:
        return x

    def backward(self, d: np.ndarray) -> np.ndarray:
        return d

    def penalties(self) -> dict[str, Callable]:
        return {}


@dataclass
class Dense(Layer):
    """N07, N08"""

    units: int
    activation: str = "linear"
    kernel_initializer: str = "random_normal"
    regularizer: str = "none"

    def build(self, shape, seed):
        self.weights = {"w": initialise(self.kernel_initializer, (self.units, shape[0]), seed), "b": np.zeros(self.units)}
        return (self.units,)

    def forward(self, x, training):
        self.x = x
        self.z = x @ self.weights["w"].T + self.weights["b"]
        self.a = _act(self.activation, self.z)
        return self.a

    def backward(self, d):
        d = _back(self.activation, self.z, self.a, d)
        self.grads = {"w": d.T @ self.x / len(d), "b": d.mean(0)}
        return d @ self.weights["w"]

    def penalties(self):
        return {"w": regulariser(self.regularizer)[1]}


@dataclass
class Flatten(Layer):
    """Row-major."""

    def build(self, shape, seed):
        return (int(np.prod(shape)),)

    def forward(self, x, training):
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, d):
        return d.reshape(self.shape)


@dataclass
class Dropout(Layer):
    """A share keep_prob passes in training, unscaled; all pass otherwise."""

    keep_prob: float
    seed: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)

    def forward(self, x, training):
        self.mask = self.rng.random(x.shape) <= self.keep_prob if training else np.ones(x.shape)
        return x * self.mask

    def backward(self, d):
        return d * self.mask


@dataclass
class Conv2D(Layer):
    """Windows of the batch as rows of one matrix product."""

    filters: int
    kernel_size: tuple[int, int] = (3, 3)
    strides: tuple[int, int] = (1, 1)
    padding: str = "valid"
    activation: str = "relu"
    kernel_initializer: str = "random_normal"
    regularizer: str = "none"

    def build(self, shape, seed):
        h, w, c = shape
        (kh, kw), (sh, sw) = self.kernel_size, self.strides
        self.weights = {"w": initialise(self.kernel_initializer, (kh, kw, c, self.filters), seed), "b": np.zeros(self.filters)}
        if self.padding == "same":
            oh, ow = -(-h // sh), -(-w // sw)
            ph, pw = max(0, (oh - 1) * sh + kh - h), max(0, (ow - 1) * sw + kw - w)
        else:
            oh, ow, ph, pw = (h - kh) // sh + 1, (w - kw) // sw + 1, 0, 0
        self.out, self.pad = (oh, ow), ((0, 0), (ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2), (0, 0))
        return (oh, ow, self.filters)

    def forward(self, x, training):
        (kh, kw), (sh, sw), (oh, ow) = self.kernel_size, self.strides, self.out
        self.padded = np.pad(x, self.pad)
        view = np.lib.stride_tricks.sliding_window_view(self.padded, (kh, kw), axis=(1, 2))[:, ::sh, ::sw][:, :oh, :ow]
        self.windows = view.transpose(0, 1, 2, 4, 5, 3)
        self.z = np.tensordot(self.windows, self.weights["w"], 3) + self.weights["b"]
        self.a = _act(self.activation, self.z)
        return self.a

    def backward(self, d):
        (kh, kw), (sh, sw), (oh, ow) = self.kernel_size, self.strides, self.out
        d = _back(self.activation, self.z, self.a, d)
        self.grads = {"w": np.tensordot(self.windows, d, ((0, 1, 2), (0, 1, 2))) / len(d), "b": d.sum((1, 2)).mean(0)}
        back = np.zeros_like(self.padded)
        spread = np.tensordot(d, self.weights["w"], ((3,), (3,)))
        for a in range(kh):
            for b in range(kw):
                back[:, a : a + oh * sh : sh, b : b + ow * sw : sw] += spread[:, :, :, a, b]
        (_, _), (t, u), (left, r), _ = self.pad
        return back[:, t : back.shape[1] - u, left : back.shape[2] - r]

    def penalties(self):
        return {"w": regulariser(self.regularizer)[1]}


@dataclass
class MaxPooling2D(Layer):
    """Gradients go to all places of a block that hold its maximum."""

    pool_size: tuple[int, int] = (2, 2)

    def build(self, shape, seed):
        return shape[0] // self.pool_size[0], shape[1] // self.pool_size[1], shape[2]

    def forward(self, x, training):
        ph, pw = self.pool_size
        n, h, w, c = x.shape
        self.shape = x.shape
        self.blocks = x[:, : h // ph * ph, : w // pw * pw].reshape(n, h // ph, ph, w // pw, pw, c)
        self.top = self.blocks.max((2, 4))
        return self.top

    def backward(self, d):
        spread = (self.blocks == self.top[:, :, None, :, None]) * d[:, :, None, :, None]
        n, h, w, c = self.shape
        out = np.zeros(self.shape)
        out[:, : h // self.pool_size[0] * self.pool_size[0], : w // self.pool_size[1] * self.pool_size[1]] = spread.reshape(n, spread.shape[1] * spread.shape[2], -1, c)
        return out


def _arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of (id, features, target, ...) rows; a scalar target is a vector of numbers."""
    table = rows.toArrow()
    x, y = (stacked(c) if pa.types.is_list(c.type) else c.to_numpy() for c in (table.column(1), table.column(2)))
    return x.astype(float), y.astype(float)


@dataclass
class Sequential:
    """Layers one after the other. Input shapes are without the batch."""

    layers: list[Layer] = field(default_factory=list)
    seed: int = 0
    history: list[float] = field(default_factory=list)

    def compile(self, input_shape: tuple[int, ...], optimiser: Optimiser | str = "sgd", loss: str = "mean_squared_error") -> Sequential:
        if loss not in LOSSES:
            raise KeyError(f"{loss!r} is no loss; there are {', '.join(LOSSES)}")
        self.optimiser = OPTIMISERS[optimiser]() if isinstance(optimiser, str) else optimiser
        self.loss, self.shape = loss, input_shape
        shape = input_shape
        for i, layer in enumerate(self.layers):
            shape = layer.build(shape, self.seed * 1_000 + i)
        last = self.layers[-1]
        # softmax and cross-entropy together have the gradient predicted - truth
        self.fused = getattr(last, "activation", "") == "softmax" and "crossentropy" in loss
        self.state = {(i, k): [np.zeros_like(w) for _ in range(self.optimiser.slots)] for i, x in enumerate(self.layers) for k, w in x.weights.items()}
        self.step = 0
        return self

    def predict_array(self, x: np.ndarray, training: bool = False) -> np.ndarray:
        x = x.reshape(len(x), *self.shape)
        for layer in self.layers:
            x = layer.forward(x, training)
        return x

    def gradients(self, x: np.ndarray, y: np.ndarray, training: bool = True) -> float:
        p = self.predict_array(x, training)
        if self.loss == "mean_squared_error":
            value, d = float(((p - y) ** 2).sum(1).mean()), p - y
        else:
            value = float(-(y * np.log(p + 1e-7)).sum(1).mean())
            d = p - y if self.fused or self.loss.startswith("softmax") else -y / (p + 1e-7)
        start = len(self.layers) - 1
        if self.fused:
            last = self.layers[-1]
            name, last.activation = last.activation, "linear"
            d = last.backward(d)
            last.activation = name
            start -= 1
        for layer in reversed(self.layers[: start + 1]):
            d = layer.backward(d)
        return value

    def update(self) -> None:
        self.step += 1
        places = [(i, k) for i, x in enumerate(self.layers) for k in x.weights]
        grads = [self.layers[i].grads[k] + (self.layers[i].penalties()[k](self.layers[i].weights[k]) if k in self.layers[i].penalties() else 0) for i, k in places]
        for (i, k), g in zip(places, self.optimiser.clipped(grads), strict=True):
            layer = self.layers[i]
            layer.weights[k], self.state[i, k] = self.optimiser.rule(layer.weights[k], g, self.state[i, k], float(self.step), NUMPY)

    def sweep(self, x: np.ndarray, y: np.ndarray, batch_size: int) -> float:
        """One update for each batch of rows in order; the sum of the rows' losses."""
        total = 0.0
        for at in range(0, len(x), batch_size):
            some = slice(at, at + batch_size)
            total += self.gradients(x[some], y[some]) * len(x[some])
            self.update()
        return total

    def fit_arrays(self, x: np.ndarray, y: np.ndarray, batch_size: int = 32, epochs: int = 1, shuffle: bool = True) -> Sequential:
        """Seeded shuffles, mean gradients of mini-batches."""
        rng = np.random.default_rng(self.seed)
        for _ in range(epochs):
            order = rng.permutation(len(x)) if shuffle else np.arange(len(x))
            self.history.append(self.sweep(x[order], y[order], batch_size) / max(1, len(x)))
        return self

    def fit(self, df: DataFrame, id_col: str, features: str, target: str, batch_size: int = 32, epochs: int = 1, max_rows: int | None = None, held_rows: int = 50_000) -> Sequential:
        """Mini-batches over a table, in the order of its ids; more than max_rows rows are an error.

        The driver holds held_rows rows at most: of a larger table each epoch deals all rows to chunks of half as many by a
        hash of id and epoch, and takes the chunks one after the other, each shuffled. Batches go on over a chunk's end.
        """
        rows = df.select(id_col, features, target)
        n = rows.count()
        if max_rows is not None and n > max_rows:
            raise ValueError(f"at most {max_rows} rows; fit_sums takes any number")
        if n <= held_rows:
            return self.fit_arrays(*_arrays(rows.orderBy(id_col)), batch_size, epochs)
        rng, chunks = np.random.default_rng(self.seed), -(-n // max(1, held_rows // 2))
        for epoch in range(epochs):
            chunk = F.pmod(F.xxhash64(F.col(id_col), F.lit(self.seed * 1_000 + epoch)), F.lit(chunks))
            dealt = stored(rows.withColumn("_chunk", chunk).repartition("_chunk").sortWithinPartitions("_chunk"), "epoch")
            total, rest = 0.0, []
            for c in range(chunks):
                x, y = _arrays(dealt.where(F.col("_chunk") == c).orderBy(id_col))
                order = rng.permutation(len(x))
                parts = [*rest, *([(x[order], y[order])] if len(x) else [])]
                if not parts:
                    continue
                x, y = (np.concatenate(some) for some in zip(*parts, strict=True))
                whole = len(x) if c == chunks - 1 else len(x) // batch_size * batch_size
                total += self.sweep(x[:whole], y[:whole], batch_size)
                rest = [(x[whole:], y[whole:])]
            self.history.append(total / n)
        return self

    def fit_sums(self, df: DataFrame, features: str, target: str, steps: int = 10) -> Sequential:
        """Full-batch steps over a table of any size: tasks send one sum of gradients each."""
        rows = df.select(features, target).persist()
        for _ in range(steps):
            model = self

            def partial(batches: Iterator[pa.RecordBatch], model: Sequential = model) -> Iterator[pa.RecordBatch]:
                total = None
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    n = batch.num_rows
                    value = model.gradients(stacked(batch.column(0)), stacked(batch.column(1)), False)
                    flat = np.concatenate([[n, value * n], *(layer.grads[k].ravel() * n for layer in model.layers for k in layer.weights)])
                    total = flat if total is None else total + flat
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["cells"])

            cells = rows.mapInArrow(partial, "cells array<double>").select(F.posexplode("cells").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            flat = np.array([r["v"] for r in cells])
            n, at = flat[0], 2
            self.history.append(float(flat[1] / n))
            for layer in self.layers:
                for k, w in layer.weights.items():
                    layer.grads[k] = (flat[at : at + w.size] / n).reshape(w.shape)
                    at += w.size
            self.update()
        rows.unpersist()
        return self

    def predict(self, df: DataFrame, id_col: str, features: str) -> DataFrame:
        """(id, predicted) in Arrow batches."""
        kind, model = df.schema[id_col].dataType.simpleString(), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = model.predict_array(stacked(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.reshape(len(p), -1).tolist(), pa.list_(pa.float64()))], [id_col, "predicted"])

        return df.select(id_col, features).mapInArrow(run, f"`{id_col}` {kind}, predicted array<double>")

    def weights(self) -> list[dict[str, np.ndarray]]:
        return [{k: w.copy() for k, w in layer.weights.items()} for layer in self.layers]

    def set_weights(self, weights: list[dict[str, np.ndarray]]) -> None:
        for layer, own in zip(self.layers, weights, strict=True):
            for k, w in own.items():
                if layer.weights[k].shape != w.shape:
                    raise ValueError("weights of another shape")
                layer.weights[k] = w.copy()

    def dump(self) -> bytes:
        return pickle.dumps(self.weights())

    def load(self, raw: bytes) -> None:
        self.set_weights(pickle.loads(raw))

    def summary(self) -> list[tuple[str, int]]:
        """Each layer's kind and number of parameters."""
        return [(type(x).__name__, sum(w.size for w in x.weights.values())) for x in self.layers]
