"""Networks: activations, losses, optimisers, layers over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.functions import vectors as V
from quillon.operators import network as N
from quillon.queries._registry import E, embeddings, query, r6

ACT = f"WITH {E}, x AS (SELECT vec_id, i - 1 AS dim, v, v[i] AS x FROM e, (SELECT unnest(range(1, 65))::INTEGER AS i))"
ACT_SQL = {"linear": "x", "softmax": "exp(x) / list_sum(list_transform(v, lambda t: exp(t)))", "tanh": "tanh(x)", "relu": "greatest(x, 0)", "sigmoid": "1 / (1 + exp(-x))"}
DIFF_SQL = {"linear": "1", "tanh": "1 - tanh(x) * tanh(x)", "relu": "CASE WHEN x > 0 THEN 1 ELSE 0 END", "sigmoid": "exp(-x) / ((1 + exp(-x)) * (1 + exp(-x)))"}


def _activation(name):
    @query(f"act_{name}", f"{ACT} SELECT vec_id, dim, round(({ACT_SQL[name]})::DOUBLE, 6) + 0 AS y FROM x")
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(N.ACTIVATIONS[name](F.col("v"))).alias("dim", "y"))
        return rows.select("vec_id", "dim", r6(F.col("y")).alias("y"))


def _derivative(name):
    @query(f"act_diff_{name}", f"{ACT} SELECT vec_id, dim, round(({DIFF_SQL[name]})::DOUBLE, 6) + 0 AS y FROM x")
    def run(spark, sf_dir):
        rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(N.DERIVATIVES[name](F.col("v"))).alias("dim", "y"))
        return rows.select("vec_id", "dim", r6(F.col("y")).alias("y"))


for _name in N.ACTIVATIONS:
    _activation(_name)
for _name in N.DERIVATIVES:
    _derivative(_name)

#: Truth: the label as one-hot; predicted: softmax of the first ten components.
PRED = f"WITH {E}, s AS (SELECT vec_id, label, list_transform(v[1:10], lambda t: exp(t) / list_sum(list_transform(v[1:10], lambda u: exp(u)))) AS p FROM e), l AS (SELECT vec_id, label, p, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END) AS t FROM s)"


def predictions(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    truth = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    return rows.select("vec_id", truth.alias("t"), N.ACTIVATIONS["softmax"](F.slice("v", 1, 10)).alias("p"))


@query(
    "losses",
    PRED + " SELECT round(avg(list_sum(list_transform(list_zip(t, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) + 0 AS mse, round(avg(-ln(p[label + 1] + 1e-7)), 6) + 0 AS crossentropy, round(avg((list_position(p, list_max(p)) - 1 = label)::INTEGER), 6) + 0 AS accuracy FROM l",
)
def losses(spark, sf_dir):
    t, p = F.col("t"), F.col("p")
    mean = lambda c, n: r6(F.avg(c)).alias(n)
    return predictions(spark, sf_dir).agg(mean(N.LOSSES["mean_squared_error"](t, p), "mse"), mean(N.LOSSES["categorical_crossentropy"](t, p), "crossentropy"), mean(N.categorical_accuracy(t, p), "accuracy"))


@query("loss_gradients", PRED + " SELECT vec_id, i - 1 AS dim, round(p[i] - t[i], 6) + 0 AS softmax_crossentropy, round(-t[i] / (p[i] + 1e-7), 4) + 0 AS crossentropy FROM l, (SELECT unnest(range(1, 11))::INTEGER AS i)")
def loss_gradients(spark, sf_dir):
    t, p = F.col("t"), F.col("p")
    both = F.zip_with(N.GRADIENTS["softmax_categorical_crossentropy"](t, p), N.GRADIENTS["categorical_crossentropy"](t, p), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = predictions(spark, sf_dir).select("vec_id", F.posexplode(both).alias("dim", "g"))
    return rows.select("vec_id", "dim", r6(F.col("g.a")).alias("softmax_crossentropy"), (F.round("g.b", 4) + F.lit(0.0)).alias("crossentropy"))


@query("regularisers", f"{ACT} SELECT vec_id, round(0.01::DOUBLE * sum(abs(x)), 6) + 0 AS l1, round(0.01::DOUBLE * sum(x * x), 6) + 0 AS l2, round(0.01::DOUBLE * sum(abs(x) + x * x), 6) + 0 AS l1l2, round(sum(0.01::DOUBLE * sign(x) + 0.02::DOUBLE * x), 6) + 0 AS gradient, 0::DOUBLE AS \"none\" FROM x GROUP BY vec_id")
def regularisers(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    sum_of = lambda f: r6(V.total(F.transform("v", f)))
    kinds = {k: N.regulariser(k) for k in ("l1", "l2", "l1l2", "none")}
    return rows.select("vec_id", *(sum_of(loss).alias(k) for k, (loss, _) in kinds.items()), sum_of(kinds["l1l2"][1]).alias("gradient"))


#: Each optimiser's state and step in SQL, for the gradient g of (w - target)^2 / 2, at step t.
STEPS = {
    "gradient_descent": ("0.0", [], "w - 0.1::DOUBLE * g", []),
    "sgd": ("0", ["0"], "w + 0.9::DOUBLE * s0 - 0.1::DOUBLE * g", ["0.9::DOUBLE * s0 - 0.1::DOUBLE * g"]),
    "rmsprop": ("0", ["0"], "w - 0.1::DOUBLE * g / (sqrt(0.9::DOUBLE * s0 + 0.1::DOUBLE * g * g) + 1e-7)", ["0.9::DOUBLE * s0 + 0.1::DOUBLE * g * g"]),
    "adagrad": ("0", ["0"], "w - 0.1::DOUBLE * g / (sqrt(s0 + g * g) + 1e-7)", ["s0 + g * g"]),
    "adadelta": (
        "0",
        ["0", "0"],
        "w - g * sqrt(s1 + 1e-7) / sqrt(0.95::DOUBLE * s0 + 0.05::DOUBLE * g * g + 1e-7)",
        ["0.95::DOUBLE * s0 + 0.05::DOUBLE * g * g", "0.95::DOUBLE * s1 + 0.05::DOUBLE * pow(g * sqrt(s1 + 1e-7) / sqrt(0.95::DOUBLE * s0 + 0.05::DOUBLE * g * g + 1e-7), 2)"],
    ),
    "adam": (
        "0",
        ["0", "0"],
        "w - (0.9::DOUBLE * s0 + 0.1::DOUBLE * g) * 0.1::DOUBLE * sqrt(1 - pow(0.999::DOUBLE, t)) / (1 - pow(0.9::DOUBLE, t)) / (sqrt(0.999::DOUBLE * s1 + 0.001::DOUBLE * g * g) + 1e-7)",
        ["0.9::DOUBLE * s0 + 0.1::DOUBLE * g", "0.999::DOUBLE * s1 + 0.001::DOUBLE * g * g"],
    ),
    "adamax": (
        "0",
        ["0", "0"],
        "w - (0.9::DOUBLE * s0 + 0.1::DOUBLE * g) * (0.1::DOUBLE / (1 - pow(0.9::DOUBLE, t))) / (greatest(0.999::DOUBLE * s1, abs(g)) + 1e-7)",
        ["0.9::DOUBLE * s0 + 0.1::DOUBLE * g", "greatest(0.999::DOUBLE * s1, abs(g))"],
    ),
    "nadam": (
        "0",
        ["0", "0"],
        """w - (g + (0.9::DOUBLE * s0 + 0.1::DOUBLE * g) / (1 - (0.9::DOUBLE * (1 - 0.5::DOUBLE * pow(0.96::DOUBLE, t * 0.004::DOUBLE))) * (0.9::DOUBLE * (1 - 0.5::DOUBLE * pow(0.96::DOUBLE, (t + 1) * 0.004::DOUBLE)))) * (0.9::DOUBLE * (1 - 0.5::DOUBLE * pow(0.96::DOUBLE, (t + 1) * 0.004::DOUBLE))))
        * 0.1::DOUBLE / (sqrt((0.999::DOUBLE * s1 + 0.001::DOUBLE * g * g) / (1 - pow(0.999::DOUBLE, t))) + 1e-7)""",
        ["0.9::DOUBLE * s0 + 0.1::DOUBLE * g", "0.999::DOUBLE * s1 + 0.001::DOUBLE * g * g"],
    ),
}
RATES = {"adadelta": {}, "sgd": {"learning_rate": 0.1, "momentum": 0.9}}


def _optimiser(name):
    _, start, new, state = STEPS[name]
    names = "".join(f", s{i}" for i in range(len(start)))
    sql = f"""WITH RECURSIVE o(p_partkey, t, w, target{names}) AS (SELECT p_partkey, 0::DOUBLE, 0::DOUBLE, p_size / 10::DOUBLE{''.join(f', {s}::DOUBLE' for s in start)} FROM part
        UNION ALL SELECT p_partkey, t, {new}, target{''.join(f', {s}' for s in state)} FROM (SELECT p_partkey, t + 1 AS t, w, target, w - target AS g{names} FROM o WHERE t < 10))
        SELECT p_partkey, round(w, 6) + 0 AS w FROM o WHERE t = 10"""

    @query(f"opt_{name}", sql)
    def run(spark, sf_dir):
        """Ten steps towards a tenth of each part's size."""
        rule = N.OPTIMISERS[name](**RATES.get(name, {"learning_rate": 0.1}))
        target = F.col("p_size") / F.lit(10.0)
        return table(spark, sf_dir, "part").select("p_partkey", r6(N.descended(F.lit(0.0), lambda w: w - target, rule, 10)).alias("w"))


for _name in N.OPTIMISERS:
    _optimiser(_name)


@query("learning_rate_decay", "SELECT p_partkey, round(0.1::DOUBLE / (1 + 0.05::DOUBLE * (p_size - 1)), 8) + 0 AS rate FROM part")
def learning_rate_decay(spark, sf_dir):
    """N24"""
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(F.lit(0.1) / (F.lit(1.0) + F.lit(0.05) * (F.col("p_size") - 1)), 8) + F.lit(0.0)).alias("rate"))


#: Small whole-number weights that both sides can write down: w[o][i] = ((o + 1) * (i + 3)) % 7 - 3.
DENSE_W = np.array([[((o + 1) * (i + 3)) % 7 - 3 for i in range(64)] for o in range(4)], float)
KERNEL = np.array([[[[(a * 3 + b) % 4 - 1, (a + b * 2) % 3 - 1]] for b in range(3)] for a in range(3)], float)


@query(
    "dense_forward",
    f"WITH {E}, o AS (SELECT vec_id, o::INTEGER AS dim, list_sum(list_transform(list_zip(v, range(64)), lambda z: z[1] * (((o + 1) * (z[2] + 3)) % 7 - 3))) + 0.5::DOUBLE AS z FROM e, range(4) t(o)) SELECT vec_id, dim, round(greatest(z, 0), 6) + 0 AS y FROM o",
)
def dense_forward(spark, sf_dir):
    y = N.dense(F.col("v"), DENSE_W, np.full(4, 0.5), "relu")
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(y).alias("dim", "y")).select("vec_id", "dim", r6(F.col("y")).alias("y"))


@query(
    "conv2d_forward",
    f"""WITH {E}, p AS (SELECT vec_id, i, j, v[i * 8 + j + 1] AS x FROM e, range(8) a(i), range(8) b(j)),
    k AS (SELECT a, b, f, CASE WHEN f = 0 THEN (a * 3 + b) % 4 - 1 ELSE (a + b * 2) % 3 - 1 END AS w FROM range(3) x(a), range(3) y(b), range(2) z(f))
    SELECT vec_id, ((i - a) * 6 + j - b) * 2 + f AS place, round(sum(x * w) + 0.25::DOUBLE, 6) + 0 AS y FROM p, k WHERE i - a BETWEEN 0 AND 5 AND j - b BETWEEN 0 AND 5 GROUP BY ALL""",
)
def conv2d_forward(spark, sf_dir):
    """N10 over the embeddings as 8 x 8 images."""
    y = N.conv2d(F.col("v"), (8, 8, 1), KERNEL, np.full(2, 0.25))
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(y).alias("place", "y")).select("vec_id", F.col("place").cast("long").alias("place"), r6(F.col("y")).alias("y"))


@query("maxpool2d", f"WITH {E}, p AS (SELECT vec_id, i, j, v[i * 8 + j + 1] AS x FROM e, range(8) a(i), range(8) b(j)) SELECT vec_id, (i // 2) * 4 + j // 2 AS place, round(max(x), 6) + 0 AS y FROM p GROUP BY ALL")
def maxpool2d(spark, sf_dir):
    y = N.max_pool2d(F.col("v"), (8, 8, 1))
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(y).alias("place", "y")).select("vec_id", F.col("place").cast("long").alias("place"), r6(F.col("y")).alias("y"))


@query("flatten_image", f"WITH {E} SELECT vec_id, i AS place, v[i + 1] AS x FROM e, range(64) t(i)")
def flatten_image(spark, sf_dir):
    """Nested rows made flat, row by row."""
    rows = embeddings(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8)).alias("image"))
    return rows.select("vec_id", F.posexplode(F.flatten("image")).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), "x")


@query("initialisers")
def initialisers(spark, sf_dir):
    """Mean and deviation of every initialiser's numbers."""
    names = ["zeros", "ones", "constant", "random_normal", "random_uniform", "truncated_normal", "variance_scaling", "glorot_normal", "glorot_uniform", "he_normal", "he_uniform", "lecun_normal", "lecun_uniform", "orthogonal"]
    made = {n: N.initialise(n, (3, 3, 5, 8), 1) for n in names} | {"identity": N.initialise("identity", (10, 10))}
    return spark.createDataFrame([(n, float(x.mean()), float(x.std())) for n, x in made.items()], "name string, mean double, deviation double")


def _labelled(spark, sf_dir):
    truth = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    return embeddings(spark, sf_dir).select("vec_id", "v", truth.alias("t"))


@query("network_fit")
def network_fit(spark, sf_dir):
    """A small dense network over the embeddings, and its predictions."""
    rows = _labelled(spark, sf_dir)
    model = N.Sequential([N.Dense(16, "relu", "he_normal"), N.Dropout(0.9), N.Dense(10, "softmax", "glorot_normal")], 1)
    model.compile((64,), "adam", "categorical_crossentropy").fit(rows, "vec_id", "v", "t", 16, 3)
    return model.predict(rows, "vec_id", "v")


@query("network_fit_sums")
def network_fit_sums(spark, sf_dir):
    """The loss of full-batch steps, gradients summed in Spark."""
    model = N.Sequential([N.Dense(10, "softmax", "glorot_normal")], 1).compile((64,), N.adam(0.05), "categorical_crossentropy")
    model.fit_sums(_labelled(spark, sf_dir), "v", "t", 5)
    return spark.createDataFrame(list(enumerate(model.history)), "step int, loss double")


def _steps_sql(steps: int, rate: float) -> str:
    """The losses of full-batch steps: 64 tanh units that start as the identity, then 10 softmax outputs that start as zeros."""
    out = [
        E,
        "x AS MATERIALIZED (SELECT vec_id, j, v[j + 1] AS x FROM e, (SELECT unnest(range(64)) AS j))",
        "n AS (SELECT count(*) AS n FROM e)",
        "wa0 AS (SELECT u, j, (u = j)::INTEGER::DOUBLE AS w FROM range(64) a(u), range(64) b(j))",
        "ba0 AS (SELECT u, 0::DOUBLE AS b FROM range(64) a(u))",
        "wb0 AS (SELECT k, u, 0::DOUBLE AS w FROM range(10) a(k), range(64) b(u))",
        "bb0 AS (SELECT k, 0::DOUBLE AS b FROM range(10) a(k))",
    ]
    for i in range(steps):
        out += [
            f"h{i} AS MATERIALIZED (SELECT vec_id, u, tanh(z + b) AS a FROM (SELECT vec_id, u, sum(x * w) AS z FROM x JOIN wa{i} USING (j) GROUP BY ALL) JOIN ba{i} USING (u))",
            f"o{i} AS MATERIALIZED (SELECT vec_id, k, exp(z + b) / sum(exp(z + b)) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, k, sum(a * w) AS z FROM h{i} JOIN wb{i} USING (u) GROUP BY ALL) JOIN bb{i} USING (k))",
            f"d{i} AS MATERIALIZED (SELECT vec_id, k, p, p - (k = label)::INTEGER AS d, k = label AS own FROM o{i} JOIN e USING (vec_id))",
            f"c{i} AS MATERIALIZED (SELECT vec_id, u, s * (1 - a * a) AS d FROM (SELECT vec_id, u, sum(d * w) AS s FROM d{i} JOIN wb{i} USING (k) GROUP BY ALL) JOIN h{i} USING (vec_id, u))",
        ]
        for name, rows, keys, value in (("wa", f"c{i} JOIN x USING (vec_id)", "u, j", "d * x"), ("ba", f"c{i}", "u", "d"), ("wb", f"d{i} JOIN h{i} USING (vec_id)", "k, u", "d * a"), ("bb", f"d{i}", "k", "d")):
            kept = "w" if name[0] == "w" else "b"
            out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT {keys}, {kept} - {rate}::DOUBLE * g / n AS {kept} FROM {name}{i} JOIN (SELECT {keys}, sum({value}) AS g FROM {rows} GROUP BY ALL) USING ({keys}), n)")
    told = " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, round(avg(-ln(p + 1e-7::DOUBLE)), 6) + 0 AS loss FROM d{i} WHERE own" for i in range(steps))
    return f"WITH {', '.join(out)} {told}"


@query("network_fit_steps", _steps_sql(4, 2.0))
def network_fit_steps(spark, sf_dir):
    """Two dense layers, trained by full batches; the loss before each step."""
    layers = [N.Dense(64, "tanh", "identity"), N.Dense(10, "softmax", "zeros")]
    model = N.Sequential(layers, 1).compile((64,), N.gradient_descent(2.0), "categorical_crossentropy")
    model.fit_sums(_labelled(spark, sf_dir), "v", "t", 4)
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(model.history)], "step int, loss double")


@query("cnn_fit")
def cnn_fit(spark, sf_dir):
    """Convolution and pooling over the embeddings as images."""
    rows = _labelled(spark, sf_dir)
    model = N.Sequential([N.Conv2D(4, padding="same"), N.MaxPooling2D(), N.Flatten(), N.Dense(10, "softmax")], 2)
    model.compile((8, 8, 1), "adagrad", "categorical_crossentropy").fit(rows, "vec_id", "v", "t", 16, 2)
    return model.predict(rows, "vec_id", "v")
