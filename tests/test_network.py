import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import network as N
from quillon.operators import sampling


def gradient_check(model, x, y):
    model.gradients(x, y, False)
    for layer in model.layers:
        for k, w in layer.weights.items():
            grad = layer.grads[k].copy()
            for at in [tuple(np.random.default_rng(1).integers(0, s) for s in w.shape) for _ in range(4)]:
                keep = w[at]
                w[at] = keep + 1e-5
                up = model.gradients(x, y, False)
                w[at] = keep - 1e-5
                down = model.gradients(x, y, False)
                w[at] = keep
                model.gradients(x, y, False)
                factor = 2 if model.loss == "mean_squared_error" else 1  # the loss is the square, its gradient the difference
                assert abs((up - down) / 2e-5 - factor * grad[at]) < 1e-4, (type(layer).__name__, k)


@pytest.mark.parametrize("strides", [(1, 1), (2, 2)])
@pytest.mark.parametrize("padding", ["valid", "same"])
def test_gradients(strides, padding):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(4, 49)), np.eye(3)[rng.integers(0, 3, 4)]
    layers = [N.Conv2D(3, strides=strides, padding=padding, activation="tanh", kernel_initializer="he_normal"), N.MaxPooling2D((2, 2)), N.Flatten(), N.Dense(5, "sigmoid", "glorot_uniform"), N.Dense(3, "softmax", "he_uniform")]
    gradient_check(N.Sequential(layers).compile((7, 7, 1), "sgd", "categorical_crossentropy"), x, y)
    gradient_check(N.Sequential([N.Dense(4, "relu", "he_normal"), N.Dense(3, "linear", "lecun_normal")]).compile((49,)), x, y)


@pytest.mark.parametrize("name", sorted(N.OPTIMISERS))
def test_optimisers_learn_and_agree_with_columns(spark, name):
    pdf = sampling.blobs(600, 2, 10, 0.7, seed=123)
    x, y = np.stack(pdf.features), np.eye(2)[pdf.label]
    rate = {"adadelta": {}, "gradient_descent": {"learning_rate": 0.1}, "sgd": {"learning_rate": 0.1, "momentum": 0.5}}.get(name, {"learning_rate": 0.01})
    model = N.Sequential([N.Dense(16, "relu", "he_normal"), N.Dense(2, "softmax", "glorot_normal")], 1).compile((10,), N.OPTIMISERS[name](**rate), "softmax_categorical_crossentropy")
    model.fit_arrays(x, y, 16, 3)
    assert (model.predict_array(x).argmax(1) == pdf.label).mean() >= 0.75 and model.history[-1] < model.history[0]
    rule = N.OPTIMISERS[name](**rate)
    df = spark.createDataFrame([(2.0,)], "w double")
    got = df.select(N.descended(F.col("w"), lambda w: w * w * F.lit(0.3) + w, rule, 7)).first()[0]
    w, state = np.array(2.0), [np.array(0.0)] * rule.slots
    for t in range(1, 8):
        w, state = rule.rule(w, w * w * 0.3 + w, state, float(t), N.NUMPY)
    assert np.isclose(got, w)


def test_clipping_decay_and_regularisers():
    g = N.sgd(clipnorm=1.0).clipped([np.array([3.0, 4.0])])[0]
    assert np.isclose(np.linalg.norm(g), 1) and N.sgd(clipvalue=0.5).clipped([np.array([3.0, -4.0])])[0].tolist() == [0.5, -0.5]
    assert N.paced(0.1, 0.5, 3) == 0.05
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 8)), rng.normal(size=(200, 1))
    norms = {}
    for kind in ("none", "l1", "l2", "l1l2"):
        model = N.Sequential([N.Dense(1, regularizer=kind, kernel_initializer="he_normal")], 3).compile((8,), N.sgd(0.05)).fit_arrays(x, y, 20, 30)
        norms[kind] = float(np.abs(model.layers[0].weights["w"]).sum())
    assert all(norms[k] <= norms["none"] for k in norms)
    with pytest.raises(KeyError):
        N.regulariser("l3")


def test_columns_agree_with_layers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 6 * 5 * 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    for padding in ("valid", "same"):
        for strides in ((1, 1), (2, 2)):
            layer = N.Conv2D(3, (3, 2), strides, padding, "linear", "he_normal")
            layer.build((6, 5, 2), 0)
            layer.weights["b"] = rng.normal(size=3)
            want = layer.forward(x.reshape(3, 6, 5, 2), False).reshape(3, -1)
            got = df.select("id", N.conv2d(F.col("x"), (6, 5, 2), layer.weights["w"], layer.weights["b"], strides, padding == "same").alias("y")).orderBy("id").collect()
            assert np.allclose([r.y for r in got], want)
    pool = N.MaxPooling2D((2, 2))
    want = pool.forward(x.reshape(3, 6, 5, 2), False).reshape(3, -1)
    assert np.allclose([r.y for r in df.select("id", N.max_pool2d(F.col("x"), (6, 5, 2)).alias("y")).orderBy("id").collect()], want)
    for name in N.ACTIVATIONS:
        got = df.select("id", N.ACTIVATIONS[name](F.col("x")).alias("y")).orderBy("id").collect()
        assert np.allclose([r.y for r in got], N._act(name, x))


def test_training_over_tables(spark):
    pdf = sampling.blobs(200, 2, 4, 0.5, seed=5)
    df = spark.createDataFrame([(int(r.id), [float(v) for v in r.features], np.eye(2)[r.label].tolist()) for r in pdf.itertuples()], "id int, x array<double>, y array<double>")
    build = lambda: N.Sequential([N.Dense(2, "softmax", "glorot_normal")], 1).compile((4,), N.adam(0.05), "categorical_crossentropy")
    a = build().fit_sums(df, "x", "y", 6)
    b = build().fit_arrays(np.stack(pdf.features), np.eye(2)[pdf.label], 200, 6, shuffle=False)
    assert np.allclose(a.history, b.history) and np.allclose(a.layers[0].weights["w"], b.layers[0].weights["w"])
    told = a.predict(df, "id", "x").orderBy("id").collect()
    assert np.allclose([r.predicted for r in told], a.predict_array(np.stack(pdf.features)))
    c = build()
    c.load(a.dump())
    assert np.allclose(c.predict_array(np.ones((1, 4))), a.predict_array(np.ones((1, 4)))) and c.summary() == [("Dense", 10)]
    with pytest.raises(ValueError):
        build().fit(df, "id", "x", "y", max_rows=10)


def test_dropout_and_initialisers():
    layer = N.Dropout(0.3)
    layer.build((1000,), 0)
    x = np.ones((20, 1000))
    assert abs(layer.forward(x, True).mean() - 0.3) < 0.02 and (layer.forward(x, False) == x).all()
    for name in ("zeros", "ones", "constant", "random_normal", "random_uniform", "truncated_normal", "variance_scaling", "glorot_normal", "glorot_uniform", "he_normal", "he_uniform", "lecun_normal", "lecun_uniform", "orthogonal"):
        assert N.initialise(name, (3, 3, 5, 8), 1).shape == (3, 3, 5, 8)
    q = N.initialise("orthogonal", (10, 10), 1)
    assert np.allclose(q @ q.T, np.eye(10)) and (N.initialise("identity", (10, 10)) == np.eye(10)).all()
    assert np.abs(N.initialise("truncated_normal", (1000,), 1, stddev=1.0)).max() <= 2
    assert np.isclose(N.initialise("he_normal", (400, 300), 1).std(), np.sqrt(2 / 300), rtol=0.02)
    with pytest.raises(KeyError):
        N.initialise("luck", (2, 2))


def test_mini_batches_over_more_rows_than_are_held(spark):
    pdf = sampling.blobs(230, 2, 4, 0.5, seed=5)
    df = spark.createDataFrame([(int(r.id), [float(v) for v in r.features], np.eye(2)[r.label].tolist()) for r in pdf.itertuples()], "id int, x array<double>, y array<double>")
    model = N.Sequential([N.Dense(2, "softmax", "glorot_normal")], 1).compile((4,), N.adam(0.05), "categorical_crossentropy")
    seen, update = [], model.gradients
    model.gradients = lambda x, y: seen.append(x) or update(x, y)
    model.fit(df, "id", "x", "y", 16, 3, held_rows=50)
    assert [len(x) for x in seen] == ([16] * 14 + [6]) * 3  # no batch ends with a chunk
    whole = np.sort(np.stack(pdf.features), axis=0)
    epochs = [np.concatenate(seen[i : i + 15]) for i in (0, 15, 30)]
    assert all(np.allclose(np.sort(x, axis=0), whole) for x in epochs) and not np.allclose(epochs[0], epochs[1])
    assert len(model.history) == 3 and model.history[-1] < model.history[0]
