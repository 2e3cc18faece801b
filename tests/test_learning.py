import inspect
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boosting, clustering, decomposition, preprocessing, regression, sampling, svm, tree
from quillon.operators.linalg import covariance, moments
from quillon.queries import QUERIES


def frame(spark, pdf):
    pdf = pdf.copy()
    for c in ("features",):
        if c in pdf:
            pdf[c] = pdf[c].map(lambda v: [float(x) for x in v])
    return spark.createDataFrame(pdf)


def test_moments_and_covariance(spark):
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(500, 7)) + 1e6, rng.normal(size=(500, 2)), rng.random(500)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y array<double>, w double").repartition(5)
    mean, cov, n = covariance(df, F.col("x"))
    assert n == 500 and np.allclose(cov, np.cov(x.T), atol=1e-6) and np.allclose(mean, x.mean(0))
    m = moments(df, F.col("x"), F.col("y"), F.col("w"))
    assert np.allclose(m.xx, (x * w[:, None]).T @ x) and np.allclose(m.xy, (x * w[:, None]).T @ y)
    with pytest.raises(ValueError):
        moments(df.limit(0), F.col("x"), F.col("y"))


def test_rmse_falls_with_the_degree(spark):
    df = spark.createDataFrame(sampling.noisy_sine(30)).select("id", F.array("x").alias("x"), "y")
    last = np.inf
    for kind in (regression.Linear, regression.Lasso):
        last = np.inf
        for k in (1, 2, 4, 8):
            model = kind.on("x", "polynomial", exponent=list(range(1, k + 1))).fit(df, "y")
            rmse = preprocessing.squared_error(df.withColumn("p", model.predict()), "y", "p").first()["rmse"]
            assert rmse <= last + 1e-3
            last = rmse
    assert last < 0.5


def test_ridge_and_bayes_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), rng.normal(size=200)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y double")
    phi = np.hstack([np.ones((200, 1)), x])
    ridge = regression.Linear.on("x", ridge=3.0).fit(df, "y")
    assert np.allclose(ridge.weights[:, 0], np.linalg.solve(phi.T @ phi + 3 * np.eye(4), phi.T @ y))
    bayes = regression.Bayesian.on("x").fit(df, "y")
    s = np.linalg.inv(np.eye(4) + 25 * phi.T @ phi)
    told = df.select("id", bayes.predict().alias("m"), bayes.deviation().alias("d")).orderBy("id").collect()
    assert np.allclose([r.m for r in told], phi @ (25 * s @ phi.T @ y))
    assert np.allclose([r.d for r in told], np.sqrt(1 / 25 + np.einsum("ni,ij,nj->n", phi, s, phi)))
    ev = regression.Evidence.on("x")
    m = ev.sums(df, "y")
    ev.solve(m)
    best = ev.log_evidence(m)
    for a, b in ((1.1, 1), (0.9, 1), (1, 1.1), (1, 0.9)):
        other = regression.Evidence.on("x")
        other.alpha, other.beta = ev.alpha * a, ev.beta * b
        assert other.log_evidence(m) <= best + 1e-3


def test_lasso_meets_its_conditions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    y = x @ np.array([3.0, 0, 0, -2, 0, 0]) + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    model = regression.Lasso.on("x", bias=False)
    model.lamda, model.rho, model.max_iter = 40.0, 30.0, 2_000
    model.fit(df, "y")
    z = model.sparse[:, 0]
    slope = x.T @ (y - x @ z)
    assert (np.abs(slope) <= 40.5).all() and np.allclose(slope[z != 0], 40 * np.sign(z[z != 0]), atol=0.5) and (z == 0).sum() >= 3


def test_kernel_regression_interpolates(spark):
    df = spark.createDataFrame([(i, [i / 5.0], float(np.sin(i / 5))) for i in range(40)], "id int, x array<double>, y double")
    model = regression.KernelRegression(1e-8).fit(df, "x", "y")
    assert max(abs(r.predicted - np.sin(r.id / 5)) for r in model.predict(df, "id", "x").collect()) < 1e-2
    with pytest.raises(ValueError):
        regression.KernelRegression(1.0, max_rows=5).fit(df, "x", "y")


@pytest.mark.parametrize("name", ["linear", "polynomial", "gaussian", "exponential", "laplacian", "sigmoid", "rational_quadratic", "multiquadric", "inverse_multiquadric", "log"])
def test_kernels_agree_with_numpy(spark, name):
    from quillon.functions import vectors as V

    a, b = np.random.RandomState(123).rand(2, 10)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    assert np.isclose(df.select(V.kernel(name)(F.col("a"), F.col("b"))).first()[0], regression.kernel_values(name, a[None], b[None])[0, 0])
    with pytest.raises(KeyError):
        V.kernel("none of these")


def test_boosting(spark):
    rng = np.random.default_rng(3)
    h = rng.normal(size=(400, 3))
    y = h @ np.array([1.0, 2.0, 0.5]) + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(h, y, strict=True)], "h0 double, h1 double, h2 double, y double")
    losses = [float(((y - h @ boosting.l2_boost(df, ["h0", "h1", "h2"], "y", k)) ** 2).sum()) for k in (1, 2, 5, 40)]
    assert losses == sorted(losses, reverse=True) and np.allclose(boosting.l2_boost(df, ["h0", "h1", "h2"], "y", 40), [1, 2, 0.5], atol=0.05)
    t = np.where(rng.random(600) < 0.5, 1, -1)
    votes = np.stack([np.where(rng.random(600) < p, t, -t) for p in (0.7, 0.75, 0.8)], 1)
    vf = spark.createDataFrame([(*map(int, v), int(s)) for v, s in zip(votes, t, strict=True)], "h0 int, h1 int, h2 int, y int")
    for fit in (boosting.ada_boost, boosting.logit_boost):
        alpha = fit(vf, ["h0", "h1", "h2"], "y", 60)
        assert (np.sign(votes @ alpha) == t).mean() >= (votes == t[:, None]).mean(0).max()


def test_svm_on_a_spiral(spark):
    df = frame(spark, sampling.whirlpool(150))
    for c in (10.0, float("inf")):
        model = svm.Svm(parameters={"sigma": 1.0}, c=c, sweeps=60).fit(df, "id", "features", "label")
        told = model.predict(df, "id", "features").join(df, "id").collect()
        assert np.mean([r.predicted == str(r.label) for r in told]) >= 0.9
    three = frame(spark, sampling.blobs(150, 3, seed=4))
    model = svm.Svm(sweeps=20).fit(three, "id", "features", "label")
    assert len(model.problems) == 3
    assert np.mean([r.predicted == str(r.label) for r in model.predict(three, "id", "features").join(three, "id").collect()]) >= 0.85
    with pytest.raises(ValueError):
        svm.signs(np.array([1, 2, 3]))


def brute_split(x, y):
    best = (0, None)
    gini = lambda v: 1 - sum((np.mean(v == c)) ** 2 for c in np.unique(v)) if len(v) else 0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            gain = round(gini(y) - left.mean() * gini(y[left]) - (~left).mean() * gini(y[~left]), 12)
            if gain > best[0]:
                best = (gain, (f, t))
    return best


def test_tree_against_exhaustive_search(spark):
    pdf = sampling.cakes(200, 5, 1, 5, same=False, seed=0)
    x, y = np.stack(pdf.features), pdf.label.to_numpy()
    df = frame(spark, pdf).select("id", "label", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    scores = []
    for depth in (1, 2, 4, 8):
        model = tree.Tree(["a", "b"], "label", max_depth=depth).fit(df)
        scores.append(df.select((model.predict() == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0])
    gain, (f, t) = brute_split(x, y)
    assert model.splits[1][0] == f and abs(model.splits[1][1] - t) < 1e-9 and abs(model.splits[1][2] - gain) < 1e-9
    assert scores == sorted(scores) and scores[-1] >= 0.9
    assert abs(sum(model.importances()) - 1) < 1e-9 and "->" in model.dot()
    entropy = tree.Tree(["a", "b"], "label", "entropy", max_depth=3).fit(df)
    assert entropy.splits
    binned = tree.Tree(["a", "b"], "label", max_depth=8, bins=32).fit(df)
    assert df.select((binned.predict() == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0] > 0.75


def test_clusterings_find_separate_slices(spark):
    pdf = sampling.cakes(600, 6, 3, 10, seed=1)
    pdf = pdf[pdf.label % 2 == 0].reset_index(drop=True)
    df = frame(spark, pdf)
    for algorithm in ("lloyd", "elkan", "hamerly"):
        model = clustering.KMeans(3, algorithm=algorithm, max_iter=30, seed=1).fit(df, "id", "features")
        assert clustering.cluster_accuracy(model.transform(df, "features"), "label", "cluster") > 0.75
    mixture = clustering.GaussianMixture(3, max_iter=40, seed=1).fit(df, "id", "features")
    told = mixture.responsibilities(df, "id", "features").join(df.select("id", "label"), "id")
    assert clustering.cluster_accuracy(told, "label", "cluster") > 0.75
    found = clustering.dbscan(df, "id", "features", 1.2, 4)
    assert clustering.cluster_accuracy(found.join(df.select("id", "label"), "id"), "label", "cluster") > 0.75
    with pytest.raises(KeyError):
        clustering.initial_centres(df, "id", "features", 2, "nowhere")
    assert clustering.initial_centres(df, "id", "features", 4, "random").shape == (4, 2)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_measures_whole_vectors(spark, dims):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.05, (120, 64))
    x[:, 2:] += rng.integers(0, 4, (120, 1))  # groups that the first two components do not tell apart
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    eps, least = 0.55, 4
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    pairs = clustering.epsilon_pairs(df, "id", "v", eps, dims).collect()
    assert sorted((r.a, r.b) for r in pairs) == sorted(zip(*map(list, near.nonzero()), strict=True))
    core, label, clusters = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], clusters
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = clusters
                    todo.append(j)
            clusters += 1
    want = [int(label[i]) if core[i] else min(label[near[i] & core].tolist(), default=-1) for i in range(len(x))]
    found = {r.id: (r.core, r.cluster) for r in clustering.dbscan(df, "id", "v", eps, least, dims).collect()}
    assert found == {i: (bool(core[i]), want[i]) for i in range(len(x))}
    assert clusters > 1 and 0 < core.sum() < len(x)


def test_empty_cluster_takes_a_far_row(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id int, v array<double>")
    model = clustering.KMeans(init=np.array([[4.5], [1e6]]), max_iter=1).fit(df, "id", "v")
    assert np.allclose(sorted(model.centres[:, 0]), [0.0, 4.5]) or np.allclose(sorted(model.centres[:, 0]), [4.5, 9.0])


def test_densities():
    rng = np.random.default_rng(5)
    x, mean = rng.normal(size=(20, 3)), rng.normal(size=3)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T + np.eye(3)
    want = -0.5 * (3 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean))
    assert np.allclose(clustering.log_normal(x, mean, cov), want)
    assert np.allclose(clustering.log_normal(x, mean, np.diag([1.0, 2, 3])), clustering.log_normal(x, mean, np.array([1.0, 2, 3]), "diag"))
    assert np.allclose(clustering.log_normal(x, mean, np.eye(3) * 2), clustering.log_normal(x, mean, 2.0, "spherical"))
    with pytest.raises(ValueError):
        clustering.log_normal(x, mean, -np.eye(3))
    for kind in ("full", "tied", "diag", "spherical"):
        full = clustering.covariance_full(clustering.covariance_as(np.eye(3) * 2, kind, 4), kind, 4, 3)
        assert np.allclose(full, np.eye(3) * 2) and full.shape == (4, 3, 3)


def test_embeddings_keep_classes_apart(spark):
    df = frame(spark, sampling.blobs(90, 3, 5, 0.3, seed=6))
    label = {r.id: r.label for r in df.collect()}
    pca = decomposition.Pca(2).fit(df, "features")
    assert np.allclose(pca.components @ pca.components.T, np.eye(2), atol=1e-9) and (np.diff(pca.variance) <= 0).all()
    embedded = {
        "pca": df.select("id", pca.transform("features").alias("y")),
        "rows": decomposition.transform_rows(df, "id", "features", pca.components, pca.mean),
        "kpca": decomposition.KernelPca(2, parameters={"sigma": 3.0}).fit_transform(df, "id", "features"),
        "tsne": decomposition.tsne_embed(df, "id", "features", epochs=250, perplexity=10, rate=50),
        "umap": decomposition.umap_embed(df, "id", "features", 10, 100),
    }
    for name, y in embedded.items():
        rows = y.collect()
        points, labels = np.array([r.y for r in rows]), np.array([label[r.id] for r in rows])
        centres = np.array([points[labels == c].mean(0) for c in range(3)])
        inside = np.mean([points[labels == c].var(0).sum() for c in range(3)])
        assert centres.var(0).sum() > inside, name
    with pytest.raises(ValueError):
        decomposition.points(df, "id", "features", 10)


def test_perplexity_and_curve():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = decomposition.precisions(d, 8.0)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp([-(r[r > 0] * np.log(r[r > 0])).sum() for r in p]), 8, rtol=1e-3)
    rho, sigma = decomposition.smooth_widths(np.sort(rng.random((30, 8)), 1))
    assert (sigma > 0).all()
    a, b = decomposition.curve(0.1)
    assert 1.4 < a < 1.8 and 0.8 < b < 1.0


def test_splits(spark):
    df = spark.range(1_000).withColumn("s", F.col("id") % 3)
    assert preprocessing.train_test_split(df, "id", 0.25).where("fold = 'test'").count() == 250
    assert preprocessing.train_test_split(df, "id", 17).where("fold = 'test'").count() == 17
    by = preprocessing.train_test_split(df, "id", 0.5, stratify="s").where("fold = 'test'").groupBy("s").count().collect()
    assert sorted(r["count"] for r in by) == [167, 167, 167]
    assert preprocessing.cross_validation(df, "id", 4, lambda d: d.count(), lambda n, d: n + d.count()) == 1_000
    with pytest.raises(KeyError):
        preprocessing.basis("none of these")
    assert list(itertools.islice(preprocessing.BASES, 1)) == ["gaussian"]


def test_relevance_vectors_are_few(spark):
    x = np.linspace(-5, 5, 100)
    y = np.sinc(x / 2) + np.random.default_rng(1).normal(0, 0.02, 100)
    df = spark.createDataFrame([(i, [float(a)], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x array<double>, y double")
    model = svm.Rvm(parameters={"sigma": 1.5}, max_iter=300).fit(df, "id", "x", "y")
    assert len(model.used) < 30 and np.abs(model.predict_array(x[:, None]) - np.sinc(x / 2)).max() < 0.1


def test_loops(spark):
    from quillon.plans import loops

    state, history = loops.iterate(lambda v: (v / 2, v / 2), 1.0, 50, 1e-3)
    assert state < 2e-3 and history.frame(spark).count() == len(history.rows) < 50 and not loops.above(history, "change", 1.0)
    assert loops.timed(lambda seed: seed, repetitions=3) >= 0 and loops.generator(3).random() == loops.generator(3).random()
    registry = loops.Registry("shape", square=lambda side=1: side * side)
    assert registry.make("square", side=3) == 9 and registry.make(len) is len
    with pytest.raises(KeyError):
        registry.make("circle")
    with pytest.raises(KeyError):
        loops.one_of(mode=("x", ("a", "b")))
    with pytest.raises(ValueError):
        loops.iterate(None, 0, -1)


def test_epsilon_pairs_cut_full_cells_into_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (90, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = clustering.epsilon_pairs(df, "id", "v", 0.9, 2, rows_a_block=7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan  # distances are not folded row by row
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((int(i), int(j)) for i, j in np.argwhere(d <= 0.9))


def test_smo_by_rows_of_the_gram_matrix():
    x = np.random.default_rng(2).normal(size=(60, 5))
    t = np.where(x[:, 0] + x[:, 1] ** 2 > 0.5, 1.0, -1.0)
    rows = svm.GramRows("gaussian", x, kept_bytes=3 * 8 * 60, sigma=1.0)
    whole = regression.kernel_values("gaussian", x, x, sigma=1.0)
    a, b = svm.smo(rows, t, 10.0, 20)
    want, c = svm.smo(whole, t, 10.0, 20)
    assert len(rows.kept) <= 3 and np.allclose([rows[i] for i in range(60)], whole)
    worth = lambda a: a.sum() - (a * t) @ whole @ (a * t) / 2
    assert np.isclose(worth(a), worth(want), rtol=1e-3) and np.isclose(b, c, atol=0.05)  # the order of rounding bends the path
    assert np.mean(np.sign(whole @ (a * t) + b) == t) >= 0.95
    assert svm.Svm().max_rows is None


def test_gram_rows_asked_together_and_one_store_of_support_vectors(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    rows = svm.GramRows("gaussian", x, sigma=1.0)
    rows.ask(np.arange(7, 20))
    assert list(rows.kept) == list(range(7, 20))
    assert np.allclose([rows.kept[i] for i in range(7, 20)], regression.kernel_values("gaussian", x[7:20], x, sigma=1.0))
    df = frame(spark, sampling.blobs(60, 3, 2, 0.5, seed=6))
    model = svm.Svm(parameters={"sigma": 1.0}, c=10.0, sweeps=5).fit(df, "id", "features", "label")
    points = np.array([r[0] for r in df.orderBy("id").select("features").collect()])
    want = [regression.kernel_values("gaussian", points, points[used], sigma=1.0) @ at + b for _, b, at, used in model.problems]
    assert np.allclose(model.decide(points), np.stack(want, 1)) and len(model.vectors) <= len(points)


def test_embeddings_by_blocks_are_those_of_whole_matrices(spark):
    df = frame(spark, sampling.blobs(90, 3, 5, 0.3, seed=6))
    told = lambda found: np.array([r.y for r in found.orderBy("id").collect()])
    kernel = lambda dense: told(decomposition.KernelPca(2, parameters={"sigma": 3.0}, dense_rows=dense).fit_transform(df, "id", "features"))
    assert np.allclose(kernel(10), kernel(90), atol=1e-7)
    embedded = lambda dense: told(decomposition.tsne_embed(df, "id", "features", dense_rows=dense, epochs=12, perplexity=10, rate=50))
    assert np.allclose(embedded(10), embedded(90), rtol=1e-6, atol=1e-8)


def test_tsne_query_runs_every_epoch(spark, monkeypatch):
    asked = {}
    whole = decomposition.tsne

    def told(x, **options):
        asked.update(inspect.signature(whole).bind(x, **options).arguments)
        return np.zeros((len(x), 2))

    monkeypatch.setattr(decomposition, "tsne", told)
    QUERIES["tsne_fit"](spark, "/root/testdata/sf0.001")
    default = lambda name: inspect.signature(whole).parameters[name].default
    assert default("epochs") == 1_000 and all(asked.get(k, default(k)) == default(k) for k in ("epochs", "perplexity", "rate", "initial_dims"))


def test_tsne_gradient_by_blocks_in_one_pass_and_with_the_floor(spark, monkeypatch):
    rng, passes = np.random.default_rng(8), []
    x = rng.normal(size=(60, 6))
    by_pairs = decomposition.by_pairs
    monkeypatch.setattr(decomposition, "by_pairs", lambda *a, **k: (passes.append(1), by_pairs(*a, **k))[1])
    dense, blocks = decomposition._gradient(x, 9.0), decomposition._gradient_by_blocks(spark, x, 9.0)
    for spread, most in ((1.0, 1), (1e6, 2)):
        y = rng.normal(size=(60, 2)) * spread
        y[:30] /= spread
        passes.clear()
        assert np.allclose(blocks(y, 0.25), dense(y, 0.25), rtol=1e-7, atol=1e-10)
        assert len(passes) == most


def test_leading_eigenvectors():
    m = np.random.default_rng(5).normal(size=(60, 60))
    m = m + m.T
    for most in (3, 30):  # with restarts and without
        found = decomposition.leading(lambda v: m @ v, 60, 3, most=most)
        _, want = np.linalg.eigh(m)
        assert np.allclose(np.abs(found.T @ want[:, ::-1][:, :3]), np.eye(3), atol=1e-5)
    flat = decomposition.leading(lambda v: np.ones((20, 20)) @ v, 20, 2)  # one eigenvalue and a space of zeros
    assert np.allclose(np.abs(flat[:, 0]), 20**-0.5)


def test_leading_eigenvectors_from_an_approximation_take_few_products():
    x = np.random.default_rng(3).normal(size=(400, 30))
    k = x @ np.diag(np.linspace(2, 1, 30)) @ x.T
    rough = k + 0.5 * np.diag(np.random.default_rng(4).normal(size=400))
    values, vectors = np.linalg.eigh(rough)
    calls = []
    apply = lambda v: (calls.append(v.shape[1]), k @ v)[1]
    found = decomposition.leading_from(apply, vectors[:, ::-1][:, :30], values[::-1][:30], 2)
    _, want = np.linalg.eigh(k)
    assert np.allclose(np.abs(found.T @ want[:, ::-1][:, :2]), np.eye(2), atol=1e-6)
    assert len(calls) <= 8 and sum(calls) <= 24
    calls.clear()
    found = decomposition.leading_from(apply, np.linalg.qr(np.random.default_rng(5).normal(size=(400, 5)))[0], np.ones(5), 2)  # a start that says nothing
    assert np.allclose(np.abs(found.T @ want[:, ::-1][:, :2]), np.eye(2), atol=1e-6)


def test_pairs_of_blocks_meet_once(spark):
    k = np.random.default_rng(3).normal(size=(50, 50))
    k, v = k + k.T, np.arange(100.0).reshape(50, 2)

    def some(out, i, j, spare):
        out[i] += k[i, j] @ v[j]
        if i != j:
            out[j] += k[i, j].T @ v[i]

    assert np.allclose(decomposition.by_pairs(spark, 50, 2, some, tile=7), k @ v)


@pytest.mark.parametrize("name", ["kpca_fit", "tsne_fit", "umap_fit"])
def test_embedding_queries_take_more_than_5000_rows(spark, tmp_path, name):
    rows = spark.range(5_003).selectExpr("id AS vec_id", "transform(sequence(1, 4), i -> cast(sin(id * i) as float)) AS embedding", "cast(id % 3 as int) AS label")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES[name](spark, str(tmp_path)).where("size(y) = 2").count() == 5_003
