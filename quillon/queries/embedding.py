"""Dimensionality reduction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import clustering, linalg, pairs
from quillon.operators import decomposition as R
from quillon.queries._registry import E, embeddings, query, r6

LONG = f"WITH {E}, x AS (SELECT vec_id, label, i - 1 AS dim, v[i] AS x FROM e, (SELECT unnest(range(1, 65))::INTEGER AS i))"


@query("pca_covariance", f"{LONG} SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 8) + 0 AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY ALL")
def pca_covariance(spark, sf_dir):
    _, cov, _ = linalg.covariance(embeddings(spark, sf_dir), F.col("v"))
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 8) + 0.0) for i in range(64) for j in range(i, 64)], "i int, j int, cov double")


@query(
    "covariance_kinds",
    f"""{LONG}, c AS (SELECT a.dim AS i, b.dim AS j, covar_samp(a.x, b.x) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL), t AS (SELECT sum(c) / 64 AS t FROM c WHERE i = j)
    SELECT kind, k, i, j, round(CASE WHEN kind IN ('full', 'tied') THEN c WHEN i <> j THEN 0 WHEN kind = 'diag' THEN c ELSE t END, 8) + 0 AS cov
    FROM c, t, (VALUES ('spherical'), ('diag'), ('tied'), ('full')) y(kind), (VALUES (0), (1)) z(k)""",
)
def covariance_kinds(spark, sf_dir):
    """One covariance as the parameters of two components of each kind, and back as matrices."""
    _, cov, _ = linalg.covariance(embeddings(spark, sf_dir), F.col("v"))
    rows = []
    for kind in ("spherical", "diag", "tied", "full"):
        for k, m in enumerate(clustering.covariance_full(clustering.covariance_as(cov, kind, 2), kind, 2, len(cov))):
            rows += [(kind, k, i, j, round(float(m[i, j]), 8) + 0.0) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "kind string, k int, i int, j int, cov double")


@query(
    "pca_project",
    f"""WITH {E}, x AS (SELECT i, avg(v[i]) AS m FROM e, (SELECT unnest(range(1, 65))::INTEGER AS i) GROUP BY i), m AS (SELECT list(m ORDER BY i) AS m FROM x)
    SELECT vec_id, round(list_sum(list_transform(list_zip(v, m), lambda t: (t[1] - t[2]) / 8)), 6) + 0 AS y0,
    round(list_sum(list_transform(list_zip(v, m, range(64)), lambda t: (t[1] - t[2]) / 8 * CASE WHEN t[3] % 2 = 0 THEN 1 ELSE -1 END)), 6) + 0 AS y1 FROM e, m""",
)
def pca_project(spark, sf_dir):
    """R02 with two given components."""
    rows = embeddings(spark, sf_dir)
    mean, _, _ = linalg.covariance(rows, F.col("v"))
    model = R.Pca(2, mean, np.array([np.full(64, 0.125), 0.125 * (-1.0) ** np.arange(64)]))
    return rows.select("vec_id", model.transform("v").alias("y")).select("vec_id", r6(F.col("y")[0]).alias("y0"), r6(F.col("y")[1]).alias("y1"))


@query("pca_fit")
def pca_fit(spark, sf_dir):
    """(component, variance, ratio, the first two loadings)."""
    model = R.Pca(5).fit(embeddings(spark, sf_dir), "v")
    rows = [(i, float(v), float(r), float(c[0]), float(c[1])) for i, (v, r, c) in enumerate(zip(model.variance, model.ratio, model.components, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, ratio double, w0 double, w1 double")


LDA = f"""WITH {E}, x AS (SELECT vec_id, label, v[1] AS a, v[2] AS b FROM e WHERE label IN (0, 1)),
    s AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab FROM x GROUP BY label),
    w AS (SELECT sum(saa) AS saa, sum(sbb) AS sbb, sum(sab) AS sab, sum(CASE WHEN label = 1 THEN ma ELSE -ma END) AS da, sum(CASE WHEN label = 1 THEN mb ELSE -mb END) AS db FROM s),
    d AS (SELECT (sbb * da - sab * db) / (saa * sbb - sab * sab) AS wa, (saa * db - sab * da) / (saa * sbb - sab * sab) AS wb FROM w),
    u AS (SELECT wa / sqrt(wa * wa + wb * wb) AS wa, wb / sqrt(wa * wa + wb * wb) AS wb FROM d)"""


@query("lda_direction", LDA + " SELECT round(wa, 6) + 0 AS w0, round(wb, 6) + 0 AS w1 FROM u")
def lda_direction(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    w = R.lda_direction(rows, F.slice("v", 1, 2), F.col("label"), 0, 1)
    return spark.createDataFrame([tuple(round(float(x), 6) + 0.0 for x in w)], "w0 double, w1 double")


@query("lda_project", LDA + " SELECT e.vec_id, round(e.v[1] * wa + e.v[2] * wb, 6) + 0 AS y FROM e, u")
def lda_project(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    w = R.lda_direction(rows, F.slice("v", 1, 2), F.col("label"), 0, 1)
    return rows.select("vec_id", r6(R.project(F.slice("v", 1, 2), w)).alias("y"))


@query(
    "kpca_centred_gram",
    f"""WITH {E}, k AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v)) / 2) AS k FROM e a, e b),
    m AS (SELECT i, avg(k) AS m FROM k GROUP BY i), t AS (SELECT avg(m) AS t FROM m)
    SELECT i AS q_vec_id, j AS vec_id, round(k - a.m - b.m + t, 6) + 0 AS k FROM k JOIN m a USING (i) JOIN m b ON b.i = k.j, t WHERE i % 100 = 0""",
)
def kpca_centred_gram(spark, sf_dir):
    """The centred kernel of the queries (ids divisible by 100) and all rows; means are over all pairs."""
    from quillon.functions import vectors as V

    rows = embeddings(spark, sf_dir)
    means = R.kernel_means(rows, "vec_id", "v", "gaussian", {"sigma": 1.0}).select("id", (F.col("total") / F.col("n")).alias("m"))
    every = means.agg(F.avg("m").alias("t"))
    k = pairs.gram(rows.where(F.col("vec_id") % 100 == 0), rows, "vec_id", "v", V.gaussian())
    both = k.join(means.select(F.col("id").alias("vec_id"), F.col("m").alias("mj")), "vec_id").join(means.select(F.col("id").alias("q_vec_id"), F.col("m").alias("mi")), "q_vec_id")
    return both.crossJoin(F.broadcast(every)).select("q_vec_id", "vec_id", r6(F.col("k") - F.col("mi") - F.col("mj") + F.col("t")).alias("k"))


@query("kpca_fit")
def kpca_fit(spark, sf_dir):
    return R.KernelPca(2).fit_transform(embeddings(spark, sf_dir), "vec_id", "v")


@query(
    "tsne_affinity",
    f"""WITH {E}, d AS (SELECT q.vec_id AS q_vec_id, e.vec_id, list_inner_product(q.v, q.v) + list_inner_product(e.v, e.v) - 2 * list_inner_product(q.v, e.v) AS d FROM e q, e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
    p AS (SELECT q_vec_id, vec_id, exp(-2 * d) / sum(exp(-2 * d)) OVER (PARTITION BY q_vec_id) AS p FROM d)
    SELECT q_vec_id, vec_id, round(p, 8) + 0 AS p, round(sum(-p * ln(p)) OVER (PARTITION BY q_vec_id), 6) + 0 AS log_perplexity FROM p""",
)
def tsne_affinity(spark, sf_dir):
    """R06 at precision 2, for the queries against all rows."""
    rows = embeddings(spark, sf_dir)
    found = pairs.pairwise_distances(rows.where(F.col("vec_id") % 100 == 0), rows, "vec_id", "v", "sqeuclidean").where("q_vec_id <> vec_id")
    mine = Window.partitionBy("q_vec_id")
    weighed = found.withColumn("w", F.exp(F.col("distance") * F.lit(-2.0))).withColumn("p", F.col("w") / F.sum("w").over(mine))
    return weighed.select("q_vec_id", "vec_id", (F.round("p", 8) + F.lit(0.0)).alias("p"), r6(F.sum(-F.col("p") * F.ln("p")).over(mine)).alias("log_perplexity"))


@query("tsne_fit")
def tsne_fit(spark, sf_dir):
    """R07, R08, all epochs of the operator: the exaggeration ends after the first hundred of a thousand."""
    return R.tsne_embed(embeddings(spark, sf_dir), "vec_id", "v")


KNN = f"""{E}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END AS d FROM e a, e b),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN id = other THEN -1 ELSE round(d, 12) END, other) AS rank FROM d QUALIFY rank <= 6)"""


@query("umap_knn", f"WITH {KNN} SELECT id, other, round(d, 6) + 0 AS distance, rank::INTEGER AS rank FROM n")
def umap_knn(spark, sf_dir):
    found = R.nearest_neighbours(embeddings(spark, sf_dir), "vec_id", "v", 6)
    return found.select("id", "other", r6(F.col("distance")).alias("distance"), "rank")


@query("umap_rho", f"WITH {KNN} SELECT DISTINCT id, round(d, 6) + 0 AS rho FROM n WHERE rank = 2")
def umap_rho(spark, sf_dir):
    found = R.memberships(R.nearest_neighbours(embeddings(spark, sf_dir), "vec_id", "v", 6))
    return found.select("id", r6(F.col("rho")).alias("rho")).distinct()


@query(
    "umap_fuzzy_union",
    f"""WITH {KNN}, r AS (SELECT id, d AS rho FROM n WHERE rank = 2), a AS (SELECT n.id, other, exp(-greatest(d - rho, 0) / 0.5::DOUBLE) AS w FROM n JOIN r USING (id) WHERE n.id <> other),
    b AS (SELECT coalesce(x.id, y.other) AS id, coalesce(x.other, y.id) AS other, coalesce(x.w, 0) AS p, coalesce(y.w, 0) AS q FROM a x FULL JOIN a y ON x.id = y.other AND x.other = y.id)
    SELECT id, other, round(p + q - p * q, 6) + 0 AS weight FROM b""",
)
def umap_fuzzy_union(spark, sf_dir):
    """R09 with sigma given as 0.5, which SQL can say; the fitted widths are in umap_fit."""
    near = R.nearest_neighbours(embeddings(spark, sf_dir), "vec_id", "v", 6)
    rho = near.where("rank = 2").select("id", F.col("distance").alias("rho"))
    weights = near.join(rho, "id").where("id <> other").select("id", "other", F.exp(-F.greatest(F.col("distance") - F.col("rho"), F.lit(0.0)) / F.lit(0.5)).alias("weight"))
    return R.fuzzy_union(weights).select("id", "other", r6(F.col("weight")).alias("weight"))


@query(
    "umap_graph",
    f"""WITH RECURSIVE {KNN.replace('rank <= 6', 'rank <= 10')}, l AS (SELECT id, list(d ORDER BY d) AS d FROM n GROUP BY id),
    gaps AS (SELECT id, list_transform(d, lambda x: greatest(x - d[2], 0)) AS gaps FROM l),
    w(id, gaps, step, low, high, sigma) AS (SELECT id, gaps, 0, 0::DOUBLE, 'inf'::DOUBLE, 1::DOUBLE FROM gaps UNION ALL
      SELECT id, gaps, step + 1, new_low, new_high, CASE WHEN abs(total - log2(10)) < {{tol}}::DOUBLE THEN sigma ELSE greatest(CASE WHEN isinf(new_high) THEN sigma * 2 ELSE (new_low + new_high) / 2 END, 1e-12::DOUBLE) END
      FROM (SELECT *, CASE WHEN total > log2(10) THEN sigma ELSE high END AS new_high, CASE WHEN total > log2(10) THEN low ELSE sigma END AS new_low
        FROM (SELECT *, list_sum(list_transform(gaps, lambda g: exp(-g / sigma))) - 1 AS total FROM w WHERE step < {{steps}}))),
    a AS (SELECT n.id, other, exp(-greatest(n.d - l.d[2], 0) / sigma) AS w FROM n JOIN l USING (id) JOIN w USING (id) WHERE step = {{steps}} AND n.id <> other),
    b AS (SELECT coalesce(x.id, y.other) AS id, coalesce(x.other, y.id) AS other, coalesce(x.w, 0) AS p, coalesce(y.w, 0) AS q FROM a x FULL JOIN a y ON x.id = y.other AND x.other = y.id),
    u AS (SELECT id, other, p + q - p * q AS weight FROM b)
    SELECT id, other, round(weight, 6) + 0 AS weight, round((SELECT max(weight) FROM u) / weight, 4) + 0 AS every FROM u WHERE weight >= (SELECT max(weight) FROM u) / 200""".format(tol=R.WIDTH_TOL, steps=R.WIDTH_STEPS),
)
def umap_graph(spark, sf_dir):
    """The pruned fuzzy graph with fitted widths."""
    found = R.pruned(R.fuzzy_union(R.memberships(R.nearest_neighbours(embeddings(spark, sf_dir), "vec_id", "v", 10))), 200)
    return found.select("id", "other", r6(F.col("weight")).alias("weight"), (F.round("every", 4) + F.lit(0.0)).alias("every"))


@query("umap_fit")
def umap_fit(spark, sf_dir):
    """R11 to R13"""
    return R.umap_embed(embeddings(spark, sf_dir), "vec_id", "v", 10, 30)
