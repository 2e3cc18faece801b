"""K-Means, mixtures, DBSCAN."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.operators import clustering as C
from quillon.queries._registry import E, embeddings, query, r6


def first_centres(spark, sf_dir, k=8):
    """The embeddings of the k smallest ids, as starting centres."""
    rows = embeddings(spark, sf_dir).orderBy("vec_id").limit(k).collect()
    return np.array([r["v"] for r in rows])


def _lloyd_sql(steps: int, k: int = 8) -> str:
    """Common table expressions a0, c1, a1, c2, ...: assignments and centres of so many steps."""
    out = [E, f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, v AS c FROM e QUALIFY row_number() OVER (ORDER BY vec_id) <= {k})"]
    for i in range(steps + 1):
        out.append(
            f"a{i} AS (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, list_distance(v, c) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), k) AS r FROM e, c{i}) WHERE r = 1)"
        )
        out.append(
            f"c{i + 1} AS (SELECT k, list(m ORDER BY dim) AS c FROM (SELECT k, dim, avg(v[dim]) AS m FROM a{i}, (SELECT unnest(range(1, 65))::INTEGER AS dim) GROUP BY k, dim) GROUP BY k)"
        )
    return "WITH " + ", ".join(out)


@query("kmeans_assign", _lloyd_sql(0) + " SELECT vec_id, k::INTEGER AS cluster, round(d * d, 6) + 0 AS sq_distance FROM a0")
def kmeans_assign(spark, sf_dir):
    found = C.assign(embeddings(spark, sf_dir), "v", first_centres(spark, sf_dir))
    return found.select("vec_id", "cluster", r6(F.col("sq_distance")).alias("sq_distance"))


@query("kmeans_update", _lloyd_sql(0) + " SELECT k::INTEGER AS cluster, i - 1 AS dim, round(c[i], 6) + 0 AS x FROM c1, (SELECT unnest(range(1, 65))::INTEGER AS i)")
def kmeans_update(spark, sf_dir):
    model = C.KMeans(init=first_centres(spark, sf_dir), max_iter=1).fit(embeddings(spark, sf_dir), "vec_id", "v")
    rows = [(k, d, round(float(x), 6) + 0.0) for k, c in enumerate(model.centres) for d, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, dim int, x double")


@query("kmeans_lloyd3", _lloyd_sql(3) + " SELECT k::INTEGER AS cluster, count(*) AS n, round(sum(d), 5) + 0 AS inertia, round(sum(d * d), 5) + 0 AS inertia_sq FROM a3 GROUP BY k")
def kmeans_lloyd3(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    model = C.KMeans(init=first_centres(spark, sf_dir), max_iter=3, tol=0.0).fit(rows, "vec_id", "v")
    found = model.transform(rows, "v").groupBy("cluster")
    d = F.col("sq_distance")
    return found.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.sqrt(d)), 5) + F.lit(0.0)).alias("inertia"), (F.round(F.sum(d), 5) + F.lit(0.0)).alias("inertia_sq"))


def _bounded(algorithm):
    @query(f"kmeans_{algorithm}", _lloyd_sql(3) + " SELECT vec_id, k::INTEGER AS cluster, round(d * d, 6) + 0 AS sq_distance FROM a3")
    def run(spark, sf_dir):
        """Under the names that promise bounds the centres and clusters are those of the plain iteration."""
        rows = embeddings(spark, sf_dir)
        model = C.KMeans(init=first_centres(spark, sf_dir), algorithm=algorithm, max_iter=3, tol=0.0).fit(rows, "vec_id", "v")
        return model.transform(rows, "v").select("vec_id", "cluster", r6(F.col("sq_distance")).alias("sq_distance"))


_bounded("elkan")
_bounded("hamerly")


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    """k++ start and iterations until the centres rest, under the name that uses bounds."""
    rows = embeddings(spark, sf_dir)
    model = C.KMeans(k=10, algorithm="elkan", max_iter=20, seed=3).fit(rows, "vec_id", "v")
    return model.transform(rows, "v").select("vec_id", "label", "cluster", "sq_distance")


@query("cluster_contingency", _lloyd_sql(3) + " SELECT e.label, a3.k::INTEGER AS cluster, count(*) AS n FROM a3 JOIN e USING (vec_id) GROUP BY ALL")
def cluster_contingency(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    model = C.KMeans(init=first_centres(spark, sf_dir), max_iter=3, tol=0.0).fit(rows, "vec_id", "v")
    return model.transform(rows, "v").groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cluster_accuracy",
    _lloyd_sql(10, 10).replace("WITH", "WITH RECURSIVE", 1)
    + """, g AS (SELECT *, row_number() OVER (ORDER BY n DESC, label::VARCHAR, k::VARCHAR) AS r FROM (SELECT label, k, count(*) AS n FROM a10 JOIN e USING (vec_id, v) GROUP BY ALL)),
    t(r, labels, ks, hit) AS (SELECT 0::BIGINT, []::INTEGER[], []::BIGINT[], 0::BIGINT UNION ALL
      SELECT g.r, CASE WHEN free THEN list_append(labels, label) ELSE labels END, CASE WHEN free THEN list_append(ks, k) ELSE ks END, CASE WHEN free THEN hit + n ELSE hit END
      FROM (SELECT t.*, NOT list_contains(labels, g.label) AND NOT list_contains(ks, g.k) AS free, g.r AS next FROM t JOIN g ON g.r = t.r + 1) t JOIN g ON g.r = next)
    SELECT round((SELECT max(hit) FROM t) / (SELECT count(*) FROM e), 6) + 0 AS accuracy""",
)
def cluster_accuracy(spark, sf_dir):
    """D14"""
    rows = embeddings(spark, sf_dir)
    model = C.KMeans(init=first_centres(spark, sf_dir, 10), max_iter=10, tol=0.0).fit(rows, "vec_id", "v")
    return spark.createDataFrame([(round(C.cluster_accuracy(model.transform(rows, "v"), "label", "cluster"), 6),)], "accuracy double")


# -- DBSCAN over all components: at this eps some 0.2 % of all pairs are neighbours

EPS, LEAST = 1.14, 4
NEAR = f"{E}, n AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a, e b WHERE list_distance(a.v, b.v) <= {EPS}::DOUBLE), core AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= {LEAST})"


@query("dbscan_core", f"WITH {NEAR} SELECT vec_id, vec_id IN (SELECT id FROM core) AS core, (SELECT count(*) FROM n WHERE a = vec_id) AS neighbours FROM e")
def dbscan_core(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    near = C.epsilon_pairs(rows, "vec_id", "v", EPS, 2)
    counts = rows.select("vec_id").join(near.groupBy(F.col("a").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")), "vec_id", "left")
    return counts.select("vec_id", F.coalesce(F.col("n") >= LEAST, F.lit(False)).alias("core"), F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


@query(
    "dbscan_labels",
    f"""WITH RECURSIVE {NEAR}, l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    walk(id, root) AS (SELECT id, id FROM core UNION SELECT l.b, w.root FROM walk w JOIN l ON l.a = w.id WHERE w.root < l.b),
    roots AS (SELECT id, min(root) AS root FROM walk GROUP BY id), numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots)
    SELECT vec_id, r.id IS NOT NULL AS core, coalesce(r.cluster, (SELECT min(x.cluster) FROM n JOIN numbered x ON x.id = n.b WHERE n.a = vec_id), -1)::INTEGER AS cluster
    FROM e LEFT JOIN numbered r ON r.id = vec_id""",
)
def dbscan_labels(spark, sf_dir):
    return C.dbscan(embeddings(spark, sf_dir), "vec_id", "v", EPS, LEAST)


# -- mixtures over the first two components

MIX_MEANS, MIX_COV, MIX_WEIGHTS = np.array([[0.0, 0.0], [0.1, -0.1]]), np.array([[[0.02, 0.005], [0.005, 0.01]], [[0.01, 0.0], [0.0, 0.02]]]), np.array([0.6, 0.4])
#: ln(weight) + ln(density) of the two components, written out
MIX_SQL = f"""{E}, x AS (SELECT vec_id, v[1] AS a, v[2] AS b FROM e),
    j AS (SELECT vec_id, a, b, ln(0.6::DOUBLE) - ln(2 * pi()) - 0.5::DOUBLE * ln(0.000175::DOUBLE) - 0.5::DOUBLE * (0.01::DOUBLE * a * a - 2 * 0.005::DOUBLE * a * b + 0.02::DOUBLE * b * b) / 0.000175::DOUBLE AS p0,
      ln(0.4::DOUBLE) - ln(2 * pi()) - 0.5::DOUBLE * ln(0.0002::DOUBLE) - 0.5::DOUBLE * ((a - 0.1::DOUBLE) * (a - 0.1::DOUBLE) / 0.01::DOUBLE + (b + 0.1::DOUBLE) * (b + 0.1::DOUBLE) / 0.02::DOUBLE) AS p1 FROM x),
    g AS (SELECT *, exp(p0) / (exp(p0) + exp(p1)) AS g0, exp(p1) / (exp(p0) + exp(p1)) AS g1 FROM j)"""


def _mixture():
    return C.GaussianMixture(k=2, weights=MIX_WEIGHTS, means=MIX_MEANS, covariances=MIX_COV)


def _plane(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.slice("v", 1, 2).alias("x"))


@query("gmm_estep", f"WITH {MIX_SQL} SELECT vec_id, round(g0, 6) + 0 AS g0, round(g1, 6) + 0 AS g1, CASE WHEN g1 > g0 THEN 1 ELSE 0 END AS cluster FROM g")
def gmm_estep(spark, sf_dir):
    found = _mixture().responsibilities(_plane(spark, sf_dir), "vec_id", "x")
    return found.select("vec_id", r6(F.col("g")[0]).alias("g0"), r6(F.col("g")[1]).alias("g1"), "cluster")


@query("gmm_loglikelihood", f"WITH {MIX_SQL} SELECT round(sum(ln(exp(p0) + exp(p1))), 5) + 0 AS log_likelihood FROM g")
def gmm_loglikelihood(spark, sf_dir):
    return spark.createDataFrame([(round(_mixture().log_likelihood(_plane(spark, sf_dir), "x"), 5) + 0.0,)], "log_likelihood double")


@query(
    "gmm_mstep",
    f"""WITH {MIX_SQL}, l AS (SELECT 0 AS k, g0 AS g, a, b FROM g UNION ALL SELECT 1, g1, a, b FROM g),
    s AS (SELECT k, sum(g) AS n, sum(g * a) / sum(g) AS ma, sum(g * b) / sum(g) AS mb, sum(g * a * b) / sum(g) AS ab, sum(g * a * a) / sum(g) AS aa FROM l GROUP BY k)
    SELECT k, round(n / sum(n) OVER (), 6) + 0 AS weight, round(ma, 6) + 0 AS mean0, round(mb, 6) + 0 AS mean1, round(aa - ma * ma, 6) + 0 AS var0, round(ab - ma * mb, 6) + 0 AS cov01 FROM s""",
)
def gmm_mstep(spark, sf_dir):
    s, _ = _mixture().sums(_plane(spark, sf_dir), "x")
    n = s[:, 0, 0]
    m = s[:, 0, 1:] / n[:, None]
    c = s[:, 1:, 1:] / n[:, None, None] - m[:, :, None] * m[:, None, :]
    rows = [(k, *(round(float(x), 6) + 0.0 for x in (n[k] / n.sum(), m[k, 0], m[k, 1], c[k, 0, 0], c[k, 0, 1]))) for k in range(2)]
    return spark.createDataFrame(rows, "k int, weight double, mean0 double, mean1 double, var0 double, cov01 double")


@query("gmm_fit")
def gmm_fit(spark, sf_dir):
    """EM from the first centres of the plane."""
    rows = _plane(spark, sf_dir)
    model = C.GaussianMixture(k=3, init=first_centres(spark, sf_dir, 3)[:, :2], max_iter=10).fit(rows, "vec_id", "x")
    return model.responsibilities(rows, "vec_id", "x")


@query(
    "gauss_logpdf_diag",
    f"WITH {E} SELECT vec_id, round(-0.5::DOUBLE * (64 * ln(2 * pi()) + 64 * ln(0.02::DOUBLE) + list_inner_product(v, v) / 0.02::DOUBLE), 5) + 0 AS log_density FROM e",
)
def gauss_logpdf_diag(spark, sf_dir):
    """D24 as an expression: 64 dimensions of variance 0.02 about 0."""
    from quillon.functions import vectors as V

    d = 64
    density = F.lit(-0.5) * (F.lit(d * float(np.log(2 * np.pi)) + d * float(np.log(0.02))) + V.sq_norm(F.col("v")) / F.lit(0.02))
    return embeddings(spark, sf_dir).select("vec_id", (F.round(density, 5) + F.lit(0.0)).alias("log_density"))


@query("events_by_type", "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0 AS mean FROM events GROUP BY ALL")
def events_by_type(spark, sf_dir):
    """Means of groups, the M-step of a clustering whose assignment is given."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
