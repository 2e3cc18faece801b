"""Vectors, distances, kernels, scaling, encoding and bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.functions import vectors as V
from quillon.operators import pairs
from quillon.operators import preprocessing as P
from quillon.queries._registry import E, embeddings, query, r6

NEXT = f"WITH {E}, p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def neighbours(spark, sf_dir):
    """Each embedding x beside the next one y."""
    a = embeddings(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("y"))
    return a.select("vec_id", F.col("v").alias("x")).join(b, "vec_id")


@query("vector_norms", f"WITH {E} SELECT vec_id, round(list_inner_product(v, v), 6) + 0 AS sq_norm, round(sqrt(list_inner_product(v, v)), 6) + 0 AS norm FROM e")
def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", r6(V.sq_norm(F.col("v"))).alias("sq_norm"), r6(V.norm(F.col("v"))).alias("norm"))


@query(
    "unit_vectors",
    f"WITH {E}, n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e) SELECT vec_id, i - 1 AS dim, round(v[i] / n, 6) + 0 AS x FROM n, (SELECT unnest(range(1, 65))::INTEGER AS i)",
)
def unit_vectors(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.unit(F.col("v"))).alias("dim", "x"))
    return rows.select("vec_id", "dim", r6(F.col("x")).alias("x"))


@query(
    "pairwise_euclid",
    f"WITH {E} SELECT q.vec_id AS q_vec_id, e.vec_id, CASE WHEN q.vec_id = e.vec_id THEN 0 ELSE round(list_distance(q.v, e.v), 6) + 0 END AS distance FROM e q, e WHERE q.vec_id % 100 = 0",
)
def pairwise_euclid(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    found = pairs.pairwise_distances(rows.where(F.col("vec_id") % 100 == 0), rows, "vec_id", "v")
    return found.select("q_vec_id", "vec_id", r6(F.col("distance")).alias("distance"))


@query(
    "paired_distances",
    NEXT
    + """ SELECT vec_id, round(list_distance(x, y), 6) + 0 AS euclidean, round(list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))), 6) + 0 AS manhattan,
    round(1 - list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 6) + 0 AS cosine,
    round(list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 6) + 0 AS sqeuclidean FROM p""",
)
def paired_distances(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return neighbours(spark, sf_dir).select("vec_id", *(r6(V.metric(m)(x, y)).alias(m) for m in V.METRICS))


KERNEL_SQL = {
    "linear": "dot",
    "polynomial": "pow(dot, 3)",
    "gaussian": "exp(-sq / 2)",
    "exponential": "exp(-l1 / 128)",
    "laplacian": "exp(-l1 / 8)",
    "sigmoid": "tanh(dot)",
    "rational_quadratic": "1 - sq / (sq + 1)",
    "multiquadric": "sqrt(sq + 1)",
    "inverse_multiquadric": "1 / sqrt(sq + 1)",
    "log": "-ln(cubes + 1)",
}
KERNEL_PARAMETERS = {"exponential": {"sigma": 8.0}, "laplacian": {"sigma": 8.0}}
PARTS = (
    NEXT
    + """, s AS (SELECT vec_id, list_inner_product(x, y) AS dot, list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS sq,
    list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))) AS l1, list_sum(list_transform(list_zip(x, y), lambda t: pow(abs(t[1] - t[2]), 3))) AS cubes FROM p)"""
)


def _kernel(name):
    k = V.kernel(name, **KERNEL_PARAMETERS.get(name, {}))

    @query(f"kernel_{name}", f"{PARTS} SELECT vec_id, round({KERNEL_SQL[name]}, 6) + 0 AS k FROM s")
    def run(spark, sf_dir):
        return neighbours(spark, sf_dir).select("vec_id", r6(k(F.col("x"), F.col("y"))).alias("k"))


for _name in V.KERNELS:
    _kernel(_name)


@query(
    "kernel_gram",
    f"WITH {E} SELECT q.vec_id AS q_vec_id, e.vec_id, round(exp(-(list_inner_product(q.v, q.v) + list_inner_product(e.v, e.v) - 2 * list_inner_product(q.v, e.v)) / 2), 6) + 0 AS k FROM e q, e WHERE q.vec_id % 100 = 0",
)
def kernel_gram(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    found = pairs.gram(rows.where(F.col("vec_id") % 100 == 0), rows, "vec_id", "v", V.gaussian())
    return found.select("q_vec_id", "vec_id", r6(F.col("k")).alias("k"))


@query(
    "silhouette",
    f"""WITH {E}, d AS (SELECT a.vec_id, a.label AS own, b.label, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END AS d FROM e a, e b),
    m AS (SELECT vec_id, own, label, avg(d) AS m FROM d GROUP BY ALL),
    s AS (SELECT vec_id, own, max(CASE WHEN own = label THEN m END) AS inside, min(CASE WHEN own <> label THEN m END) AS outside FROM m GROUP BY ALL)
    SELECT vec_id, own::BIGINT AS label, round((outside - inside) / greatest(inside, outside), 6) + 0 AS silhouette FROM s""",
)
def silhouette(spark, sf_dir):
    """Per row, the mean distance to its own cluster, itself included, against the nearest other cluster's."""
    found = pairs.label_distances(embeddings(spark, sf_dir), "vec_id", "v", "label").withColumn("m", F.col("total") / F.col("n"))
    own = F.col("own") == F.col("label")
    parts = found.groupBy("id", "own").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return parts.select(F.col("id").alias("vec_id"), F.col("own").alias("label"), r6((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


@query(
    "silhouette_score",
    f"""WITH {E}, d AS (SELECT a.vec_id, a.label AS own, b.label, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END AS d FROM e a, e b),
    m AS (SELECT vec_id, own, label, avg(d) AS m FROM d GROUP BY ALL),
    s AS (SELECT vec_id, max(CASE WHEN own = label THEN m END) AS a, min(CASE WHEN own <> label THEN m END) AS b FROM m GROUP BY ALL)
    SELECT round(avg((b - a) / greatest(a, b)), 6) + 0 AS silhouette FROM s""",
)
def silhouette_score(spark, sf_dir):
    """D13"""
    found = pairs.label_distances(embeddings(spark, sf_dir), "vec_id", "v", "label").withColumn("m", F.col("total") / F.col("n"))
    own = F.col("own") == F.col("label")
    parts = found.groupBy("id").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    return parts.agg(r6(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


# -- scaling and encoding


@query(
    "regression_errors",
    "WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p, l_discount AS w FROM lineitem) SELECT round(sum(w * (y - p) * (y - p)) / sum(w), 2) AS mse, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 4) AS rmse FROM t",
)
def regression_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1500.0)).alias("p"), F.col("l_discount").alias("w"))
    return P.squared_error(rows, "y", "p", "w").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))


@query(
    "weighted_errors",
    "WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p, CASE WHEN l_linenumber > 2 THEN l_discount ELSE 1 END AS w FROM lineitem) SELECT round(sum(w * (y - p) * (y - p)) / sum(w), 2) AS mse, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 4) AS rmse, round(sum(w), 2) AS weight FROM t",
)
def weighted_errors(spark, sf_dir):
    """Rows without a weight weigh 1."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1500.0)).alias("p"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("w"))
    total = rows.agg(F.round(F.sum(P.sample_weight("w")), 2).alias("weight"))
    found = P.squared_error(rows, "y", "p", "w").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"))
    return found.crossJoin(F.broadcast(total))  # one row each


@query("bounds", f"WITH {E}, x AS (SELECT i - 1 AS dim, v[i] AS x FROM e, (SELECT unnest(range(1, 65))::INTEGER AS i)) SELECT dim, round(min(x) - (max(x) - min(x)) * 0.01::DOUBLE, 6) + 0 AS low, round(max(x) + (max(x) - min(x)) * 0.01::DOUBLE, 6) + 0 AS high FROM x GROUP BY dim")
def bounds(spark, sf_dir):
    return P.bounds(embeddings(spark, sf_dir), "v").select("dim", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    "bounds_grid",
    f"""WITH {E}, x AS (SELECT i - 1 AS dim, v[i] AS x FROM e, (SELECT unnest(range(1, 65))::INTEGER AS i)),
    b AS (SELECT dim, min(x) - (max(x) - min(x)) * 0.01::DOUBLE AS low, max(x) + (max(x) - min(x)) * 0.01::DOUBLE AS high FROM x GROUP BY dim)
    SELECT dim, s::INTEGER AS step, round(low + (high - low) * s / 4, 6) + 0 AS x FROM b, range(5) t(s)""",
)
def bounds_grid(spark, sf_dir):
    return P.grid(P.bounds(embeddings(spark, sf_dir), "v"), 5).select("dim", "step", r6(F.col("x")).alias("x"))


@query("l1_normalise", "SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 6) + 0 AS share FROM part")
def l1_normalise(spark, sf_dir):
    found = P.normalise(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"], "share")
    return found.select("p_partkey", r6(F.col("share")).alias("share"))


@query("minmax_scale", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w), 6) + 0 AS scaled FROM part WINDOW w AS (PARTITION BY p_brand)")
def minmax_scale(spark, sf_dir):
    found = P.standardise(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return found.select("p_partkey", r6(F.col("scaled")).alias("scaled"))


@query(
    "log_normalise",
    "WITH m AS (SELECT event_id, event_type, value, max(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_id, round(value - m - ln(sum(exp(value - m)) OVER (PARTITION BY event_type)), 6) + 0 AS log_share FROM m",
)
def log_normalise(spark, sf_dir):
    found = P.log_normalise(table(spark, sf_dir, "events"), "value", ["event_type"], "log_share")
    return found.select("event_id", r6(F.col("log_share")).alias("log_share"))


@query("log_mask_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, CASE WHEN l_discount = 0 THEN '-inf' ELSE round(ln(l_discount), 6)::VARCHAR END AS log_discount FROM lineitem")
def log_mask_zero(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = V.log_mask_zero(F.col("l_discount"))
    shown = F.when(found == F.lit(float("-inf")), "-inf").otherwise(F.round(found, 6).cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", shown.alias("log_discount"))


@query("category_codes", "SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM part")
def category_codes(spark, sf_dir):
    return P.encode(table(spark, sf_dir, "part"), "p_type").select("p_partkey", "p_type", "code")


@query("category_decode", "SELECT p_partkey, p_brand FROM part")
def category_decode(spark, sf_dir):
    """Encoding and decoding give the column back."""
    part = table(spark, sf_dir, "part")
    coded = P.encode(part, "p_brand", 1).drop("p_brand")
    return P.decode(coded, "code", P.categories(part, "p_brand", 1), "p_brand").select("p_partkey", "p_brand")


@query("one_hot", "WITH c AS (SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1) AS code FROM part) SELECT p_partkey, i::INTEGER AS dim, (i = code)::INTEGER AS hot FROM c, range(6) t(i)")
def one_hot(spark, sf_dir):
    coded = P.encode(table(spark, sf_dir, "part"), "p_type")
    return coded.select("p_partkey", F.posexplode(P.one_hot(F.col("code"), 6)).alias("dim", "hot"))


@query("inverse_permutation", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part) SELECT place AS p_partkey, p_partkey AS place FROM r")
def inverse_permutation(spark, sf_dir):
    """Keys by price, then the place of each key."""
    part = table(spark, sf_dir, "part")
    from pyspark.sql import Window

    ranked = part.select("p_partkey", (F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey")) - 1).cast("long").alias("place"))
    return P.inverse_permutation(ranked, "p_partkey", "place")


@query("cdf", "SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) + 0 AS share FROM events")
def cdf(spark, sf_dir):
    found = P.cdf(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "value", r6(F.col("share")).alias("share"))


@query("cdf_reverse", "SELECT DISTINCT p_size, round(cume_dist() OVER (ORDER BY p_size DESC), 6) + 0 AS share FROM part")
def cdf_reverse(spark, sf_dir):
    return P.cdf(table(spark, sf_dir, "part"), "p_size", reverse=True).select("p_size", r6(F.col("share")).alias("share"))


@query(
    "error_rates",
    """WITH t AS (SELECT (event_type = 'purchase')::INTEGER AS y, value AS s FROM events), b AS (SELECT min(s) AS low, (max(s) - min(s)) / 49 AS size FROM t),
    c AS (SELECT y, least(floor((s - low) / size), 49)::INTEGER AS bin FROM t, b), k AS (SELECT unnest(range(50))::INTEGER AS k)
    SELECT round(low + size * k, 6) + 0 AS threshold, round(sum(CASE WHEN y = 1 AND bin < k THEN 1 ELSE 0 END) / sum(y), 6) + 0 AS false_rejections,
    round(1 - sum(CASE WHEN y = 0 AND bin < k THEN 1 ELSE 0 END) / sum(1 - y), 6) + 0 AS false_acceptances FROM c, k, b GROUP BY k, low, size""",
)
def error_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.col("value").alias("s"))
    return P.error_rates(rows, "y", "s").select(*(r6(F.col(c)).alias(c) for c in ("threshold", "false_rejections", "false_acceptances")))


# -- bases

SIZES = "SELECT p_partkey, p_size::DOUBLE AS x FROM part"


@query("basis_polynomial", f"WITH s AS ({SIZES}) SELECT p_partkey, i::INTEGER AS dim, round(pow(x / 10, i), 6) + 0 AS phi FROM s, range(4) t(i)")
def basis_polynomial(spark, sf_dir):
    phi = P.basis("polynomial", exponent=[1, 2, 3])(F.array(F.col("p_size") / F.lit(10.0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phi).alias("dim", "phi")).select("p_partkey", "dim", r6(F.col("phi")).alias("phi"))


@query(
    "basis_gaussian",
    f"WITH s AS ({SIZES}), c AS (SELECT * FROM (VALUES (1, 10, 5), (2, 10, 15), (3, 30, 5), (4, 30, 15)) t(dim, m, s)) SELECT p_partkey, 0 AS dim, 1::DOUBLE AS phi FROM s UNION ALL SELECT p_partkey, dim, round(exp(-(x - m) * (x - m) / (2 * s.s * s.s)), 6) + 0 FROM s p, c s",
)
def basis_gaussian(spark, sf_dir):
    phi = P.basis("gaussian", mu=[10.0, 30.0], sigma=[5.0, 15.0])(F.array(F.col("p_size").cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phi).alias("dim", "phi")).select("p_partkey", "dim", r6(F.col("phi")).alias("phi"))


@query(
    "basis_sigmoid",
    f"WITH s AS ({SIZES}), c AS (SELECT * FROM (VALUES (1, 10, 5), (2, 10, 15), (3, 30, 5), (4, 30, 15)) t(dim, m, s)) SELECT p_partkey, 0 AS dim, 1::DOUBLE AS phi FROM s UNION ALL SELECT p_partkey, dim, round(1 / (1 + exp(-(x - m) / s.s)), 6) + 0 FROM s p, c s",
)
def basis_sigmoid(spark, sf_dir):
    phi = P.basis("sigmoid", mu=[10.0, 30.0], sigma=[5.0, 15.0])(F.array(F.col("p_size").cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phi).alias("dim", "phi")).select("p_partkey", "dim", r6(F.col("phi")).alias("phi"))


@query("basis_identity", f"WITH s AS ({SIZES}) SELECT p_partkey, 0 AS dim, 1::DOUBLE AS phi FROM s UNION ALL SELECT p_partkey, 1, x FROM s")
def basis_identity(spark, sf_dir):
    phi = P.basis("none")(F.array(F.col("p_size").cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(phi).alias("dim", "phi"))


# -- splits, batches, numbers


@query("train_test_split", "WITH n AS (SELECT count(*) AS n FROM orders), c AS (SELECT ceil(n * 0.3::DOUBLE)::BIGINT AS test, n FROM n) SELECT 'test' AS fold, test AS n FROM c UNION ALL SELECT 'train', n - test FROM c")
def train_test_split(spark, sf_dir):
    return P.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey", 0.3, seed=1).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("batches", "SELECT p_partkey // 64 AS batch, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY ALL")
def batches(spark, sf_dir):
    found = P.batches(table(spark, sf_dir, "part"), "p_partkey", 64)
    return found.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


@query("sequence_bounds", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS \"end\" FROM n WINDOW w AS (ORDER BY user_id ROWS UNBOUNDED PRECEDING)")
def sequence_bounds(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return P.sequence_bounds(counts, "user_id", "n")


@query("flatten_lists", "SELECT o_custkey, o_orderkey FROM orders")
def flatten_lists(spark, sf_dir):
    """Lists of lists made flat again."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.collect_list("o_orderkey").alias("keys"))
    nested = lists.groupBy("o_custkey").agg(F.collect_list("keys").alias("lists"))
    return nested.select("o_custkey", F.explode(F.flatten("lists")).alias("o_orderkey"))


@query(
    "array_numbers",
    f"""WITH {E} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INTEGER AS argmax, (list_position(v, list_min(v)) - 1)::INTEGER AS argmin,
    round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) + 0 AS logsumexp,
    round(list_sum(list_transform(v, lambda x: least(greatest(x, -0.1::DOUBLE), 0.1::DOUBLE))), 6) + 0 AS clipped FROM e""",
)
def array_numbers(spark, sf_dir):
    """Argmax, argmin, logsumexp and clip."""
    v = F.col("v")
    return embeddings(spark, sf_dir).select("vec_id", V.argmax(v).alias("argmax"), V.argmin(v).alias("argmin"), r6(V.logsumexp(v)).alias("logsumexp"), r6(V.total(F.transform(v, lambda x: V.clip(x, -0.1, 0.1)))).alias("clipped"))


@query("largest_divisor", "SELECT p_partkey, p_size, list_max(list_filter(range(1, greatest(p_size // 2, 1) + 1), lambda d: p_size % d = 0))::INTEGER AS divisor FROM part")
def largest_divisor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", V.largest_divisor(F.col("p_size")).alias("divisor"))
