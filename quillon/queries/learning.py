"""Regression, boosting, support vectors and trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.functions import vectors as V
from quillon.operators import boosting, pairs, regression, svm, tree
from quillon.queries._registry import E, embeddings, query, r6


def quantities(spark, sf_dir):
    """price and an array feature of the quantity, of every line item."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@query("ols", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) + 0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) + 0 AS slope FROM lineitem")
def ols(spark, sf_dir):
    model = regression.Linear.on("x").fit(quantities(spark, sf_dir), "y")
    return spark.createDataFrame([tuple(round(float(w), 3) + 0.0 for w in model.weights[:, 0])], "intercept double, slope double")


#: The 2 x 2 sums of line items' prices on quantities, as every closed form below needs them.
SUMS = "s AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) AS sxx, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem)"


@query(
    "ridge",
    f"WITH {SUMS}, r AS (SELECT n + 100 AS a, sx AS b, sxx + 100 AS d, sy, sxy FROM s) SELECT round((d * sy - b * sxy) / (a * d - b * b), 3) + 0 AS intercept, round((a * sxy - b * sy) / (a * d - b * b), 3) + 0 AS slope FROM r",
)
def ridge(spark, sf_dir):
    model = regression.Linear.on("x", ridge=100.0).fit(quantities(spark, sf_dir), "y")
    return spark.createDataFrame([tuple(round(float(w), 3) + 0.0 for w in model.weights[:, 0])], "intercept double, slope double")


@query("ols_predict", f"WITH {SUMS}, w AS (SELECT (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a FROM s) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b + a * l_quantity, 2) + 0 AS predicted FROM lineitem, w")
def ols_predict(spark, sf_dir):
    rows = quantities(spark, sf_dir)
    model = regression.Linear.on("x").fit(rows, "y")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.round(model.predict(), 2) + F.lit(0.0)).alias("predicted"))


@query(
    "ols_two_targets",
    "SELECT 'l_discount' AS target, round(regr_intercept(l_discount, l_quantity), 6) + 0 AS intercept, round(regr_slope(l_discount, l_quantity), 8) + 0 AS slope FROM lineitem UNION ALL SELECT 'l_tax', round(regr_intercept(l_tax, l_quantity), 6) + 0, round(regr_slope(l_tax, l_quantity), 8) + 0 FROM lineitem",
)
def ols_two_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), "l_discount", "l_tax")
    w = regression.Linear.on("x").fit(rows, ["l_discount", "l_tax"]).weights
    return spark.createDataFrame([(t, round(float(w[0, i]), 6) + 0.0, round(float(w[1, i]), 8) + 0.0) for i, t in enumerate(["l_discount", "l_tax"])], "target string, intercept double, slope double")


@query("lasso")
def lasso(spark, sf_dir):
    """L03 over the 64 components of the embeddings, predicting the label: (dim, w, z)."""
    model = regression.Lasso.on("v")
    model.lamda, model.rho = 2.0, 10.0
    model.fit(embeddings(spark, sf_dir), "label")
    return spark.createDataFrame([(i, float(w), float(z)) for i, (w, z) in enumerate(zip(model.weights[:, 0], model.sparse[:, 0], strict=True))], "dim int, w double, z double")


@query("lasso_prox", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount + l_tax / 2 > 0.05::DOUBLE THEN l_discount + l_tax / 2 - 0.05::DOUBLE WHEN l_discount + l_tax / 2 < -0.05::DOUBLE THEN l_discount + l_tax / 2 + 0.05::DOUBLE ELSE 0 END, 6) + 0 AS z FROM lineitem")
def lasso_prox(spark, sf_dir):
    found = regression.prox(F.col("l_discount"), F.col("l_tax"), 2.0, 0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(found).alias("z"))


@query(
    "bayes_predict",
    """WITH t AS (SELECT p_partkey, p_size::DOUBLE / 50 AS x, p_retailprice / 1000 AS y FROM part),
    s AS (SELECT 1 + 25 * count(*) AS a, 25 * sum(x) AS b, 1 + 25 * sum(x * x) AS d, sum(y) AS sy, sum(x * y) AS sxy FROM t),
    i AS (SELECT d / (a * d - b * b) AS s00, -b / (a * d - b * b) AS s01, a / (a * d - b * b) AS s11, sy, sxy FROM s)
    SELECT p_partkey, round(25 * (s00 * sy + s01 * sxy) + 25 * (s01 * sy + s11 * sxy) * x, 6) + 0 AS mean, round(sqrt(1.0::DOUBLE / 25 + s00 + 2 * s01 * x + s11 * x * x), 6) + 0 AS deviation FROM t, i""",
)
def bayes_predict(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size") / F.lit(50.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))
    model = regression.Bayesian.on("x").fit(rows, "y")
    return rows.select("p_partkey", r6(model.predict()).alias("mean"), r6(model.deviation()).alias("deviation"))


@query("evidence")
def evidence(spark, sf_dir):
    """(alpha, beta, log evidence) of the sizes' regression, after the approximation has settled."""
    rows = table(spark, sf_dir, "part").select(F.array(F.col("p_size") / F.lit(50.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))
    model = regression.Evidence.on("x", "polynomial", exponent=[1, 2, 3])
    m = model.sums(rows, "y")
    model.weights = model.solve(m)
    return spark.createDataFrame([(float(model.alpha), float(model.beta), float(model.log_evidence(m)))], "alpha double, beta double, log_evidence double")


#: A line's 2 x 2 sums; the posterior mean and the eigenvalues of X'X in closed form.
LINE = """s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy FROM (SELECT p_size / 50.0::DOUBLE AS x, p_retailprice / 1000.0::DOUBLE AS y FROM part)),
    v AS (SELECT *, (n + sxx) / 2 + sqrt((n - sxx) * (n - sxx) / 4 + sx * sx) AS v1, (n + sxx) / 2 - sqrt((n - sxx) * (n - sxx) / 4 + sx * sx) AS v2 FROM s)"""
POSTERIOR = """(SELECT *, beta * (d * sy - b * sxy) / (a * d - b * b) AS m0, beta * (a * sxy - b * sy) / (a * d - b * b) AS m1 FROM (SELECT *, alpha + beta * n AS a, beta * sx AS b, alpha + beta * sxx AS d FROM {})) """
ERROR = "(syy - 2 * (m0 * sy + m1 * sxy) + m0 * m0 * n + 2 * m0 * m1 * sx + m1 * m1 * sxx)"


@query(
    "evidence_line",
    f"""WITH RECURSIVE {LINE}, i AS (SELECT v.*, 0 AS step, 1::DOUBLE AS alpha, 1::DOUBLE AS beta, false AS settled FROM v UNION ALL
      SELECT n, sx, sxx, sy, sxy, syy, v1, v2, step + 1, alpha2, beta2, abs(alpha2 - alpha) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(alpha) AND abs(beta2 - beta) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(beta)
      FROM (SELECT *, gamma / (m0 * m0 + m1 * m1) AS alpha2, (n - gamma) / {ERROR} AS beta2 FROM (SELECT *, beta * v1 / (alpha + beta * v1) + beta * v2 / (alpha + beta * v2) AS gamma FROM {POSTERIOR.format('i')})) WHERE NOT settled AND step < 100),
    f AS (SELECT * FROM i ORDER BY step DESC LIMIT 1)
    SELECT round(alpha, 5) + 0 AS alpha, round(beta, 5) + 0 AS beta, round(ln(alpha) + n / 2 * ln(beta) - beta / 2 * {ERROR} - alpha / 2 * (m0 * m0 + m1 * m1) - ln(a * d - b * b) / 2 - n / 2 * ln(2 * pi()), 4) + 0 AS log_evidence FROM {POSTERIOR.format('f')}""",
)
def evidence_line(spark, sf_dir):
    """L06, L07 for a line, whose eigenvalues SQL can say."""
    rows = table(spark, sf_dir, "part").select(F.array(F.col("p_size") / F.lit(50.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))
    model = regression.Evidence.on("x")
    m = model.sums(rows, "y")
    model.weights = model.solve(m)
    return spark.createDataFrame([(round(float(model.alpha), 5), round(float(model.beta), 5), round(float(model.log_evidence(m)), 4))], "alpha double, beta double, log_evidence double")


@query(
    "lasso_line",
    """WITH RECURSIVE s AS (SELECT count(*) + 50::DOUBLE AS a, sum(x) AS b, sum(x * x) + 50 AS d, sum(y) AS sy, sum(x * y) AS sxy FROM (SELECT p_size / 50.0::DOUBLE AS x, p_retailprice / 1000.0::DOUBLE AS y FROM part)),
    i AS (SELECT 0 AS step, 0::DOUBLE AS w0, 0::DOUBLE AS w1, 1::DOUBLE AS z0, 1::DOUBLE AS z1, 1::DOUBLE AS u0, 1::DOUBLE AS u1, false AS settled UNION ALL
      SELECT step + 1, n0, n1, f0, f1, u0 + 50 * (n0 - f0), u1 + 50 * (n1 - f1), greatest(abs(f0 - z0), abs(f1 - z1)) < 1e-7::DOUBLE AND greatest(abs(n0 - f0), abs(n1 - f1)) < 1e-7::DOUBLE
      FROM (SELECT *, sign(n0 + u0 / 50) * greatest(abs(n0 + u0 / 50) - 200::DOUBLE / 50, 0) AS f0, sign(n1 + u1 / 50) * greatest(abs(n1 + u1 / 50) - 200::DOUBLE / 50, 0) AS f1
        FROM (SELECT *, (d * r0 - b * r1) / (a * d - b * b) AS n0, (a * r1 - b * r0) / (a * d - b * b) AS n1 FROM (SELECT *, sy - u0 + 50 * z0 AS r0, sxy - u1 + 50 * z1 AS r1 FROM i, s))) WHERE NOT settled AND step < 100)
    SELECT k::INTEGER AS dim, round([w0, w1][k + 1], 6) + 0 AS w, round([z0, z1][k + 1], 6) + 0 AS z FROM (SELECT * FROM i ORDER BY step DESC LIMIT 1), range(2) t(k)""",
)
def lasso_line(spark, sf_dir):
    """L03 for a line: all steps of the alternating directions."""
    rows = table(spark, sf_dir, "part").select(F.array(F.col("p_size") / F.lit(50.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))
    model = regression.Lasso.on("x")
    model.lamda, model.rho = 200.0, 50.0
    model.fit(rows, "y")
    return spark.createDataFrame([(i, round(float(w), 6) + 0.0, round(float(z), 6) + 0.0) for i, (w, z) in enumerate(zip(model.weights[:, 0], model.sparse[:, 0], strict=True))], "dim int, w double, z double")


@query("kernel_regression")
def kernel_regression(spark, sf_dir):
    """Mean prices by size, smoothed by a Gaussian kernel; the sizes are few, the parts many."""
    part = table(spark, sf_dir, "part")
    means = part.groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).select(F.array(F.col("p_size").cast("double")).alias("x"), "y")
    model = regression.KernelRegression(0.1, parameters={"sigma": 5.0}).fit(means, "x", "y")
    return model.predict(part.select("p_partkey", F.array(F.col("p_size").cast("double")).alias("x")), "p_partkey", "x")


# -- boosting


def _outputs(spark, sf_dir):
    """Three crude models of the price of a line item, and the price."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_quantity") * 1000.0).alias("h0"), F.lit(30000.0).alias("h1"), (F.col("l_discount") * 100000.0).alias("h2"), F.col("l_extendedprice").alias("y"))


def _rounds(rounds: int, before: str, step) -> str:
    """A chain of tables r0, r1, ...: weights a0, a1, a2 after each round; step(n) gives CTEs and the best model's number and step."""
    out = [before, "r0 AS (SELECT 0::DOUBLE AS a0, 0::DOUBLE AS a1, 0::DOUBLE AS a2)"]
    for n in range(1, rounds + 1):
        ctes, best, by = step(n)
        out += ctes
        out.append(f"r{n} AS (SELECT {', '.join(f'a{i} + CASE WHEN {best} = {i} THEN {by} ELSE 0 END AS a{i}' for i in range(3))} FROM r{n - 1}, x{n})")
    return f"WITH {', '.join(out)} SELECT i::INTEGER AS model, round([a0, a1, a2][i + 1], 6) + 0 AS alpha FROM r{rounds}, range(3) t(i)"


def _first(values: list[str], greatest: bool) -> str:
    top = f"{'greatest' if greatest else 'least'}({', '.join(values)})"
    return f"CASE WHEN {values[0]} = {top} THEN 0 WHEN {values[1]} = {top} THEN 1 ELSE 2 END"


def _told(spark, alpha):
    return spark.createDataFrame([(i, round(float(a), 6) + 0.0) for i, a in enumerate(alpha)], "model int, alpha double")


def _l2_step(n: int):
    left = [f"(y{i} - {' - '.join(f'a{j} * g{min(i, j)}{max(i, j)}' for j in range(3))})" for i in range(3)]
    columns = ", ".join(f"{v} AS l{i}, {v} / sqrt(g{i}{i}) AS s{i}, g{i}{i}" for i, v in enumerate(left))
    return [f"x{n} AS (SELECT {columns} FROM r{n - 1}, m)"], _first(["s0", "s1", "s2"], True), "[l0 / g00, l1 / g11, l2 / g22][" + _first(["s0", "s1", "s2"], True) + " + 1]"


L2_SUMS = f"""h AS (SELECT l_quantity * 1000 AS h0, 30000::DOUBLE AS h1, l_discount * 100000 AS h2, l_extendedprice AS y FROM lineitem),
    m AS (SELECT {', '.join(f'sum(h{i} * h{j}) AS g{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum(h{i} * y) AS y{i}' for i in range(3))} FROM h)"""


@query("l2boost", _rounds(5, L2_SUMS, _l2_step))
def l2boost(spark, sf_dir):
    """(model, alpha) after 5 rounds."""
    return _told(spark, boosting.l2_boost(_outputs(spark, sf_dir), ["h0", "h1", "h2"], "y", 5))


@query(
    "l2boost_round",
    """WITH h AS (SELECT l_quantity * 1000 AS h0, 30000::DOUBLE AS h1, l_discount * 100000 AS h2, l_extendedprice AS y FROM lineitem),
    s AS (SELECT [sum(h0 * y), sum(h1 * y), sum(h2 * y)] AS hy, [sum(h0 * h0), sum(h1 * h1), sum(h2 * h2)] AS hh FROM h),
    k AS (SELECT i - 1 AS model, hy[i] / sqrt(hh[i]) AS score, hy[i] / hh[i] AS step FROM s, (SELECT unnest([1, 2, 3]) AS i))
    SELECT model::INTEGER AS model, round(CASE WHEN score = max(score) OVER () THEN step ELSE 0 END, 6) + 0 AS alpha FROM k""",
)
def l2boost_round(spark, sf_dir):
    """The first round alone, which SQL can say."""
    alpha = boosting.l2_boost(_outputs(spark, sf_dir), ["h0", "h1", "h2"], "y", 1)
    return spark.createDataFrame([(i, round(float(a), 6) + 0.0) for i, a in enumerate(alpha)], "model int, alpha double")


@query("boosted_sum", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5::DOUBLE * l_quantity + 2 * l_discount - l_tax, 6) + 0 AS score FROM lineitem")
def boosted_sum(spark, sf_dir):
    """B01"""
    score = boosting.combined(["l_quantity", "l_discount", "l_tax"], np.array([0.5, 2.0, -1.0]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(score).alias("score"))


def _votes(spark, sf_dir):
    """Three weak rules on whether a line item is returned (flag R), as -1 and 1."""
    rows = table(spark, sf_dir, "lineitem")
    sign = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    return rows.select(sign(F.col("l_quantity") > 25).alias("h0"), sign(F.col("l_discount") > 0.05).alias("h1"), sign(F.col("l_tax") <= 0.03).alias("h2"), sign(F.col("l_returnflag") == "R").alias("y"))


VOTES = """c AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS h0, CASE WHEN l_discount > 0.05::DOUBLE THEN 1 ELSE -1 END AS h1, CASE WHEN l_tax <= 0.03::DOUBLE THEN 1 ELSE -1 END AS h2,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS y, count(*) AS n FROM lineitem GROUP BY ALL)"""


def _ada_step(n: int):
    sums = f"x{n} AS (SELECT {', '.join(f'sum(w) FILTER (h{i} <> y) / sum(w) AS e{i}' for i in range(3))} FROM (SELECT c.*, n * exp(-y * (a0 * h0 + a1 * h1 + a2 * h2)) AS w FROM c, r{n - 1}))"
    return [sums], _first(["e0", "e1", "e2"], False), "CASE WHEN least(e0, e1, e2) >= 0.5::DOUBLE THEN 0 ELSE 0.5::DOUBLE * ln((1 - least(e0, e1, e2)) / least(e0, e1, e2)) END"


def _logit_step(n: int):
    score = "1 / (1 + exp(-2 * (a0 * h0 + a1 * h1 + a2 * h2)))"
    ctes = [
        f"w{n} AS (SELECT *, greatest(-4, least(4, ((y + 1) / 2 - p) * n / w)) AS z FROM (SELECT *, greatest(p * (1 - p), 1e-10::DOUBLE) * n AS w FROM (SELECT c.*, {score} AS p FROM c, r{n - 1})))",
        f"f{n} AS (SELECT {', '.join(f'sum(w * z * h{i}) / sum(w * h{i} * h{i}) AS f{i}' for i in range(3))} FROM w{n})",
        f"x{n} AS (SELECT {', '.join(f'sum(w * (z - h{i} * f{i}) * (z - h{i} * f{i})) AS s{i}, any_value(f{i}) AS f{i}' for i in range(3))} FROM w{n}, f{n})",
    ]
    return ctes, _first(["s0", "s1", "s2"], False), "[f0, f1, f2][" + _first(["s0", "s1", "s2"], False) + " + 1] / 2"


@query("adaboost", _rounds(10, VOTES, _ada_step))
def adaboost(spark, sf_dir):
    """B03"""
    return _told(spark, boosting.ada_boost(_votes(spark, sf_dir), ["h0", "h1", "h2"], "y"))


@query("logitboost", _rounds(10, VOTES, _logit_step))
def logitboost(spark, sf_dir):
    """B04"""
    return _told(spark, boosting.logit_boost(_votes(spark, sf_dir), ["h0", "h1", "h2"], "y"))


# -- support vectors


@query("svm_labels", "SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE -1 END AS t FROM embeddings")
def svm_labels(spark, sf_dir):
    """Two classes as signs."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(-1).alias("t"))


@query(
    "svm_decision",
    f"""WITH {E}, d AS (SELECT e.vec_id, sum((CASE WHEN q.label >= 5 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) * exp(-(list_inner_product(q.v, q.v) + list_inner_product(e.v, e.v) - 2 * list_inner_product(q.v, e.v)) / 2)) + 0.1::DOUBLE AS d
    FROM e q, e WHERE q.vec_id % 100 = 0 GROUP BY e.vec_id) SELECT vec_id, round(d, 6) + 0 AS decision, CASE WHEN d > 0 THEN 1 ELSE -1 END AS predicted FROM d""",
)
def svm_decision(spark, sf_dir):
    """The decision function of given support vectors, those whose id is divisible by 100."""
    rows = embeddings(spark, sf_dir)
    sv = rows.where(F.col("vec_id") % 100 == 0)
    k = V.gaussian()
    parts = pairs.against_all(sv, rows).select("vec_id", (F.when(F.col("q_label") >= 5, F.lit(0.5)).otherwise(F.lit(-0.5)) * k(F.col("q_v"), F.col("v"))).alias("part"))
    d = F.sum("part") + F.lit(0.1)
    return parts.groupBy("vec_id").agg(d.alias("d")).select("vec_id", r6(F.col("d")).alias("decision"), F.when(F.col("d") > 0, 1).otherwise(-1).alias("predicted"))


@query("svm_fit")
def svm_fit(spark, sf_dir):
    """One problem for each of the ten labels, fitted side by side, and the labels they give."""
    rows = embeddings(spark, sf_dir)
    model = svm.Svm(parameters={"sigma": 1.0}, c=10.0, sweeps=5).fit(rows, "vec_id", "v", "label")
    return model.predict(rows, "vec_id", "v")


# -- trees


@query(
    "impurities",
    """WITH c AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL), p AS (SELECT p_brand, c / sum(c) OVER (PARTITION BY p_brand) AS p FROM c)
    SELECT p_brand, round(1 - sum(p * p), 6) + 0 AS gini, round(sum(-p * log2(p)), 6) + 0 AS entropy FROM p GROUP BY p_brand""",
)
def impurities(spark, sf_dir):
    """T02"""
    part = table(spark, sf_dir, "part")
    kinds = sorted(r[0] for r in part.select("p_type").distinct().collect())
    counts = part.groupBy("p_brand").agg(*(F.sum((F.col("p_type") == k).cast("long")).alias(f"c{i}") for i, k in enumerate(kinds)))
    cs = [F.col(f"c{i}") for i in range(len(kinds))]
    return counts.select("p_brand", r6(tree.impurity(cs)).alias("gini"), r6(tree.impurity(cs, "entropy")).alias("entropy"))


SPLIT = """WITH n AS (SELECT brand_no, p_size::DOUBLE AS p_size, p_retailprice, p_type FROM (SELECT *, 1 AS brand_no FROM part)),
    l AS (SELECT 0 AS feature, p_size AS v, p_type AS t FROM n UNION ALL SELECT 1, p_retailprice, p_type FROM n),
    c AS (SELECT feature, v, t, count(*) AS c FROM l GROUP BY ALL), ts AS (SELECT DISTINCT p_type AS t FROM part), vs AS (SELECT DISTINCT feature, v FROM l),
    g AS (SELECT vs.feature, vs.v, ts.t, coalesce(c.c, 0) AS c FROM vs CROSS JOIN ts LEFT JOIN c ON c.feature = vs.feature AND c.v = vs.v AND c.t = ts.t),
    u AS (SELECT feature, v, t, sum(c) OVER (PARTITION BY feature, t ORDER BY v) AS l, sum(c) OVER (PARTITION BY feature, t) AS a FROM g),
    s AS (SELECT feature, v, sum(l) AS nl, sum(a) AS n, sum(l * l) AS sl, sum((a - l) * (a - l)) AS sr, sum(a * a) AS sa FROM u GROUP BY ALL),
    k AS (SELECT feature, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS threshold, n,
      round((1 - sa / (n * n)) - (nl * (1 - sl / (nl * nl)) + (n - nl) * CASE WHEN n = nl THEN 0 ELSE 1 - sr / ((n - nl) * (n - nl)) END) / n, 12) AS gain FROM s)
    SELECT feature, threshold, round(gain, 9) + 0 AS gain, n::BIGINT AS n FROM k WHERE threshold IS NOT NULL AND gain > 0 ORDER BY k.gain DESC, feature, threshold LIMIT 1"""


@query("tree_best_split", SPLIT)
def tree_best_split(spark, sf_dir):
    """The root's best split of the part types by size and price."""
    part = table(spark, sf_dir, "part").withColumn("node", F.lit(1))
    kinds = sorted(r[0] for r in part.select("p_type").distinct().collect())
    found = tree.best_splits(part, "node", ["p_size", "p_retailprice"], "p_type", kinds)
    return found.select("feature", "threshold", (F.round("gain", 9) + F.lit(0.0)).alias("gain"), "n")


def _tree_sql(depth: int) -> str:
    """CTEs n0, b0, n1, ...: the rows' nodes at each level and the best splits of the nodes that are new there."""
    out = [E, "x AS (SELECT vec_id, label, f, v[f + 1] AS value FROM e, (SELECT unnest(range(64))::INTEGER AS f))", "k AS (SELECT DISTINCT label FROM e)", "n0 AS (SELECT vec_id, label, 1::BIGINT AS node FROM e)"]
    for i in range(depth):
        out.append(f"l{i} AS (SELECT node, f, value, x.label, count(*) AS c FROM n{i} JOIN x USING (vec_id) WHERE node >= {1 << i} GROUP BY ALL)")
        out.append(f"g{i} AS (SELECT s.node, s.f, s.value, k.label, coalesce(l{i}.c, 0) AS c FROM (SELECT DISTINCT node, f, value FROM l{i}) s CROSS JOIN k LEFT JOIN l{i} ON l{i}.node = s.node AND l{i}.f = s.f AND l{i}.value = s.value AND l{i}.label = k.label)")
        out.append(f"u{i} AS (SELECT node, f, value, sum(c) OVER (PARTITION BY node, f, label ORDER BY value) AS l, sum(c) OVER (PARTITION BY node, f, label) AS a FROM g{i})")
        out.append(f"s{i} AS (SELECT node, f, value, sum(l) AS nl, sum(a) AS n, sum(l * l) AS sl, sum((a - l) * (a - l)) AS sr, sum(a * a) AS sa FROM u{i} GROUP BY ALL)")
        gain = "round((1 - sa / (n * n)) - (nl * (1 - sl / (nl * nl)) + (n - nl) * CASE WHEN n = nl THEN 0 ELSE 1 - sr / ((n - nl) * (n - nl)) END) / n, 12)"
        out.append(f"h{i} AS (SELECT node, f, (value + lead(value) OVER (PARTITION BY node, f ORDER BY value)) / 2 AS threshold, n, {gain} AS gain FROM s{i})")
        out.append(f"b{i} AS (SELECT * FROM h{i} WHERE threshold IS NOT NULL AND gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold) = 1)")
        out.append(f"n{i + 1} AS (SELECT n.vec_id, n.label, CASE WHEN b.node IS NULL THEN n.node ELSE 2 * n.node + (x.value > b.threshold)::BIGINT END AS node FROM n{i} n LEFT JOIN b{i} b ON b.node = n.node LEFT JOIN x ON x.vec_id = n.vec_id AND x.f = b.f)")
    return "WITH " + ", ".join(out)


def _grown(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select("vec_id", "label", *(F.col("v")[i].alias(f"x{i}") for i in range(64)))
    return rows, tree.Tree([f"x{i}" for i in range(64)], "label", max_depth=4).fit(rows)


@query(
    "tree_predict",
    _tree_sql(4) + ", m AS (SELECT node, label AS predicted FROM (SELECT node, label, count(*) AS c FROM n4 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY c DESC, label) = 1) SELECT vec_id, label, predicted FROM n4 JOIN m USING (node)",
)
def tree_predict(spark, sf_dir):
    """Labels of the embeddings from all components by a tree of depth 4."""
    rows, model = _grown(spark, sf_dir)
    return rows.select("vec_id", "label", model.predict().alias("predicted"))


@query(
    "tree_importances",
    _tree_sql(4) + f", b AS ({' UNION ALL '.join(f'SELECT f, gain * n AS w FROM b{i}' for i in range(4))}) SELECT feature::INTEGER AS feature, round(coalesce((SELECT sum(w) FROM b WHERE f = feature), 0) / (SELECT sum(w) FROM b), 6) + 0 AS importance FROM range(64) t(feature)",
)
def tree_importances(spark, sf_dir):
    """T06"""
    _, model = _grown(spark, sf_dir)
    return spark.createDataFrame([(i, round(float(x), 6) + 0.0) for i, x in enumerate(model.importances())], "feature int, importance double")
