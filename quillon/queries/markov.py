"""Hidden Markov models over each user's events, in the order of time and id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.operators import hmm as H
from quillon.operators.sequences import gathered
from quillon.queries import _hmm_sql as oracle
from quillon.queries._registry import query, r6

TYPES = ["click", "error", "purchase", "signup", "view"]
INITIAL, TRANSIT = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]])
EMIT = np.array([[0.3, 0.25, 0.2, 0.15, 0.1], [0.1, 0.15, 0.2, 0.25, 0.3]])


def symbols(spark, sf_dir):
    """(user_id, obs): the codes 0 to 4 of a user's events."""
    code = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")).cast("int") - 1
    return gathered(table(spark, sf_dir, "events").withColumn("o", code), "user_id", ["ts", "event_id"], "o")


def _lse(x: str, y: str) -> str:
    return f"(greatest({x}, {y}) + ln(1 + exp(-abs(({x}) - ({y})))))"


L = {k: f"{v}::DOUBLE" for k, v in {"a00": np.log(0.7), "a01": np.log(0.3), "a10": np.log(0.2), "a11": np.log(0.8), "p0": np.log(0.6), "p1": np.log(0.4)}.items()}
SEQ = f"""seq AS (SELECT user_id, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS n, event_type AS s,
    ln(CASE event_type {' '.join(f"WHEN '{t}' THEN {EMIT[0, i]}::DOUBLE" for i, t in enumerate(TYPES))} END) AS b0,
    ln(CASE event_type {' '.join(f"WHEN '{t}' THEN {EMIT[1, i]}::DOUBLE" for i, t in enumerate(TYPES))} END) AS b1
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
FORWARD = f"""fw(user_id, t, a0, a1) AS (SELECT user_id, t, {L['p0']} + b0, {L['p1']} + b1 FROM seq WHERE t = 1
    UNION ALL SELECT s.user_id, s.t, {_lse('a0 + ' + L['a00'], 'a1 + ' + L['a10'])} + b0, {_lse('a0 + ' + L['a01'], 'a1 + ' + L['a11'])} + b1 FROM fw f JOIN seq s ON s.user_id = f.user_id AND s.t = f.t + 1)"""
BACKWARD = f"""bw(user_id, t, z0, z1) AS (SELECT user_id, t, 0::DOUBLE, 0::DOUBLE FROM seq WHERE t = n
    UNION ALL SELECT s.user_id, s.t - 1, {_lse(L['a00'] + ' + b0 + z0', L['a01'] + ' + b1 + z1')}, {_lse(L['a10'] + ' + b0 + z0', L['a11'] + ' + b1 + z1')} FROM bw b JOIN seq s ON s.user_id = b.user_id AND s.t = b.t WHERE s.t > 1)"""
BOTH = f"WITH RECURSIVE {SEQ}, {FORWARD}, {BACKWARD}, g AS (SELECT user_id, t, s, a0, a1, z0, z1, b0, b1, 1 / (1 + exp(a1 + z1 - a0 - z0)) AS g0 FROM fw JOIN bw USING (user_id, t) JOIN seq USING (user_id, t))"


def _long(df, column, names):
    rows = df.select("user_id", F.posexplode(column).alias("p", "x"))
    return rows.select("user_id", (F.col("p") + 1).cast("long").alias("t"), *(r6(F.col("x")[i]).alias(n) for i, n in enumerate(names)))


@query("hmm_forward", f"WITH RECURSIVE {SEQ}, {FORWARD} SELECT user_id, t, round(a0, 6) + 0 AS a0, round(a1, 6) + 0 AS a1 FROM fw")
def hmm_forward(spark, sf_dir):
    return _long(symbols(spark, sf_dir).select("user_id", H.forward(F.col("obs"), INITIAL, TRANSIT, EMIT).alias("x")), "x", ["a0", "a1"])


@query("hmm_backward", f"WITH RECURSIVE {SEQ}, {BACKWARD} SELECT user_id, t, round(z0, 6) + 0 AS b0, round(z1, 6) + 0 AS b1 FROM bw")
def hmm_backward(spark, sf_dir):
    return _long(symbols(spark, sf_dir).select("user_id", H.backward(F.col("obs"), TRANSIT, EMIT).alias("x")), "x", ["b0", "b1"])


@query("hmm_score", f"WITH RECURSIVE {SEQ}, {FORWARD} SELECT f.user_id, round({_lse('a0', 'a1')}, 6) + 0 AS log_likelihood FROM fw f JOIN seq s ON s.user_id = f.user_id AND s.t = f.t AND s.t = s.n")
def hmm_score(spark, sf_dir):
    return symbols(spark, sf_dir).select("user_id", r6(H.log_likelihood(F.col("obs"), INITIAL, TRANSIT, EMIT)).alias("log_likelihood"))


def _gamma(spark, sf_dir):
    rows = symbols(spark, sf_dir).select("user_id", "obs", H.forward(F.col("obs"), INITIAL, TRANSIT, EMIT).alias("a"), H.backward(F.col("obs"), TRANSIT, EMIT).alias("b"))
    return rows.select("user_id", "obs", H.posterior(F.col("a"), F.col("b")).alias("g"))


@query("hmm_posterior", f"{BOTH} SELECT user_id, t, round(g0, 6) + 0 AS g0, round(1 - g0, 6) + 0 AS g1 FROM g")
def hmm_posterior(spark, sf_dir):
    return _long(_gamma(spark, sf_dir), "g", ["g0", "g1"])


@query("hmm_map", f"{BOTH} SELECT user_id, round(sum(greatest(g0, 1 - g0)), 5) + 0 AS score, sum(CASE WHEN g0 >= 0.5::DOUBLE THEN 0 ELSE 1 END)::BIGINT AS in_state_1 FROM g GROUP BY user_id")
def hmm_map(spark, sf_dir):
    """H06"""
    found = _gamma(spark, sf_dir).select("user_id", H.map_states(F.col("g")).alias("m"))
    return found.select("user_id", (F.round("m.score", 5) + F.lit(0.0)).alias("score"), F.aggregate("m.states", F.lit(0).cast("long"), lambda s, x: s + x).alias("in_state_1"))


@query(
    "hmm_viterbi",
    f"""WITH RECURSIVE {SEQ}, vt(user_id, t, w0, w1) AS (SELECT user_id, t, {L['p0']} + b0, {L['p1']} + b1 FROM seq WHERE t = 1
    UNION ALL SELECT s.user_id, s.t, greatest(w0 + {L['a00']}, w1 + {L['a10']}) + b0, greatest(w0 + {L['a01']}, w1 + {L['a11']}) + b1 FROM vt v JOIN seq s ON s.user_id = v.user_id AND s.t = v.t + 1),
    back(user_id, t, state) AS (SELECT v.user_id, v.t, CASE WHEN w1 > w0 THEN 1 ELSE 0 END FROM vt v JOIN seq s ON s.user_id = v.user_id AND s.t = v.t AND s.t = s.n
    UNION ALL SELECT v.user_id, v.t, CASE WHEN b.state = 0 THEN CASE WHEN w1 + {L['a10']} > w0 + {L['a00']} THEN 1 ELSE 0 END ELSE CASE WHEN w1 + {L['a11']} > w0 + {L['a01']} THEN 1 ELSE 0 END END
      FROM back b JOIN vt v ON v.user_id = b.user_id AND v.t = b.t - 1)
    SELECT user_id, t, state FROM back""",
)
def hmm_viterbi(spark, sf_dir):
    found = symbols(spark, sf_dir).select("user_id", H.viterbi(F.col("obs"), INITIAL, TRANSIT, EMIT).alias("v"))
    return found.select("user_id", F.posexplode("v.states").alias("p", "state")).select("user_id", (F.col("p") + 1).cast("long").alias("t"), "state")


@query(
    "hmm_xi",
    f"""{BOTH}, p AS (SELECT a.user_id, a.a0, a.a1, b.b0, b.b1, b.z0, b.z1, {_lse('b.a0 + b.z0', 'b.a1 + b.z1')} AS n FROM g a JOIN g b ON b.user_id = a.user_id AND b.t = a.t + 1)
    SELECT round(sum(exp(a0 + {L['a00']} + b0 + z0 - n)), 4) + 0 AS x00, round(sum(exp(a0 + {L['a01']} + b1 + z1 - n)), 4) + 0 AS x01,
    round(sum(exp(a1 + {L['a10']} + b0 + z0 - n)), 4) + 0 AS x10, round(sum(exp(a1 + {L['a11']} + b1 + z1 - n)), 4) + 0 AS x11 FROM p""",
)
def hmm_xi(spark, sf_dir):
    """Expected transitions over all sequences."""
    model = H.Multinomial(2, initial=INITIAL, transit=TRANSIT, emit=EMIT)
    _, _, moves, _ = model.expect(symbols(spark, sf_dir), "obs")
    return spark.createDataFrame([tuple(round(float(x), 4) + 0.0 for x in moves.ravel())], "x00 double, x01 double, x10 double, x11 double")


@query("hmm_emission_update", f"{BOTH} SELECT s AS event_type, round(sum(g0) / (SELECT sum(g0) FROM g), 6) + 0 AS e0, round(sum(1 - g0) / (SELECT sum(1 - g0) FROM g), 6) + 0 AS e1 FROM g GROUP BY s")
def hmm_emission_update(spark, sf_dir):
    """One M-step of the emissions."""
    model = H.Multinomial(2, initial=INITIAL, transit=TRANSIT, emit=EMIT.copy())
    _, _, _, emitted = model.expect(symbols(spark, sf_dir), "obs")
    model.renew(emitted)
    return spark.createDataFrame([(t, *(round(float(x), 6) + 0.0 for x in model.emit[:, i])) for i, t in enumerate(TYPES)], "event_type string, e0 double, e1 double")


@query("hmm_mck", f"{BOTH} SELECT user_id, s AS event_type, round(sum(g0) / max(n.n), 6) + 0 AS m0, round(sum(1 - g0) / max(n.n), 6) + 0 AS m1 FROM g JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) n USING (user_id) GROUP BY user_id, s")
def hmm_mck(spark, sf_dir):
    """H12"""
    model = H.Multinomial(2, initial=INITIAL, transit=TRANSIT, emit=EMIT)
    shares = model.counts(symbols(spark, sf_dir), "user_id", "obs")
    wide = shares.groupBy("user_id", "symbol").agg(F.max(F.when(F.col("state") == 0, F.col("share"))).alias("m0"), F.max(F.when(F.col("state") == 1, F.col("share"))).alias("m1"))
    return wide.select("user_id", F.element_at(F.array(*map(F.lit, TYPES)), F.col("symbol") + 1).alias("event_type"), r6(F.col("m0")).alias("m0"), r6(F.col("m1")).alias("m1"))


def _told(spark, model):
    """The log likelihood at each step."""
    return spark.createDataFrame([(i, round(float(s), 4) + 0.0) for i, s in enumerate(model.history)], "step int, log_likelihood double")


def _begun(k, seed=1):
    """The parameters that a model of k states starts with: both sides of the comparison begin there."""
    model = H.Hmm(k, seed=seed)
    model.start(None, "obs")
    return model.initial, model.transit


def _emissions(k, m, seed=1):
    return np.random.default_rng(seed + 1).dirichlet(np.ones(m), k)


CODE = f"CASE event_type {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPES))} END AS o"
#: First chances of success, named so that the SQL can name them too.
THETA, THETA_MSS = np.array([0.35, 0.6]), 0.7


@query("hmm_fit_multinomial", oracle.symbols(CODE, *_begun(3), _emissions(3, 5), 5))
def hmm_fit_multinomial(spark, sf_dir):
    """H07, H11"""
    return _told(spark, H.Multinomial(3, seed=1).fit(symbols(spark, sf_dir), "obs", max_iter=5, tol=0.0))


@query("hmm_fit_bernoulli", oracle.symbols("(event_type = 'purchase')::INTEGER AS o", *_begun(2), _emissions(2, 2), 4))
def hmm_fit_bernoulli(spark, sf_dir):
    """Purchases or not."""
    rows = symbols(spark, sf_dir).select("user_id", F.transform("obs", lambda o: (o == 2).cast("int")).alias("obs"))
    return _told(spark, H.Bernoulli(2, seed=1).fit(rows, "obs", max_iter=4, tol=0.0))


@query("hmm_fit_binomial", oracle.binomial("least(floor(value / 10), 50)::INTEGER AS o", *_begun(2), THETA, 50, 4))
def hmm_fit_binomial(spark, sf_dir):
    """Values in tens, as counts of 50 trials."""
    rows = gathered(table(spark, sf_dir, "events").withColumn("o", F.least(F.floor(F.col("value") / 10), F.lit(50)).cast("int")), "user_id", ["ts", "event_id"], "o")
    return _told(spark, H.Binomial(2, trials=50, seed=1, theta=THETA).fit(rows, "obs", max_iter=4, tol=0.0))


@query("hmm_fit_mss", oracle.pairs("least(floor(value / 50), 10)::INTEGER AS m, 10 - least(floor(value / 50), 10)::INTEGER AS u", *_begun(2), THETA_MSS, 4))
def hmm_fit_mss(spark, sf_dir):
    """Pairs of counts from the values' digits."""
    m = F.least(F.floor(F.col("value") / 50), F.lit(10)).cast("int")
    rows = gathered(table(spark, sf_dir, "events").withColumn("o", F.array(m, F.lit(10) - m)), "user_id", ["ts", "event_id"], "o")
    return _told(spark, H.Mss(seed=1, theta=THETA_MSS).fit(rows, "obs", max_iter=4, tol=0.0))


MEANS = np.array([[4.0, 2.0], [5.5, 5.0]])


def _fit_gaussian(kind):
    @query(f"hmm_fit_gaussian_{kind}", oracle.gaussian("ln(value) AS x, value % 7 AS y", *_begun(2, 0), MEANS, kind, 3))
    def run(spark, sf_dir):
        """H15"""
        x = F.array(F.ln("value"), F.pmod(F.col("value"), F.lit(7.0)))
        rows = gathered(table(spark, sf_dir, "events").withColumn("o", x), "user_id", ["ts", "event_id"], "o")
        model = H.Gaussian(2, kind=kind, means=MEANS, covars=H.covariance_as(np.eye(2), kind, 2))
        return _told(spark, model.fit(rows, "obs", max_iter=3, tol=0.0))


for _kind in ("full", "tied", "diag", "spherical"):
    _fit_gaussian(_kind)
