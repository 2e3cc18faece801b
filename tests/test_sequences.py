import functools
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import alignment, folding, hmm, scode
from quillon.operators import strings as S
from quillon.operators.sequences import runs
from quillon.queries import QUERIES

# -- hidden Markov models

PI, A = np.array([0.5, 0.3, 0.2]), np.array([[0.6, 0.3, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]])
B = np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6], [0.3, 0.3, 0.4]])


def paths(obs):
    for states in itertools.product(range(3), repeat=len(obs)):
        p = PI[states[0]] * B[states[0], obs[0]]
        for a, b, o in zip(states, states[1:], obs[1:], strict=False):
            p *= A[a, b] * B[b, o]
        yield p, states


def test_recurrences_against_all_paths(spark):
    sequences = [[0, 2, 1, 2], [1], [2, 2, 0, 1, 0]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)] + [(9, [])], "id int, obs array<int>")
    o = F.col("obs")
    told = {r.id: r for r in df.select("id", hmm.log_likelihood(o, PI, A, B).alias("l"), hmm.viterbi(o, PI, A, B).alias("v"), hmm.posterior(hmm.forward(o, PI, A, B), hmm.backward(o, A, B)).alias("g")).collect()}
    model = hmm.Multinomial(3, initial=PI, transit=A, emit=B)
    decoded = {r.id: r for r in model.decode(df, "id", "obs").collect()}
    assert told[9].l is None and told[9].v is None and told[9].g == [] and decoded[9].states is None
    for i, s in enumerate(sequences):
        every = list(paths(s))
        total = sum(p for p, _ in every)
        best = max(every, key=lambda x: x[0])
        gamma = [[sum(p for p, q in every if q[t] == k) / total for k in range(3)] for t in range(len(s))]
        assert np.isclose(told[i].l, np.log(total)) and np.isclose(decoded[i].log_likelihood, np.log(total))
        assert list(told[i].v.states) == list(decoded[i].states) == list(best[1])
        assert np.isclose(told[i].v.log_probability, np.log(best[0])) and np.allclose(told[i].g, gamma) and np.allclose(decoded[i].gamma, gamma)


def grouped(spark, values, n=20):
    return spark.createDataFrame([(i // n, i, v) for i, v in enumerate(values)], "s int, p int, o " + ("array<double>" if isinstance(values[0], list) else "int")).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "o"))), lambda x: x["o"]).alias("obs"))


@pytest.mark.parametrize(
    ("made", "fresh"),
    [
        (hmm.Multinomial(2, initial=np.array([1.0, 0]), transit=np.array([[0.9, 0.1], [0.1, 0.9]]), emit=np.array([[0.9, 0.05, 0.05], [0.05, 0.05, 0.9]])), hmm.Multinomial(2, seed=3)),
        (hmm.Bernoulli(2, initial=np.array([1.0, 0]), transit=np.array([[0.9, 0.1], [0.1, 0.9]]), emit=np.array([[0.9, 0.1], [0.1, 0.9]])), hmm.Bernoulli(2, seed=3)),
        (hmm.Binomial(2, trials=10, initial=np.array([1.0, 0]), transit=np.array([[0.9, 0.1], [0.1, 0.9]]), theta=np.array([0.2, 0.8])), hmm.Binomial(2, trials=10, seed=3)),
    ],
)
def test_fits_climb_and_recover_states(spark, made, fresh):
    obs, states = made.sample(400, 1)
    df = grouped(spark, [int(o) for o in obs])
    fresh.fit(df, "obs", max_iter=15, tol=0)
    assert all(b >= a - 1e-6 for a, b in zip(fresh.history, fresh.history[1:], strict=False))
    told = [s for r in fresh.decode(df, "s", "obs").orderBy("s").collect() for s in r.states]
    hit = np.mean(np.array(told) == np.array(states))
    assert max(hit, 1 - hit) > 0.75
    again = type(fresh)(**({"trials": 10} if isinstance(fresh, hmm.Binomial) else {})).__class__(2).load_json(fresh.to_json())
    assert np.allclose(again.transit, fresh.transit)


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_gaussian_emissions(spark, kind):
    label = np.random.default_rng(2).integers(0, 2, 300)
    points = np.random.default_rng(3).normal(0, 0.5, (300, 2)) + label[:, None] * np.array([[4.0, -3.0]])
    df = grouped(spark, points.tolist())
    model = hmm.Gaussian(2, kind=kind, seed=1).fit(df, "obs", max_iter=25, tol=1e-3)  # starts from the covariance of all rows
    told = [s for r in model.decode(df, "s", "obs", "map").orderBy("s").collect() for s in r.states]
    hit = np.mean(np.array(told) == label)
    assert max(hit, 1 - hit) > 0.9 and model.history[-1] >= model.history[0]
    assert len(model.sample(5)[0]) == 5


def test_mss_and_checks(spark):
    made = hmm.Mss(initial=np.array([1.0, 0]), transit=np.array([[0.9, 0.1], [0.1, 0.9]]), theta=0.8)
    obs, _ = made.sample(200, 4)
    df = spark.createDataFrame([(0, obs)], "s int, obs array<array<int>>")
    model = hmm.Mss(seed=2).fit(df, "obs", max_iter=10)
    assert abs(max(model.theta, 1 - model.theta) - 0.8) < 0.06
    with pytest.raises(ValueError):
        hmm.Multinomial(2, initial=np.array([0.5, 0.6]), transit=np.eye(2)).check()
    with pytest.raises(KeyError):
        made.decode(df, "s", "obs", "guess")


# -- strings


def test_golden_arrays():
    assert S.suffix_array("abaabababbabbb").tolist() == [14, 2, 0, 3, 5, 7, 10, 13, 1, 4, 6, 9, 12, 8, 11]
    assert S.lcp_array("banana", S.suffix_array("banana")).tolist() == [0, 1, 3, 0, 0, 2, -1]
    t = "abaabababbabbb"
    sa = S.suffix_array(t)
    by_rank = S.longest_previous(t, sa, S.lcp_array(t, sa))[sa[1:]].tolist()
    assert by_rank == [1, 0, 3, 4, 2, 3, 1, 0, 2, 3, 4, 2, 1, 2]


words = st.text("abc", max_size=30)


@settings(max_examples=150, deadline=None)
@given(words)
def test_long_forms_against_brute_force(t):
    sa = S.suffix_array(t)
    marked = t + "$"
    assert sa.tolist() == sorted(range(len(marked)), key=lambda i: marked[i:])
    common = S.lcp_array(t, sa)
    prefix = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert common.tolist() == [prefix(marked[a:], marked[b:]) for a, b in zip(sa, sa[1:], strict=False)] + [-1]
    assert S.longest_previous(t, sa, common).tolist() == [max((prefix(t[i:], t[j:]) for j in range(i)), default=0) for i in range(len(t))]
    assert S.z_of(t) == [0 if i == 0 else prefix(t, t[i:]) for i in range(len(t))]
    assert S.failure(t) == [max((k for k in range(i + 1) if t[:k] == t[i + 1 - k : i + 1]), default=0) for i in range(len(t))]
    assert S.inverse_bwt("".join(marked[i - 1] for i in sa)) == t
    for q in ("a", "ab", "cab", t[1:4]):
        if q:
            assert sorted(S.find(sa, t, q)) == [i for i in range(len(t)) if t.startswith(q, i)]


def test_long_text_round_trip():
    rng = np.random.RandomState(1)
    t = "".join(chr(97 + c) for c in rng.randint(0, 26, 100_000))
    sa = S.suffix_array(t)
    marked = t + "$"
    assert S.inverse_bwt("".join(marked[i - 1] for i in sa)) == t


def test_columns_against_long_forms(spark):
    rng = random.Random(1)
    texts = ["", "a", "aaaa", "banana", None] + ["".join(rng.choice("abé") for _ in range(rng.randrange(20))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    sa = {}
    for r in S.lcp(S.suffixes(df, "id", "t"), "id").collect():
        sa.setdefault(r.id, {})[r.rank] = (r.sa, r.lcp)
    lpf = {}
    for r in S.lpf(df, "id", "t").collect():
        lpf.setdefault(r.id, {})[r.sa] = r.lpf
    t_ = F.coalesce("t", F.lit(""))
    one = {r.id: r for r in df.select("id", S.z_array(t_).alias("z"), S.factors(t_).alias("f"), S.run_length(t_).alias("c"), S.run_length_decoded(S.run_length(t_)).alias("d"), S.kmers(t_, 3).alias("k")).collect()}
    best = {r.id: r for r in S.best_tandem(df, "id", "t").collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = S.suffix_array(t)
        assert [sa[i][k][0] for k in range(len(t) + 1)] == want.tolist()
        common = S.lcp_array(t, want)
        assert [sa[i][k][1] for k in range(len(t) + 1)] == common.tolist()
        assert [lpf.get(i, {})[k] for k in range(len(t))] == S.longest_previous(t, want, common).tolist()
        assert one[i].z == S.z_of(t) and "".join(one[i].f) == t and one[i].d == t and one[i].k == [t[j : j + 3] for j in range(len(t) - 2)]
        scores = [len(u) * n for p in range(1, len(t) // 2 + 1) for j in range(len(t)) for n in range(2, len(t) // p + 1) for u in [t[j : j + p]] if len(u) == p and t.startswith(u * n, j)]
        assert best[i].score == max(scores, default=0) and best[i].unit * (best[i].score // max(1, len(best[i].unit))) in t
    index = {r.id: r for r in S.text_index(df, "id", "t").collect()}
    assert all(index[i].sa == S.suffix_array(t or "").tolist() and S.inverse_bwt(index[i].bwt) == (t or "") for i, t in enumerate(texts))


@pytest.mark.parametrize("least", [1, 2, 5, 10])
def test_segment_sums(spark, least):
    rng = np.random.RandomState(123)
    values = rng.uniform(-10, 10, 40).tolist()

    @functools.cache
    def best(i):
        if i <= 0:
            return 0.0
        return max([best(i - 1)] + [best(max(0, j)) + sum(values[j:i]) for j in range(i - least, -1, -1)])

    df = spark.createDataFrame([(values,)], "r array<double>")
    assert np.isclose(df.select(S.segment_sum(F.col("r"), least)).first()[0], best(40))


def test_runs_reach_the_end(spark):
    df = spark.createDataFrame([(0, i, bool(int(c))) for i, c in enumerate("1101110011")], "s int, p int, f boolean")
    assert sorted((r.start, r.length) for r in runs(df, "s", "p", "f").collect()) == [(0, 2), (3, 3), (8, 2)]


# -- alignment


def brute_align(x, y, m, local=False):
    """The best score over all alignments by recursion over (i, j, state)."""

    @functools.cache
    def best(i, j, state):
        if i == j == 0 and not local:
            return 0.0 if state == 0 else -np.inf
        if state == 0:
            if not (i and j):
                return -np.inf
            s = m.match if x[i - 1] == y[j - 1] else m.mismatch
            return s + max([best(i - 1, j - 1, k) for k in range(3)] + ([0.0] if local else []))
        a, b = (i - 1, j) if state == 1 else (i, j - 1)
        if a < 0 or b < 0:
            return -np.inf
        start = best(a, b, 0) if (a or b) or not local else -np.inf
        return max(start - m.gap_open, best(a, b, state) - m.gap_extend)

    if local:
        return max([0.0] + [best(i, j, 0) for i in range(len(x) + 1) for j in range(len(y) + 1)])
    return max(best(len(x), len(y), k) for k in range(3))


dna = st.text("ATGC", max_size=9)


@settings(max_examples=120, deadline=None)
@given(dna, dna)
def test_aligners_against_recursion(x, y):
    for m in (alignment.Gotoh(), alignment.Gotoh(2, -3, 2.5, 0.5), alignment.Gotoh(1, -1, 1, 1)):
        score, xs, ys = m.align(x, y)
        assert np.isclose(score, brute_align(x, y, m))
        back = alignment.Gotoh(m.match, m.mismatch, m.gap_open, m.gap_extend, backward=True).align(x, y)
        assert np.isclose(back[0], score)
        for a, b in ((xs, ys), back[1:]):
            assert alignment.rendered(x, a).replace("-", "") == x and alignment.rendered(y, b).replace("-", "") == y
            assert np.isclose(score, rescored(x, y, a, b, m))
        local = alignment.Gotoh(m.match, m.mismatch, m.gap_open, m.gap_extend, local=True)
        s, a, b = local.align(x, y)
        assert np.isclose(s, brute_align(x, y, m, True)) and np.isclose(s, rescored(x, y, a, b, m))


def rescored(x, y, xs, ys, m):
    total, last = 0.0, 0
    for i, j in zip(xs, ys, strict=True):
        state = 0 if i >= 0 and j >= 0 else 1 if j < 0 else 2
        total += (m.match if x[i] == y[j] else m.mismatch) if state == 0 else -(m.gap_extend if state == last else m.gap_open)
        last = state
    return total


@settings(max_examples=60, deadline=None)
@given(dna, dna)
def test_pair_hmm_probabilities(x, y):
    model = alignment.PairHmm()
    total, _ = model.forward(x, y)
    assert np.isclose(total, model.backward(x, y)[0]) and model.score(x, y) <= total + 1e-9
    if x and y:
        assert (np.exp(model.posterior(x, y)).sum(1) <= 1 + 1e-9).all()
    again = alignment.load(alignment.PairHmm, alignment.dump(model))
    assert again.score(x, y) == model.score(x, y)


# -- folding


def all_structures(s, can):
    def grow(i, j):
        if i >= j:
            yield ()
            return
        yield from grow(i + 1, j)
        for k in range(i + 1, j):
            if can[i, k]:
                for a in grow(i + 1, k):
                    for b in grow(k + 1, j):
                        yield ((i, k), *a, *b)

    return list(grow(0, len(s)))


@pytest.mark.parametrize("seed", range(6))
def test_nussinov_against_all_structures(seed):
    rng = random.Random(seed)
    s = "".join(rng.choice("AUGC") for _ in range(13))
    model = folding.Nussinov(min_span=2)
    every = all_structures(s, model.can(s))
    score, brackets = model.fold(s)
    assert score == max(map(len, every)) == brackets.count("(") == brackets.count(")")
    z = model.constrained(s)
    for i, j in itertools.combinations(range(len(s)), 2):
        assert z[i, j] == max((len(q) for q in every if (i, j) in q), default=-1)


@pytest.mark.parametrize("seed", range(4))
def test_zuker_structures_have_their_energy(seed):
    rng = random.Random(seed)
    s = "".join(rng.choice("AUGC") for _ in range(60))
    model = folding.Zuker()
    energy, brackets = model.fold(s)
    pairs, stack = [], []
    for i, c in enumerate(brackets):
        if c == "(":
            stack.append(i)
        elif c == ")":
            pairs.append((stack.pop(), i))
    kind, inside = folding.kinds(s), dict(pairs)
    assert not stack and all(kind[i, j] >= 0 for i, j in pairs)

    def closed(i, j):
        children, k = [], i + 1
        while k < j:
            if k in inside:
                children.append((k, inside[k]))
                k = inside[k]
            k += 1
        if not children:
            return folding.HAIRPIN[j - i - 2]
        if len(children) == 1:
            return model._loop(kind, i, j, *children[0]) + closed(*children[0])
        unpaired = j - i - 1 - sum(b - a + 1 for a, b in children)
        return folding.MULTI + folding.BRANCH + folding.UNPAIRED * unpaired + sum(folding.BRANCH + closed(a, b) for a, b in children)

    outer = [p for p in pairs if not any(a < p[0] and p[1] < b for a, b in pairs)]
    assert np.isclose(sum(closed(*p) for p in outer), energy) and energy <= 0
    assert model.fold("") == (0.0, "") and model.fold("A") == (0.0, ".")


def test_scode_recovers_a_line(spark):
    rng = np.random.default_rng(8)
    t = rng.random(400)
    x = np.stack([np.exp(-2 * t), 2 * np.exp(-2 * t) + 1], 1)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(t, x, strict=True)], "t double, x array<double>")
    model = scode.Scode(dimension=2, max_iter=300, low=-4, high=1, seed=1).fit(df, "t", "x")
    assert model.history == sorted(model.history, reverse=True) and np.abs(model.predict(t) - x).max() < 0.1
    assert model.strongest(spark, 1).count() == 1


def test_gaussian_mixture_emissions(spark):
    rng = np.random.default_rng(9)
    label = np.repeat([0, 1, 0, 1], 60)
    side = rng.integers(0, 2, 240)
    points = rng.normal(0, 0.4, (240, 1)) + np.where(label == 0, np.where(side, 0.0, 2.0), np.where(side, 8.0, 10.0))[:, None]
    df = grouped(spark, points.tolist(), 240)
    model = hmm.GaussianMixture(2, seed=3).fit(df, "obs", max_iter=20)
    told = np.array(model.decode(df, "s", "obs").first().states)
    assert max((told == label).mean(), (told != label).mean()) > 0.9 and model.history[-1] > model.history[0]
    assert len(model.sample(4)[0]) == 4


def test_failure_array(spark):
    texts = ["", "a", "aaaa", "abab", "abcabcd", "aabaaab", "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.f for r in df.select("t", S.failure_array(F.col("t")).alias("f")).collect()} == {t: S.failure(t) for t in texts}


def test_suffixes_are_never_broadcast(spark):
    df = spark.range(3).selectExpr("id", "repeat('reading all the rest ', 3) AS t")
    ranked = S.suffixes(df, "id", "t")
    asked = spark.createDataFrame([("re",), ("l",)], "q string")
    plan = lambda found: found._jdf.queryExecution().sparkPlan().toString()
    assert "Inner, BuildRight" in plan(S.occurrences_of(ranked, asked, "id", "q"))
    assert "Join" not in plan(S.last_to_first(S.occurrences(S.bwt(ranked, "id"), "id")))


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_gaussian_components_that_are_not_observed(spark, kind):
    rng = np.random.default_rng(4)
    rows = [[[float(v) for v in rng.normal(4 * (t % 2), 1, 2)] for t in range(6)] for _ in range(30)]
    for i in range(0, 30, 3):
        rows[i][1][0] = None
        rows[i][4] = [None, None] if i % 2 else None
    df = spark.createDataFrame([(r,) for r in rows], "obs array<array<double>>")
    means = np.array([[0.0, 0.5], [3.0, 3.5]])
    cov = np.array([[1.0, 0.4], [0.4, 2.0]])
    start = hmm.Gaussian(2, kind=kind, means=means, covars=hmm.covariance_as(cov, kind, 2))
    start.start(None, "obs")
    one = spark.createDataFrame([([[None, 2.0]],), ([[None, None]],)], "obs array<array<double>>")
    var = cov[1, 1] if kind != "spherical" else 1.5
    density = start.initial @ (np.exp(-((2.0 - means[:, 1]) ** 2) / 2 / var) / np.sqrt(2 * np.pi * var))
    assert np.isclose(start.score(one, "obs"), np.log(density))
    model = hmm.Gaussian(2, kind=kind, cov_prior=1e-9, means=means, covars=hmm.covariance_as(cov, kind, 2)).fit(df, "obs", max_iter=8, tol=0.0)
    assert (np.diff(model.history) > -1e-6).all() and np.isfinite(model.history).all()  # no step of EM lowers it
    assert model.decode(df.withColumn("id", F.monotonically_increasing_id()), "id", "obs").where("size(states) = 6").count() == 30


def test_gaussian_fits_with_values_of_zero(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value"))).write.parquet(f"{tmp_path}/events.parquet")
    for kind in ("full", "tied", "diag", "spherical"):
        steps = QUERIES[f"hmm_fit_gaussian_{kind}"](spark, str(tmp_path)).collect()
        assert len(steps) == 3 and all(np.isfinite(r["log_likelihood"]) for r in steps)
