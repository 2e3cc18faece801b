"""SQL for Baum-Welch: a pass over all sequences and the new parameters, written out for each step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A user's events in the order of time and id.
SEQ = "seq AS (SELECT user_id, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS n, {obs} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def number(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def total(terms: list[str]) -> str:
    """The logarithm of the sum of exponentials."""
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def history(obs: str, initial: np.ndarray, transit: np.ndarray, start: dict[str, float], emission: Callable[[int], str], update: dict[str, str], steps: int) -> str:
    """(step, log_likelihood) of so many steps; emission(k) is ln b_k of columns obs and parameters, update their new values.

    update speaks of g0, g1, ... (a place's posterior), obs and the parameters before, in sums over all places.
    """
    k = len(initial)
    states = range(k)
    first = {f"i{s}": initial[s] for s in states} | {f"a{r}{s}": transit[r, s] for r in states for s in states} | start
    ctes = [SEQ.format(obs=obs), f"p0 AS (SELECT {', '.join(f'{number(v)} AS {c}' for c, v in first.items())})"]
    for n in range(1, steps + 1):
        p, s, f, b = f"p{n - 1}", f"s{n}", f"f{n}", f"w{n}"
        ctes.append(f"{s} AS MATERIALIZED (SELECT seq.*, {', '.join(f'{emission(c)} AS b{c}' for c in states)} FROM seq, {p})")
        alphas, betas = [f"u{c}" for c in states], [f"z{c}" for c in states]
        forward = [f"{total([f'u{r} + ln(a{r}{c})' for r in states])} + b{c}" for c in states]
        ctes.append(f"""{f}(user_id, t, {', '.join(alphas)}) AS (SELECT user_id, t, {', '.join(f'ln(i{c}) + b{c}' for c in states)} FROM {s}, {p} WHERE t = 1
            UNION ALL SELECT {s}.user_id, {s}.t, {', '.join(forward)} FROM {f} JOIN {s} ON {s}.user_id = {f}.user_id AND {s}.t = {f}.t + 1, {p})""")
        backward = [total([f"ln(a{r}{c}) + b{c} + z{c}" for c in states]) for r in states]
        ctes.append(f"""{b}(user_id, t, {', '.join(betas)}) AS (SELECT user_id, t, {', '.join('0::DOUBLE' for _ in states)} FROM {s} WHERE t = n
            UNION ALL SELECT {s}.user_id, {s}.t - 1, {', '.join(backward)} FROM {b} JOIN {s} ON {s}.user_id = {b}.user_id AND {s}.t = {b}.t, {p} WHERE {s}.t > 1)""")
        ctes.append(f"l{n} AS (SELECT user_id, {total(alphas)} AS whole FROM {f} JOIN {s} USING (user_id, t) WHERE t = n)")
        ctes.append(f"g{n} AS MATERIALIZED (SELECT *, {', '.join(f'exp(u{c} + z{c} - whole) AS g{c}' for c in states)} FROM {s} JOIN {f} USING (user_id, t) JOIN {b} USING (user_id, t) JOIN l{n} USING (user_id))")
        moves = [f"sum(exp(x.u{r} + ln(a{r}{c}) + y.b{c} + y.z{c} - x.whole)) AS m{r}{c}" for r in states for c in states]
        ctes.append(f"m{n} AS (SELECT {', '.join(moves)} FROM g{n} x JOIN g{n} y ON y.user_id = x.user_id AND y.t = x.t + 1, {p})")
        ctes.append(f"c{n} AS (SELECT {', '.join(f'sum(g{c}) FILTER (t = 1) / count(*) FILTER (t = 1) AS i{c}' for c in states)}, {', '.join(f'{v} AS {c}' for c, v in update.items())} FROM g{n}, {p})")
        rows = [f"m{r}{c} / ({' + '.join(f'm{r}{d}' for d in states)}) AS a{r}{c}" for r in states for c in states]
        ctes.append(f"p{n} AS (SELECT c{n}.*, {', '.join(rows)} FROM c{n}, m{n})")
    told = " UNION ALL ".join(f"SELECT {n - 1}::INTEGER AS step, round(sum(whole), 4) + 0 AS log_likelihood FROM l{n}" for n in range(1, steps + 1))
    return f"WITH RECURSIVE {', '.join(ctes)} {told}"


def symbols(obs: str, initial: np.ndarray, transit: np.ndarray, emit: np.ndarray, steps: int) -> str:
    """Symbols 0, 1, ... in a column o."""
    k, m = emit.shape
    start = {f"e{s}{o}": emit[s, o] for s in range(k) for o in range(m)}
    update = {f"e{s}{o}": f"sum(g{s}) FILTER (o = {o}) / sum(g{s})" for s in range(k) for o in range(m)}
    return history(obs, initial, transit, start, lambda s: f"ln(CASE o {' '.join(f'WHEN {o} THEN e{s}{o}' for o in range(m))} END)", update, steps)


def binomial(obs: str, initial: np.ndarray, transit: np.ndarray, theta: np.ndarray, trials: int, steps: int) -> str:
    """Counts o of so many trials."""
    choose = f"(lgamma({trials + 1}) - lgamma(o + 1) - lgamma({trials} - o + 1))"
    return history(obs, initial, transit, {f"h{s}": v for s, v in enumerate(theta)}, lambda s: f"{choose} + o * ln(h{s}) + ({trials} - o) * ln(1 - h{s})", {f"h{s}": f"sum(g{s} * o) / sum(g{s} * {trials})" for s in range(len(theta))}, steps)


def pairs(obs: str, initial: np.ndarray, transit: np.ndarray, theta: float, steps: int) -> str:
    """Counts m and u: one state has theta, the other 1 - theta."""
    log = lambda s: "m * ln(h) + u * ln(1 - h)" if s == 0 else "u * ln(h) + m * ln(1 - h)"
    return history(obs, initial, transit, {"h": theta}, log, {"h": "sum(g0 * m + g1 * u) / sum(m + u)"}, steps)


def gaussian(obs: str, initial: np.ndarray, transit: np.ndarray, means: np.ndarray, kind: str, steps: int, prior: float = 1e-2) -> str:
    """Two numbers x and y; covariances start as the identity and have a prior."""
    k = len(means)
    start = {f"{c}{s}": v for s in range(k) for c, v in zip(("x", "y", "xx", "xy", "yy"), (*means[s], 1.0, 0.0, 1.0), strict=True)}
    start = {f"q{c}": v for c, v in start.items()}

    def log(s: int) -> str:
        det = f"(qxx{s} * qyy{s} - qxy{s} * qxy{s})"
        dx, dy = f"(x - qx{s})", f"(y - qy{s})"
        return f"(-ln(2 * pi()) - 0.5::DOUBLE * ln({det}) - 0.5::DOUBLE * (qyy{s} * {dx} * {dx} - 2 * qxy{s} * {dx} * {dy} + qxx{s} * {dy} * {dy}) / {det})"

    mean = lambda s, c: f"(sum(g{s} * {c}) / sum(g{s}))"
    spread = lambda s, c, d: f"(sum(g{s} * {c} * {d}) - sum(g{s}) * {mean(s, c)} * {mean(s, d)})"
    update = {}
    for s in range(k):
        update |= {f"qx{s}": mean(s, "x"), f"qy{s}": mean(s, "y")}
        if kind == "tied":
            every = lambda c, d, add: f"({add} + {' + '.join(spread(r, c, d) for r in range(k))}) / sum({' + '.join(f'g{r}' for r in range(k))})"
        else:
            every = lambda c, d, add, s=s: f"({add} + {spread(s, c, d)}) / sum(g{s})"
        xx, yy = every("x", "x", prior), every("y", "y", prior)
        if kind == "spherical":
            xx = yy = f"(({xx}) + ({yy})) / 2"
        update |= {f"qxx{s}": xx, f"qyy{s}": yy, f"qxy{s}": every("x", "y", 0) if kind in ("full", "tied") else "any_value(qxy0)"}
    return history(obs, initial, transit, start, log, update, steps)
