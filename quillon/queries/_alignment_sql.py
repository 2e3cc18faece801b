"""SQL for the aligners: the three matrices row by row in a recursive query, then the way back from the last cell."""

from __future__ import annotations

#: Moves as SQL: both -> both, one alone -> both, both -> one alone, one alone -> the same, a character beside a gap, the end.
GOTOH = {"stay": "0.0", "close": "0.0", "open": "-5.0", "extend": "-1.0", "gap": "0.0", "end": "0.0", "equal": "1.0", "different": "-1.0"}
NONE = "'-inf'::DOUBLE"


def _logs() -> dict[str, str]:
    """The pair model's numbers as logarithms: stay 1 - 2 delta - tau, close 1 - epsilon - tau."""
    numbers = {"stay": "1 - 2 * 0.1 - 1 / 30.0", "close": "1 - 0.2 - 1 / 30.0", "open": "0.1", "extend": "0.2", "gap": "0.25", "end": "1 / 30.0", "equal": "0.125", "different": "1 / 24.0"}
    return {k: f"ln(({v})::DOUBLE)" for k, v in numbers.items()}


HMM = _logs()


def filled(moves: dict[str, str], local: bool = False, backward: bool = False) -> str:
    """CTEs d (different pairs) and g (x, y, n, m and matrices b, d, r: cell (i, j) is b[i + 1][j + 1])."""
    m = moves
    side = (lambda c: f"reverse({c})") if backward else (lambda c: c)
    best = f"greatest(b[i][j] + {m['stay']}, greatest(d[i][j], r[i][j]) + {m['close']})"
    emit = f"CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN {m['equal']} ELSE {m['different']} END"
    both = f"CASE WHEN j = 0 THEN {NONE} ELSE {emit} + {f'greatest({best}, 0)' if local else best} END"
    right = f"CASE WHEN j = 0 THEN {NONE} ELSE list_max(list_transform(range(0, j), lambda k: row[k + 1] + {m['open']} + {m['gap']} + (j - 1 - k) * ({m['extend']} + {m['gap']}))) END"
    at = "i::BIGINT"
    both, down = (s.replace("[i]", f"[{at}]") for s in (both, f"{m['gap']} + greatest(b[i][j + 1] + {m['open']}, d[i][j + 1] + {m['extend']})"))
    return f"""p AS (SELECT u.p_partkey, u.p_name AS x0, v.p_name AS y0, {side('u.p_name')} AS x, {side('v.p_name')} AS y FROM part u JOIN part v ON v.p_partkey = u.p_partkey + 1),
    f AS (SELECT DISTINCT x, y, 1::BIGINT AS i, length(x) AS n, length(y) AS m, [list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {NONE} END)] AS b,
        [list_transform(range(0, length(y) + 1), lambda j: {NONE})] AS d, [list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN {NONE} ELSE ({m['open']} + {m['gap']} + (j - 1) * ({m['extend']} + {m['gap']}))::DOUBLE END)] AS r FROM p
      UNION ALL SELECT x, y, i + 1, n, m, list_append(b, row), list_append(d, down), list_append(r, list_transform(range(0, m + 1), lambda j: {right}))
      FROM (SELECT *, list_transform(range(0, m + 1), lambda j: {both}) AS row, list_transform(range(0, m + 1), lambda j: {down}) AS down FROM f WHERE i <= n)),
    g AS (SELECT x, y, n, m, b, d, r FROM f WHERE i = n + 1)"""


def aligned(moves: dict[str, str], local: bool = False, backward: bool = False) -> str:
    """p_partkey, score, the places of the columns as text, and both strings with their gaps."""
    m = moves
    near = lambda a, b: f"abs(({a}) - ({b})) < 1e-9"
    emit = f"CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN {m['equal']} ELSE {m['different']} END"
    cell = lambda t, di, dj: f"{t}[i + {1 - di}][j + {1 - dj}]"
    here = f"{cell('b', 0, 0)} - ({emit})"
    before = [f"{cell('b', 1, 1)} + {m['stay']}", f"{cell('d', 1, 1)} + {m['close']}", f"{cell('r', 1, 1)} + {m['close']}"]
    stops = "false"
    if local:
        stops = f"state = 0 AND {near(here, '0')} AND NOT ({' OR '.join(f'({v} > 0 AND {near(here, v)})' for v in before)})"
        start = "SELECT x, y, 0 AS state, (c - 1) // (m + 1) AS i, (c - 1) % (m + 1) AS j, top AS score FROM (SELECT *, list_max(flatten(b)) AS top, list_position(flatten(b), list_max(flatten(b)))::BIGINT AS c FROM g)"
    else:
        last = [f"{t}[n + 1][m + 1]" for t in "bdr"]
        top = f"greatest({', '.join(last)})"
        start = f"SELECT x, y, CASE WHEN {last[0]} > {top} - 1e-9 THEN 0 WHEN {last[1]} > {top} - 1e-9 THEN 1 ELSE 2 END AS state, n::BIGINT AS i, m::BIGINT AS j, {top} + {m['end']} AS score FROM g"
    size = lambda c: f"length({c})"
    order = (lambda c, s: f"list_transform(list_reverse({c}), lambda v: CASE WHEN v < 0 THEN -1 ELSE {size(s)} - 1 - v END)") if backward else (lambda c, s: c)
    shown = lambda c, s: f"array_to_string(list_transform({c}, lambda v: CASE WHEN v < 0 THEN '-' ELSE substr({s}, v + 1, 1) END), '')"
    return f"""WITH RECURSIVE {filled(moves, local, backward)},
    s AS ({start}),
    t AS (SELECT x, y, state, i, j, []::BIGINT[] AS xs, []::BIGINT[] AS ys, {'score <= 0' if local else 'false'} AS stopped FROM s
      UNION ALL SELECT x, y, CASE state WHEN 0 THEN CASE WHEN {near(here, before[0])} THEN 0 WHEN {near(here, before[1])} THEN 1 ELSE 2 END
          WHEN 1 THEN CASE WHEN {near(f"{cell('d', 0, 0)} - {m['gap']}", f"{cell('b', 1, 0)} + {m['open']}")} THEN 0 ELSE 1 END
          ELSE CASE WHEN {near(f"{cell('r', 0, 0)} - {m['gap']}", f"{cell('b', 0, 1)} + {m['open']}")} THEN 0 ELSE 2 END END,
        CASE WHEN state = 2 THEN i ELSE i - 1 END, CASE WHEN state = 1 THEN j ELSE j - 1 END,
        list_prepend(CASE WHEN state = 2 THEN -1 ELSE i - 1 END, xs), list_prepend(CASE WHEN state = 1 THEN -1 ELSE j - 1 END, ys), {stops}
      FROM t JOIN g USING (x, y) WHERE (t.i > 0 OR t.j > 0) AND NOT stopped),
    e AS (SELECT x, y, xs, ys FROM t WHERE stopped OR (i = 0 AND j = 0)),
    o AS (SELECT p_partkey, x0, y0, {'greatest(score, 0)' if local else 'score'} AS score, {order('xs', 'x')} AS xs, {order('ys', 'y')} AS ys FROM p JOIN s USING (x, y) JOIN e USING (x, y))
    SELECT p_partkey, round(score, 6) + 0 AS score, array_to_string(xs, ',') AS x_places, array_to_string(ys, ',') AS y_places, {shown('xs', 'x0')} AS x_row, {shown('ys', 'y0')} AS y_row FROM o"""


def pair_probabilities() -> str:
    """ln P(x, y) over all alignments, in plain probabilities, and ln P(best alignment | x, y)."""
    best = filled(HMM).replace("p AS (", "WITH RECURSIVE p AS (", 1)
    chance = {k: f"exp({v})" for k, v in HMM.items()}
    emit = f"CASE WHEN substr(x, i, 1) = substr(y, j, 1) THEN {chance['equal']} ELSE {chance['different']} END"
    both = f"CASE WHEN j = 0 THEN 0 ELSE ({emit}) * (fb[j] * {chance['stay']} + (fd[j] + fr[j]) * {chance['close']}) END"
    down = f"{chance['gap']} * (fb[j + 1] * {chance['open']} + fd[j + 1] * {chance['extend']})"
    right = f"CASE WHEN j = 0 THEN 0 ELSE list_sum(list_transform(range(0, j), lambda k: row[k + 1] * {chance['open']} * {chance['gap']} * pow({chance['extend']} * {chance['gap']}, j - 1 - k))) END"
    first = right.replace("list_sum(list_transform(range(0, j), lambda k: row[k + 1] *", "(").replace("j - 1 - k)))", "j - 1))")
    return f"""{best},
    w AS (SELECT DISTINCT x, y, 1::BIGINT AS i, length(x) AS n, length(y) AS m, list_transform(range(0, length(y) + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0 END) AS fb,
        list_transform(range(0, length(y) + 1), lambda j: 0.0::DOUBLE) AS fd, list_transform(range(0, length(y) + 1), lambda j: ({first})::DOUBLE) AS fr FROM p
      UNION ALL SELECT x, y, i + 1, n, m, row, down, list_transform(range(0, m + 1), lambda j: ({right})::DOUBLE)
      FROM (SELECT *, list_transform(range(0, m + 1), lambda j: ({both})::DOUBLE) AS row, list_transform(range(0, m + 1), lambda j: ({down})::DOUBLE) AS down FROM w WHERE i <= n)),
    q AS (SELECT x, y, ln({chance['end']} * (fb[m + 1] + fd[m + 1] + fr[m + 1])) AS whole FROM w WHERE i = n + 1)
    SELECT p_partkey, round(whole, 6) + 0 AS log_pair, round(greatest(b[n + 1][m + 1], d[n + 1][m + 1], r[n + 1][m + 1]) + {HMM['end']} - whole, 6) + 0 AS log_alignment
    FROM p JOIN q USING (x, y) JOIN g USING (x, y)"""
