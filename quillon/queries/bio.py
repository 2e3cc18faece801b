"""Strings and sequences: part names (whole), events of a user as a sequence, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.operators import alignment, folding, scode
from quillon.operators import strings as S
from quillon.operators.sequences import gathered, runs
from quillon.queries import _alignment_sql as oracle
from quillon.queries._registry import embeddings, query, r6


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name")


SUFFIX = "WITH t AS (SELECT p_partkey, p_name || '$' AS t FROM part), s AS (SELECT p_partkey, i - 1 AS sa, t, substr(t, i) AS suffix FROM t, (SELECT unnest(range(1, 14))::INTEGER AS i) WHERE i <= length(t)), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY suffix) - 1 AS rank FROM s)"


@query("suffix_array", SUFFIX + " SELECT p_partkey, rank::INTEGER AS rank, sa, suffix FROM r")
def suffix_array(spark, sf_dir):
    return S.suffixes(names(spark, sf_dir), "p_partkey", "p_name")


@query("bwt", SUFFIX + " SELECT p_partkey, rank::INTEGER AS rank, CASE WHEN sa = 0 THEN '$' ELSE substr(t, sa, 1) END AS bwt FROM r")
def bwt(spark, sf_dir):
    return S.bwt(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), "p_partkey").select("p_partkey", "rank", "bwt")


OCC = SUFFIX + ", b AS (SELECT p_partkey, rank, CASE WHEN sa = 0 THEN '$' ELSE substr(t, sa, 1) END AS c FROM r), o AS (SELECT *, count(*) OVER (PARTITION BY p_partkey, c ORDER BY rank) AS occ FROM b)"


@query("occ_table", OCC + " SELECT o.p_partkey, rank::INTEGER AS rank, c AS bwt, occ, (SELECT count(*) FROM b WHERE b.p_partkey = o.p_partkey AND b.c < o.c) AS smaller FROM o")
def occ_table(spark, sf_dir):
    ranked = S.bwt(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), "p_partkey")
    return S.occurrences(ranked, "p_partkey").select("p_partkey", "rank", "bwt", "occ", "smaller")


@query("lf_mapping", SUFFIX + " SELECT a.p_partkey, a.rank::INTEGER AS rank, b.rank::INTEGER AS lf FROM r a JOIN r b ON a.p_partkey = b.p_partkey AND b.sa = CASE WHEN a.sa = 0 THEN length(a.t) - 1 ELSE a.sa - 1 END")
def lf_mapping(spark, sf_dir):
    """Q15: each suffix's rank and that of the suffix one longer."""
    ranked = S.bwt(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), "p_partkey")
    return S.last_to_first(S.occurrences(ranked, "p_partkey")).select("p_partkey", "rank", "lf")


@query("lcp_array", SUFFIX + ", n AS (SELECT *, lead(suffix) OVER (PARTITION BY p_partkey ORDER BY rank) AS nx FROM r) SELECT p_partkey, rank::INTEGER AS rank, CASE WHEN nx IS NULL THEN -1 ELSE len(list_filter(range(1, 14), lambda k: k <= least(length(suffix), length(nx)) AND substr(suffix, 1, k) = substr(nx, 1, k))) END::INTEGER AS lcp FROM n")
def lcp_array(spark, sf_dir):
    return S.lcp(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), "p_partkey").select("p_partkey", "rank", "lcp")


NAMED = "WITH t AS (SELECT p_partkey, p_name AS t FROM part), p AS (SELECT p_partkey, t, i - 1 AS sa FROM t, (SELECT unnest(range(1, 13))::INTEGER AS i) WHERE i <= length(t))"
COMMON = "len(list_filter(range(1, 13), lambda k: k <= least(length({a}), length({b})) AND substr({a}, 1, k) = substr({b}, 1, k)))"


@query("lpf_array", NAMED + f" SELECT a.p_partkey, a.sa, coalesce(max({COMMON.format(a='substr(a.t, a.sa + 1)', b='substr(a.t, b.sa + 1)')}), 0)::INTEGER AS lpf FROM p a LEFT JOIN p b ON a.p_partkey = b.p_partkey AND b.sa < a.sa GROUP BY ALL")
def lpf_array(spark, sf_dir):
    return S.lpf(names(spark, sf_dir), "p_partkey", "p_name")


@query(
    "lz77",
    NAMED.replace("WITH", "WITH RECURSIVE")
    + f""", l AS (SELECT a.p_partkey, a.t, a.sa, greatest(1, coalesce(max({COMMON.format(a='substr(a.t, a.sa + 1)', b='substr(a.t, b.sa + 1)')}), 0)) AS n FROM p a LEFT JOIN p b ON a.p_partkey = b.p_partkey AND b.sa < a.sa GROUP BY ALL),
    f(p_partkey, pos, sa, n, t) AS (SELECT p_partkey, 0, sa, n, t FROM l WHERE sa = 0 UNION ALL SELECT l.p_partkey, f.pos + 1, l.sa, l.n, l.t FROM f JOIN l ON l.p_partkey = f.p_partkey AND l.sa = f.sa + f.n)
    SELECT p_partkey, pos::INTEGER AS pos, substr(t, sa + 1, n) AS factor FROM f""",
)
def lz77(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.posexplode(S.factors(F.col("p_name"))).alias("pos", "factor"))


@query("z_array", NAMED + f" SELECT p_partkey, sa, CASE WHEN sa = 0 THEN 0 ELSE {COMMON.format(a='t', b='substr(t, sa + 1)')} END::INTEGER AS z FROM p")
def z_array(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.posexplode(S.z_array(F.col("p_name"))).alias("sa", "z"))


@query(
    "failure_array",
    """SELECT p_partkey, k - 1 AS i, list_max(list_filter(range(0, k), lambda b: substr(p_name, 1, b) = substr(p_name, k - b + 1, b)))::INTEGER AS border
    FROM part, (SELECT unnest(range(1, 41)) AS k) WHERE k <= length(p_name)""",
)
def failure_array(spark, sf_dir):
    """Q19"""
    return names(spark, sf_dir).select("p_partkey", F.posexplode(S.failure_array(F.col("p_name"))).alias("i", "border"))


@query("prefix_match", NAMED + f" SELECT p_partkey, sa, {COMMON.format(a="'red widget'", b='substr(t, sa + 1)')}::INTEGER AS n FROM p")
def prefix_match(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.posexplode(S.prefix_matches(F.lit("red widget"), F.col("p_name"))).alias("sa", "n"))


@query("fm_search", "SELECT q AS query, p_partkey, i::INTEGER AS sa FROM part, (VALUES ('re'), ('ing'), ('l '), ('e'), ('zz')) t(q), range(12) r(i) WHERE substr(p_name, i::BIGINT + 1, length(q)) = q")
def fm_search(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in ("re", "ing", "l ", "e", "zz")], "q string")
    return S.occurrences_of(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), asked, "p_partkey", "q")


@query("tandem_of_query", "SELECT DISTINCT 'l' AS query, p_partkey, CASE WHEN contains(p_name, 'll') THEN 2 ELSE 1 END::BIGINT AS score FROM part WHERE contains(p_name, 'l')")
def tandem_of_query(spark, sf_dir):
    asked = spark.createDataFrame([("l",)], "q string")
    hits = S.occurrences_of(S.suffixes(names(spark, sf_dir), "p_partkey", "p_name"), asked, "p_partkey", "q")
    return S.tandem_score(hits, "p_partkey").select("query", "p_partkey", F.col("score").cast("long").alias("score"))


@query(
    "tandem_best",
    """WITH t AS (SELECT p_partkey, p_name AS t FROM part), a AS (SELECT p_partkey, t, p, i FROM t, (SELECT unnest(range(1, 7)) AS p), (SELECT unnest(range(1, 13)) AS i) WHERE p <= length(t) // 2 AND i + p <= length(t) AND substr(t, i, 1) = substr(t, i + p, 1)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, p ORDER BY i) AS g FROM a), r AS (SELECT p_partkey, t, p, min(i) AS i, count(*) AS r FROM g GROUP BY p_partkey, t, p, g HAVING count(*) >= p),
    b AS (SELECT *, (r // p + 1) * p AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY (r // p + 1) * p DESC, p, i) AS k FROM r)
    SELECT t.p_partkey, coalesce(score, 0)::BIGINT AS score, coalesce(p, 0)::INTEGER AS period, coalesce(substr(t.t, i, p), '') AS unit FROM t LEFT JOIN b ON b.p_partkey = t.p_partkey AND k = 1""",
)
def tandem_best(spark, sf_dir):
    return S.best_tandem(names(spark, sf_dir), "p_partkey", "p_name")


@query("run_length", "WITH c AS (SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey, t AS decoded FROM c")
def run_length(spark, sf_dir):
    """Q22: the statuses of a customer's orders, coded and decoded again."""
    rows = gathered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderstatus")
    coded = rows.select("o_custkey", S.run_length(F.array_join("obs", "")).alias("coded"))
    return coded.select("o_custkey", S.run_length_decoded(F.col("coded")).alias("decoded"))


@query(
    "run_length_code",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders),
    r AS (SELECT o_custkey, s, min(o_orderkey) AS k, count(*) AS n FROM o GROUP BY o_custkey, s, g)
    SELECT o_custkey, string_agg(s || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY k) AS coded FROM r GROUP BY o_custkey""",
)
def run_length_code(spark, sf_dir):
    rows = gathered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "o_orderstatus")
    return rows.select("o_custkey", S.run_length(F.array_join("obs", "")).alias("coded"))


@query("kmers", "SELECT p_partkey, i::INTEGER AS place, substr(p_name, i::BIGINT + 1, 4) AS kmer FROM part, range(12) r(i) WHERE i + 4 <= length(p_name)")
def kmers(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.posexplode(S.kmers(F.col("p_name"), 4)).alias("place", "kmer"))


#: Common prefixes of all pairs of suffixes, as runs along the diagonals; the end mark sorts before all characters.
TEXT_INDEX = """WITH b AS (SELECT item_id, replace(coalesce(text, ''), '$', ' ') AS t FROM benchmark),
    c AS (SELECT item_id, unnest(range(0, length(t))) AS p, t FROM b), d AS MATERIALIZED (SELECT item_id, p, substr(t, p + 1, 1) AS c, length(t) AS n FROM c),
    m AS (SELECT x.item_id, x.p AS i, y.p AS j, x.n, x.c = y.c AS same FROM d x JOIN d y ON y.item_id = x.item_id AND y.p > x.p),
    l AS MATERIALIZED (SELECT item_id, i, j, coalesce(min(CASE WHEN NOT same THEN j END) OVER (PARTITION BY item_id, j - i ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) - j AS k FROM m),
    s AS (SELECT item_id, p AS sa, substr(t, p + 1) AS suffix, CASE WHEN p = 0 THEN '$' ELSE substr(t, p, 1) END AS before FROM c
      UNION ALL SELECT item_id, length(t), '', CASE WHEN t = '' THEN '$' ELSE substr(t, length(t), 1) END FROM b),
    r AS (SELECT *, row_number() OVER w AS rank, lead(sa) OVER w AS follows FROM s WINDOW w AS (PARTITION BY item_id ORDER BY suffix)),
    a AS (SELECT r.item_id, array_to_string(list(sa ORDER BY rank), ',') AS sa, string_agg(before, '' ORDER BY rank) AS bwt,
      array_to_string(list(CASE WHEN follows IS NULL THEN -1 ELSE coalesce(k, 0) END ORDER BY rank), ',') AS lcp
      FROM r LEFT JOIN l ON l.item_id = r.item_id AND l.i = least(sa, follows) AND l.j = greatest(sa, follows) GROUP BY r.item_id),
    f AS (SELECT item_id, array_to_string(list(lpf ORDER BY p), ',') AS lpf, array_to_string(list(z ORDER BY p), ',') AS z FROM
      (SELECT d.item_id, d.p, coalesce(max(k), 0) AS lpf, coalesce(max(k) FILTER (i = 0), 0) AS z FROM d LEFT JOIN l ON l.item_id = d.item_id AND l.j = d.p GROUP BY ALL) GROUP BY item_id)
    SELECT b.item_id, length(t)::BIGINT AS n, sa, bwt, lcp, coalesce(lpf, '') AS lpf, coalesce(z, '') AS z FROM b JOIN a USING (item_id) LEFT JOIN f USING (item_id)"""


@query("text_index", TEXT_INDEX)
def text_index(spark, sf_dir):
    """Q12 to Q23 over the whole texts of the benchmark's items, of any length; numbers as text, which any engine compares."""
    found = S.text_index(table(spark, sf_dir, "benchmark"), "item_id", "text")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("item_id", "n", listed("sa"), "bwt", listed("lcp"), listed("lpf"), listed("z"))


@query("runs", "WITH e AS (SELECT user_id, value > 100 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events), g AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM e WHERE f) SELECT user_id, min(p) AS start, count(*) AS length FROM g GROUP BY user_id, g")
def run_areas(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 100).alias("f"))
    return runs(rows, "user_id", "event_id", "f")


def _gains(spark, sf_dir):
    return gathered(table(spark, sf_dir, "events").withColumn("g", F.col("value") - F.lit(100.0)), "user_id", ["ts", "event_id"], "g")


@query("mss_limit1", "SELECT user_id, round(sum(greatest(value - 100, 0)), 6) + 0 AS best FROM events GROUP BY user_id")
def mss_limit1(spark, sf_dir):
    return _gains(spark, sf_dir).select("user_id", r6(S.segment_sum(F.col("obs"), 1)).alias("best"))


@query(
    "mss_limit3",
    """WITH RECURSIVE e AS (SELECT user_id, value - 100 AS r, row_number() OVER w AS p, sum(value - 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, count(*) OVER (PARTITION BY user_id) AS n
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    m(user_id, p, o, o1, o2, s) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, '-inf'::DOUBLE FROM events
      UNION ALL SELECT e.user_id, e.p, greatest(m.o, m.s), m.o, m.o1, CASE WHEN e.p < 3 THEN '-inf'::DOUBLE ELSE greatest(m.o2 + e.last3, m.s + e.r) END FROM m JOIN e ON e.user_id = m.user_id AND e.p = m.p + 1)
    SELECT m.user_id, round(greatest(m.o, m.s), 6) + 0 AS best FROM m JOIN (SELECT user_id, max(p) AS p FROM e GROUP BY user_id) x USING (user_id, p)""",
)
def mss_limit3(spark, sf_dir):
    return _gains(spark, sf_dir).select("user_id", r6(S.segment_sum(F.col("obs"), 3)).alias("best"))


# -- alignment and folding

#: Five event types as four bases.
BASES = "translate(substr(event_type, 1, 1), 'cepsv', 'AUGCA')"


def strands(spark, sf_dir):
    """(user_id, seq): each user's events as bases, in the order of time and id."""
    base = F.translate(F.substring("event_type", 1, 1), "cepsv", "AUGCA")
    rows = gathered(table(spark, sf_dir, "events").withColumn("b", base), "user_id", ["ts", "event_id"], "b")
    return rows.select("user_id", F.array_join("obs", "").alias("seq"))


@query("base_pairs", f"WITH s AS (SELECT user_id, {BASES} AS a, lead({BASES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count(*) FILTER (a || b IN ('AU', 'UA', 'GC', 'CG')) AS pairs, count(*) FILTER (a || b IN ('AU', 'UA', 'GC', 'CG', 'GU', 'UG')) AS wobbling FROM s GROUP BY user_id")
def base_pairs(spark, sf_dir):
    """Q11: neighbouring bases that would pair."""
    rows = strands(spark, sf_dir).select("user_id", S.characters(F.col("seq")).alias("c"))
    both = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(S.base_pair(a, b).alias("p"), S.base_pair(a, b, True).alias("w")))
    count = lambda f: F.size(F.filter("x", lambda s: s[f])).cast("long")
    return rows.select("user_id", both.alias("x")).select("user_id", count("p").alias("pairs"), count("w").alias("wobbling"))


def pairs_of_names(spark, sf_dir):
    """Each part's name beside the next part's."""
    a = names(spark, sf_dir)
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y"))
    return a.join(b, "p_partkey").select("p_partkey", F.col("p_name").alias("x"), "y")


def _aligner(name, model, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        """Score, columns (places as text, which any engine can compare) and the strings with their gaps."""
        found = alignment.align_pairs(pairs_of_names(spark, sf_dir), model, "p_partkey", "x", "y")
        places = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
        return found.select("p_partkey", r6(F.col("score")).alias("score"), places("x_idx").alias("x_places"), places("y_idx").alias("y_places"), "x_row", "y_row")


_aligner("nw_align", alignment.Gotoh(), oracle.aligned(oracle.GOTOH))
_aligner("nw_align_backward", alignment.Gotoh(backward=True), oracle.aligned(oracle.GOTOH, backward=True))
_aligner("sw_align", alignment.Gotoh(local=True), oracle.aligned(oracle.GOTOH, local=True))
_aligner("pair_hmm_align", alignment.PairHmm(), oracle.aligned(oracle.HMM))


@query("pair_hmm_scores", oracle.pair_probabilities())
def pair_hmm_scores(spark, sf_dir):
    found = alignment.pair_scores(pairs_of_names(spark, sf_dir), alignment.PairHmm(), "p_partkey", "x", "y")
    return found.select("p_partkey", r6(F.col("log_pair")).alias("log_pair"), r6(F.col("log_alignment")).alias("log_alignment"))


#: best[width + 1][start + 1]: the most pairs of a stretch, by width; then the way back, a stretch at a time.
MATES = "('AU', 'UA', 'GC', 'CG', 'GU', 'UG')"
NUSSINOV = f"""WITH RECURSIVE s AS (SELECT user_id, string_agg({BASES}, '' ORDER BY ts, event_id) AS q FROM events GROUP BY user_id),
    f(user_id, q, n, w, best) AS (SELECT user_id, q, length(q), 1::BIGINT, [list_transform(range(0, length(q) + 1), lambda i: 0), list_transform(range(0, length(q)), lambda i: 0)] FROM s
      UNION ALL SELECT user_id, q, n, w + 1, list_append(best, list_transform(range(0, n - w), lambda i: greatest(best[w + 1][i + 2], best[w + 1][i + 1],
        best[w][i + 2] + (w > 3 AND substr(q, i + 1, 1) || substr(q, i + w + 1, 1) IN {MATES})::INTEGER,
        list_max(list_transform(range(1, w + 1), lambda k: best[k + 1][i + 1] + best[w + 2 - k][i + k + 1]))))) FROM f WHERE w < n),
    g AS MATERIALIZED (SELECT * FROM f WHERE w = n),
    t(user_id, i, j, paired) AS (SELECT user_id, 0::BIGINT, n::BIGINT, false FROM g
      UNION ALL SELECT user_id, next.i, next.j, next.paired FROM (SELECT user_id, unnest(CASE
        WHEN here = best[j - i][i + 2] THEN [{{'i': i + 1, 'j': j, 'paired': false}}]
        WHEN here = best[j - i][i + 1] THEN [{{'i': i, 'j': j - 1, 'paired': false}}]
        WHEN j - i > 4 AND substr(q, i + 1, 1) || substr(q, j, 1) IN {MATES} AND here = best[j - i - 1][i + 2] + 1 THEN [{{'i': i + 1, 'j': j - 1, 'paired': true}}]
        ELSE list_transform([list_filter(range(i + 1, j), lambda k: here = best[k - i + 1][i + 1] + best[j - k + 1][k + 1])[1]], lambda k: {{'i': i, 'j': k, 'paired': false}})
          || list_transform([list_filter(range(i + 1, j), lambda k: here = best[k - i + 1][i + 1] + best[j - k + 1][k + 1])[1]], lambda k: {{'i': k, 'j': j, 'paired': false}}) END) AS next
        FROM (SELECT t.user_id, t.i, t.j, g.q, g.best, g.best[t.j - t.i + 1][t.i + 1] AS here FROM t JOIN g ON g.user_id = t.user_id WHERE t.j - t.i >= 2))),
    p AS (SELECT user_id, list(i - 1) AS opens, list(j) AS closes FROM t WHERE paired GROUP BY user_id)
    SELECT user_id, best[n + 1][1]::DOUBLE AS score, array_to_string(list_transform(range(0, n), lambda x: CASE WHEN list_contains(opens, x) THEN '(' WHEN list_contains(closes, x) THEN ')' ELSE '.' END), '') AS brackets
    FROM g LEFT JOIN p USING (user_id)"""


@query("nussinov", NUSSINOV)
def nussinov(spark, sf_dir):
    return folding.fold_rows(strands(spark, sf_dir), folding.Nussinov(), "user_id", "seq")


@query("zuker")
def zuker(spark, sf_dir):
    return folding.fold_rows(strands(spark, sf_dir), folding.Zuker(), "user_id", "seq")


@query("scode_pairs")
def scode_pairs(spark, sf_dir):
    """Q31, Q32: the first 8 components of the embeddings as genes, their ids as pseudo-time."""
    rows = embeddings(spark, sf_dir)
    span = rows.agg(F.max("vec_id").alias("m")).first()["m"] or 1
    cells = rows.select((F.col("vec_id") / F.lit(float(span))).alias("t"), F.slice("v", 1, 8).alias("x"))
    return scode.Scode(max_iter=50).fit(cells, "t", "x").strongest(spark, 10)
