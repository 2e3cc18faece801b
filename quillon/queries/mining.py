"""Filters, tries, graphs, itemsets, puzzles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.core.session import table
from quillon.operators import mining as M
from quillon.queries._registry import query


@query("bloom_membership", "SELECT o_custkey AS key, TRUE AS found FROM orders GROUP BY o_custkey")
def bloom_membership(spark, sf_dir):
    """Every customer with an order is found in the filter of those customers."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    bloom = M.Bloom(200_000, 0.001).grown(keys)
    return bloom.has(keys, "key", bloom.add(keys, "key"))


@query("bloom_union", "SELECT c_custkey AS key, TRUE AS found FROM customer")
def bloom_union(spark, sf_dir):
    """The union of the filters of two halves holds all."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    rich, poor = keys.where("c_acctbal > 5000").select("key"), keys.where("c_acctbal <= 5000").select("key")
    bloom = M.Bloom(200_000, 0.001).grown(keys.select("key"))
    return bloom.has(keys, "key", M.bloom_union(bloom.add(rich, "key"), bloom.add(poor, "key")))


@query("bloom_intersection", "SELECT DISTINCT c_custkey AS key, TRUE AS found FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def bloom_intersection(spark, sf_dir):
    """What is in both filters is in their intersection."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    bloom = M.Bloom(200_000, 0.001).grown(rich, buyers)
    both = M.bloom_intersection(bloom.add(rich, "key"), bloom.add(buyers, "key"))
    return bloom.has(rich.join(buyers.hint("merge"), "key", "left_semi"), "key", both)


@query(
    "bloom_bits",
    """WITH d AS (SELECT DISTINCT p_brand, md5('\\x00\\x00\\x00\\x00'::BLOB || encode(p_brand)) AS h FROM part)
    SELECT p_brand, i::INTEGER AS slice, (('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2))::INTEGER % 1024)::BIGINT AS bit FROM d, range(5) t(i)""",
)
def bloom_bits(spark, sf_dir):
    """The bits of the brands by cryptographic digests."""
    places = M.digest_places(1024, 5)
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.posexplode(places(F.col("p_brand"))).alias("slice", "bit"))


PREFIXES = "WITH w AS (SELECT DISTINCT p_name AS w FROM part), n AS (SELECT DISTINCT substr(w, 1, d) AS prefix, d AS depth FROM w, (SELECT unnest(range(0, 13))::INTEGER AS d) WHERE d <= length(w))"


@query("trie_nodes", PREFIXES + " SELECT prefix, CASE WHEN depth > 0 THEN substr(prefix, 1, depth - 1) END AS parent, depth, prefix IN (SELECT w FROM w) AS is_word FROM n")
def trie_nodes(spark, sf_dir):
    return M.trie(table(spark, sf_dir, "part"), "p_name")


@query("trie_prefixes", "SELECT q FROM (VALUES ('re'), ('red widget'), ('zz'), ('blue b'), ('')) t(q) WHERE EXISTS (SELECT 1 FROM part WHERE starts_with(p_name, q))")
def trie_prefixes(spark, sf_dir):
    asked = spark.createDataFrame([(q,) for q in ("re", "red widget", "zz", "blue b", "")], "q string")
    return M.has_prefix(asked, "q", M.trie(table(spark, sf_dir, "part"), "p_name"))


@query("louds_bits", PREFIXES + ", d AS (SELECT substr(prefix, 1, depth - 1) AS prefix, count(*) AS c FROM n WHERE depth > 0 GROUP BY ALL) SELECT row_number() OVER (ORDER BY depth, n.prefix)::INTEGER AS number, n.prefix, repeat('1', coalesce(c, 0)) || '0' AS bits FROM n LEFT JOIN d ON d.prefix = n.prefix")
def louds_bits(spark, sf_dir):
    return M.louds(M.trie(table(spark, sf_dir, "part"), "p_name")).select("number", "prefix", "bits")


ASKED = ("re", "red widget", "zz", "blue b", "", "b", "steel", "green widge")


@query(
    "louds_search",
    PREFIXES
    + """, d AS (SELECT substr(prefix, 1, depth - 1) AS prefix, count(*) AS c FROM n WHERE depth > 0 GROUP BY ALL),
    c AS (SELECT row_number() OVER (ORDER BY depth, n.prefix) AS number, n.prefix, repeat('1', coalesce(c, 0)) || '0' AS bits FROM n LEFT JOIN d ON d.prefix = n.prefix),
    s AS (SELECT '10' || string_agg(bits, '' ORDER BY number) AS s FROM c),
    o AS (SELECT i - 1 AS place, row_number() OVER (ORDER BY i) AS number FROM (SELECT s, unnest(range(1, length(s) + 1)) AS i FROM s) WHERE substr(s, i, 1) = '1')
    SELECT q, coalesce(number, -1)::INTEGER AS node, coalesce(place, -1)::INTEGER AS place FROM (VALUES """
    + ", ".join(f"('{q}')" for q in ASKED)
    + ") t(q) LEFT JOIN c ON c.prefix = q LEFT JOIN o USING (number)",
)
def louds_search(spark, sf_dir):
    """Nodes of the names' trie, found in its code."""
    asked = spark.createDataFrame([(q,) for q in ASKED], "q string")
    return M.louds_search(asked, "q", M.louds(M.trie(table(spark, sf_dir, "part"), "p_name")))


EDGES = "WITH e AS (SELECT substr(p_name, i::BIGINT + 1, 4) AS src, substr(p_name, i::BIGINT + 2, 4) AS dst FROM part, range(12) r(i) WHERE i + 5 <= length(p_name)), k AS (SELECT DISTINCT substr(p_name, i::BIGINT + 1, 4) AS kmer FROM part, range(12) r(i) WHERE i + 4 <= length(p_name))"


@query("debruijn_edges", EDGES + " SELECT src, dst, count(*) AS n FROM e GROUP BY ALL")
def debruijn_edges(spark, sf_dir):
    return M.debruijn_edges(table(spark, sf_dir, "part"), "p_name", 4)


@query("debruijn_sources", EDGES + " SELECT kmer FROM k WHERE kmer NOT IN (SELECT dst FROM e)")
def debruijn_sources(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return M.debruijn_sources(M.kmer_rows(part, "p_name", 4), M.debruijn_edges(part, "p_name", 4))


@query("debruijn_extensions", EDGES + ", c AS (SELECT unnest(['A', 'e', 'l', ' ']) AS c) SELECT kmer, substr(kmer, 2) || c AS next FROM k, c")
def debruijn_extensions(spark, sf_dir):
    return M.extensions(M.kmer_rows(table(spark, sf_dir, "part"), "p_name", 4), "Ael ")


@query("debruijn_false_positives")
def debruijn_false_positives(spark, sf_dir):
    """What a small filter wrongly takes for a k-mer."""
    nodes = M.kmer_rows(table(spark, sf_dir, "part"), "p_name", 4)
    bloom = M.Bloom(1_000, 0.2)
    return M.critical_false_positives(nodes, bloom, bloom.add(nodes, "kmer"), "abcdefghijklmnopqrstuvwxyz ")


@query(
    "debruijn_assemble",
    EDGES.replace("WITH", "WITH RECURSIVE")
    + """, x AS (SELECT a.kmer, b.kmer AS next FROM k a JOIN k b ON substr(a.kmer, 2) = substr(b.kmer, 1, 3)),
    t(start, last, sequence, seen) AS (SELECT kmer, kmer, kmer, [kmer] FROM k WHERE kmer NOT IN (SELECT dst FROM e)
      UNION ALL SELECT start, x.next, sequence || substr(x.next, 4, 1), list_append(seen, x.next) FROM t JOIN x ON x.kmer = t.last WHERE NOT list_contains(seen, x.next))
    SELECT start, sequence FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.kmer = t.last AND NOT list_contains(t.seen, x.next))""",
)
def debruijn_assemble(spark, sf_dir):
    """All trails of the names' 4-grams."""
    part = table(spark, sf_dir, "part")
    nodes = M.kmer_rows(part, "p_name", 4)
    return M.assemble(M.debruijn_sources(nodes, M.debruijn_edges(part, "p_name", 4)), nodes, None)


def baskets(spark, sf_dir):
    """(l_orderkey, p_brand): the brands of an order's parts."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return items.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_brand")


SETS = "WITH b AS (SELECT DISTINCT l_orderkey AS tx, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT count(DISTINCT tx) // 40 AS th FROM b)"


def _threshold(rows):
    return rows.select("l_orderkey").distinct().count() // 40


FREQUENT = (
    SETS
    + """, s1 AS (SELECT [item] AS items, count(*) AS n FROM b GROUP BY item HAVING count(*) >= (SELECT th FROM t)),
    s2 AS (SELECT [x.item, y.item] AS items, count(*) AS n FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= (SELECT th FROM t)),
    s3 AS (SELECT [x.item, y.item, z.item] AS items, count(*) AS n FROM b x JOIN b y ON x.tx = y.tx AND x.item < y.item JOIN b z ON z.tx = x.tx AND z.item > y.item GROUP BY x.item, y.item, z.item HAVING count(*) >= (SELECT th FROM t)),
    a AS (SELECT []::VARCHAR[] AS items, (SELECT count(DISTINCT tx) FROM b) AS n UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""
)


@query("frequent_itemsets", FREQUENT + " SELECT array_to_string(items, ',') AS items, n FROM a")
def frequent_itemsets(spark, sf_dir):
    """Sets of brands, of any size, in one order of 40 or more."""
    rows = baskets(spark, sf_dir)
    found = M.frequent_itemsets(rows, "l_orderkey", "p_brand", _threshold(rows))
    return found.select(F.array_join("items", ",").alias("items"), "n")


@query("closed_itemsets", FREQUENT + " SELECT array_to_string(items, ',') AS items, n FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.n = x.n AND len(y.items) = len(x.items) + 1 AND list_has_all(y.items, x.items))")
def closed_itemsets(spark, sf_dir):
    """G12"""
    rows = baskets(spark, sf_dir)
    found = M.frequent_itemsets(rows, "l_orderkey", "p_brand", _threshold(rows), "closed")
    return found.select(F.array_join("items", ",").alias("items"), "n")


@query("item_matrix", "SELECT o_custkey, max((o_orderstatus = 'F')::INTEGER) AS \"F\", max((o_orderstatus = 'O')::INTEGER) AS \"O\", max((o_orderstatus = 'P')::INTEGER) AS \"P\" FROM orders GROUP BY o_custkey")
def item_matrix(spark, sf_dir):
    """G10"""
    return M.one_hot_items(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("puzzle_path")
def puzzle_path(spark, sf_dir):
    """The boards of a shortest solution."""
    path = M.puzzle_path(3, 3, "2,-1,6,1,3,4,7,5,8", "1,2,3,4,5,6,7,8,-1", max_iter=10_000)
    return spark.createDataFrame([(i, b) for i, b in enumerate(path)], "step int, board string")


MOVES = """list_filter([CASE WHEN b >= 4 THEN b - 3 END, CASE WHEN b <= 6 THEN b + 3 END, CASE WHEN b % 3 <> 1 THEN b - 1 END, CASE WHEN b % 3 <> 0 THEN b + 1 END], lambda o: o IS NOT NULL)"""


@query(
    "puzzle_distances",
    f"""WITH RECURSIVE t(board, moves) AS (SELECT [1, 2, 3, 4, 5, 6, 7, 8, -1], 0 UNION
      SELECT list_transform(board, lambda v, i: CASE WHEN i = b THEN board[o] WHEN i = o THEN -1 ELSE v END), moves + 1
      FROM (SELECT board, moves, b, unnest({MOVES}) AS o FROM (SELECT board, moves, list_position(board, -1) AS b FROM t WHERE moves < 6)))
    SELECT array_to_string(board, ',') AS board, min(moves)::INTEGER AS moves FROM t GROUP BY board""",
)
def puzzle_distances(spark, sf_dir):
    """All boards within 6 moves."""
    return M.puzzle_distances(spark, 3, 3, "1,2,3,4,5,6,7,8,-1", 6)


COINS = """WITH RECURSIVE p AS (SELECT p_partkey, p_size FROM part), m(t, b) AS (SELECT 0, [0] UNION ALL SELECT t + 1, list_append(b, 1 + least(b[t + 1], CASE WHEN t >= 4 THEN b[t - 3] ELSE 1000 END, CASE WHEN t >= 9 THEN b[t - 8] ELSE 1000 END, CASE WHEN t >= 16 THEN b[t - 15] ELSE 1000 END)) FROM m WHERE t < 50),
    f AS (SELECT b FROM m WHERE t = 50)"""


@query("coin_change", COINS + " SELECT p_partkey, b[p_size + 1]::INTEGER AS coins FROM p, f")
def coin_change(spark, sf_dir):
    """The fewest coins of 1, 5, 10 and 17 for each part's size."""
    return table(spark, sf_dir, "part").select("p_partkey", M.fewest_coins(F.col("p_size"), [17, 10, 5, 1]).alias("coins"))


@query(
    "coin_breakdown",
    """WITH RECURSIVE m(t, b) AS (SELECT 0, [0] UNION ALL SELECT t + 1, list_append(b, 1 + least(b[t + 1], CASE WHEN t >= 4 THEN b[t - 3] ELSE 1000 END, CASE WHEN t >= 9 THEN b[t - 8] ELSE 1000 END, CASE WHEN t >= 16 THEN b[t - 15] ELSE 1000 END)) FROM m WHERE t < 50),
    f AS (SELECT b FROM m WHERE t = 50), w(p_partkey, remaining, coins) AS (SELECT p_partkey, p_size, []::INTEGER[] FROM part
      UNION ALL SELECT p_partkey, remaining - c, list_append(coins, c) FROM (SELECT p_partkey, remaining, coins,
        CASE WHEN remaining >= 17 AND b[greatest(remaining - 16, 1)] = b[remaining + 1] - 1 THEN 17 WHEN remaining >= 10 AND b[greatest(remaining - 9, 1)] = b[remaining + 1] - 1 THEN 10 WHEN remaining >= 5 AND b[greatest(remaining - 4, 1)] = b[remaining + 1] - 1 THEN 5 ELSE 1 END AS c
        FROM w, f WHERE remaining > 0))
    SELECT p_partkey, array_to_string(coins, '+') AS coins FROM w WHERE remaining = 0""",
)
def coin_breakdown(spark, sf_dir):
    """The coins themselves."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("+", M.coin_breakdown(F.col("p_size"), [17, 10, 5, 1]).cast("array<string>")).alias("coins"))


@query("coin_change_limited", COINS.replace(", CASE WHEN t >= 16 THEN b[t - 15] ELSE 1000 END", "") + " SELECT p_partkey, least(b[p_size + 1], CASE WHEN p_size >= 17 THEN b[p_size - 16] + 1 ELSE 1000 END)::INTEGER AS coins FROM p, f")
def coin_change_limited(spark, sf_dir):
    """G15 with one coin of 17 at most."""
    return table(spark, sf_dir, "part").select("p_partkey", M.fewest_coins(F.col("p_size"), [17, 10, 5, 1], 1).alias("coins"))
