import itertools
import random
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import mining as M
from quillon.operators import sampling
from quillon.queries import QUERIES


def test_bloom_has_no_false_negative(spark):
    reads = spark.createDataFrame(sampling.strands(1_000, 50, seed=123)).select("seq")
    bloom = M.Bloom(1_000, 0.001)
    bits = bloom.add(reads, "seq")
    assert bloom.has(reads, "seq", bits).where("not found").isEmpty()
    other = spark.createDataFrame(sampling.strands(2_000, 50, seed=9)).select("seq")
    assert bloom.has(other, "seq", bits).where("found").count() <= 20 and 0.3 < bloom.fill_ratio(bits) < 0.6
    with pytest.raises(IndexError):
        M.Bloom(10).add(reads, "seq")
    run = M.digest_hashes(1000, 40)
    assert run(b"x") == run(b"x") and len(run(b"x")) == 40 and max(run(b"x")) < 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=6), max_size=12))
def test_louds_trie(words):
    trie = M.LoudsTrie(words)
    assert sorted(trie) == sorted(set(words))
    for n in range(4):
        for p in map("".join, itertools.product("abc", repeat=n)):
            assert (trie.search(p) >= 0) == (p == "" or any(w.startswith(p) for w in words))
            assert (p in trie) == (p in words)


def test_bloom_grows_to_its_members(spark):
    keys, few = spark.range(500).selectExpr("id AS key"), spark.range(3).selectExpr("id AS key")
    bloom = M.Bloom(100, 0.001)
    assert bloom.grown(few) == bloom
    big = bloom.grown(keys, few)
    assert big.capacity == 800 and big.error_rate == 0.001
    bits = big.add(keys, "key")
    assert big.has(keys, "key", bits).where("found").count() == 500
    assert big.has(few, "key", M.bloom_intersection(bits, big.add(few, "key"))).where("found").count() == 3


@pytest.mark.parametrize("name", ["bloom_membership", "bloom_union", "bloom_intersection"])
def test_bloom_queries_take_any_number(spark, monkeypatch, name):
    made = M.Bloom
    monkeypatch.setattr(M, "Bloom", lambda capacity, rate: made(20, rate))
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() > 20 and found.where("not found").isEmpty()



def test_trie_rows(spark):
    words = ["car", "cart", "dog", "", "do", "dog", None]
    nodes = M.trie(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    assert M.louds_string(M.louds(nodes)) == M.LoudsTrie([w for w in words if w is not None]).bits
    asked = spark.createDataFrame([("ca",), ("cat",), ("dog",)], "q string")
    assert sorted(r.q for r in M.has_prefix(asked, "q", nodes).collect()) == ["ca", "dog"]
    assert [r.q for r in M.has_word(asked, "q", nodes).collect()] == ["dog"]


def test_debruijn_assembles_reads(spark):
    rng = random.Random(2)
    genome = "".join(rng.choice("ATGC") for _ in range(120))
    reads = spark.createDataFrame([(genome[i : i + 40],) for i in range(0, 81, 4)], "r string")
    nodes, edges = M.kmer_rows(reads, "r", 15), M.debruijn_edges(reads, "r", 15)
    starts = M.debruijn_sources(nodes, edges)
    assert [r.sequence for r in M.assemble(starts, nodes, 500).collect()] == [genome]
    assert "->" in M.edges_dot(edges)
    bloom = M.Bloom(200, 0.3)
    wrong = M.critical_false_positives(nodes, bloom, bloom.add(nodes, "kmer"))
    assert wrong.join(nodes, "kmer").isEmpty()


def test_assemble_query_follows_long_paths(spark, tmp_path):
    rng = random.Random(2)
    name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    assert len({name[i : i + 3] for i in range(58)}) == 58  # no fork, no k-mer twice
    spark.createDataFrame([(name,)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert [r.sequence for r in QUERIES["debruijn_assemble"](spark, str(tmp_path)).collect()] == [name]


def test_digest_places_are_those_of_the_digests(spark):
    keys = ["a", "", "é x", "Brand#12"]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    for bits, count in ((1000, 40), (1024, 5), (1 << 20, 7), (1 << 34, 3), (50, 1)):
        run, places = M.digest_hashes(bits, count), M.digest_places(bits, count)
        assert {r.k: r.p for r in df.select("k", places(F.col("k")).alias("p")).collect()} == {k: run(k.encode()) for k in keys} | {None: None}


def test_assemble_follows_every_fork(spark):
    nodes = spark.createDataFrame([(k,) for k in ("abc", "bcd", "bce", "cdx")], "kmer string")
    start = nodes.where("kmer = 'abc'")
    assert sorted(r.sequence for r in M.assemble(start, nodes).collect()) == ["abcdx", "abce"]
    ring = spark.createDataFrame([(k,) for k in ("aba", "bab", "abc")], "kmer string")
    first = ring.where("kmer = 'aba'")
    assert [r.sequence for r in M.assemble(first, ring).collect()] == ["ababc"]
    assert sorted(r.sequence for r in M.assemble(first, ring, 6).collect()) == ["abababa", "abababc", "ababc"]
    bloom = M.Bloom(100, 0.3)
    bits = bloom.add(nodes, "kmer")
    wrong = M.critical_false_positives(nodes, bloom, bits, "abcdex")
    known = lambda asked: bloom.has(asked, "kmer", bits).where("found").select("kmer")
    assert sorted(r.sequence for r in M.assemble(start, nodes, None, wrong, known).collect()) == ["abcdx", "abce"]


def brute_itemsets(tx, threshold, closed):
    items = sorted({i for t in tx for i in t})
    found = {}
    for n in range(len(items) + 1):
        for s in itertools.combinations(items, n):
            c = sum(set(s) <= t for t in tx)
            if c >= threshold:
                found[s] = c
    if closed:
        found = {s: c for s, c in found.items() if not any(set(s) < set(o) and c == d for o, d in found.items())}
    return found


@pytest.mark.parametrize("method", ["all", "closed"])
def test_itemsets_against_enumeration(spark, method):
    rng = random.Random(3)
    tx = [set(rng.sample("abcdefg", rng.randrange(1, 6))) for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, t in enumerate(tx) for x in t], "tx int, item string")
    got = {tuple(r["items"]): r.n for r in M.frequent_itemsets(df, "tx", "item", 6, method).collect()}
    assert got == brute_itemsets(tx, 6, method == "closed")
    with pytest.raises(KeyError):
        M.frequent_itemsets(df, "tx", "item", 6, "some")


@pytest.mark.parametrize("method", ["all", "closed"])
def test_itemset_queries_have_no_size_limit(spark, tmp_path, method):
    rng = random.Random(5)
    brands = ["a", "b", "c", "d", "e", "f"]
    tx = [{"a", "b", "c", "d", "e"} if i % 10 == 0 else set(rng.sample(brands, rng.randrange(1, 4))) for i in range(200)]
    spark.createDataFrame([(i, brands.index(x)) for i, t in enumerate(tx) for x in t], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    name = {"all": "frequent_itemsets", "closed": "closed_itemsets"}[method]
    got = {r["items"]: r.n for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = brute_itemsets(tx, 5, method == "closed")
    assert got == {",".join(s): n for s, n in want.items()} and max(map(len, want)) == 5


def breadth_first(start, goal):
    seen, queue = {start: 0}, deque([start])
    while queue:
        s = queue.popleft()
        if s == goal:
            return seen[s]
        b = s.index(-1)
        r, c = divmod(b, 3)
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            if 0 <= r + dr < 3 and 0 <= c + dc < 3:
                o = (r + dr) * 3 + c + dc
                t = list(s)
                t[b], t[o] = t[o], t[b]
                t = tuple(t)
                if t not in seen:
                    seen[t] = seen[s] + 1
                    queue.append(t)


@pytest.mark.parametrize("heuristic", ["manhattan", "misplaced"])
def test_puzzle_is_solved_in_fewest_moves(heuristic):
    goal = "1,2,3,4,5,6,7,8,-1"
    for start in ("2,-1,6,1,3,4,7,5,8", goal, "1,2,3,4,5,6,7,-1,8"):
        path = M.puzzle_path(3, 3, start, goal, heuristic, 100_000)
        as_tuple = lambda s: tuple(map(int, s.split(",")))
        assert path[0] == goal and path[-1] == start and len(path) - 1 == breadth_first(as_tuple(start), as_tuple(goal))
    assert M.puzzle_path(3, 3, "2,1,3,4,5,6,7,8,-1", goal, heuristic, 50) is None
    with pytest.raises(KeyError):
        M.puzzle_path(3, 3, goal, goal, "luck")


def test_puzzle_frontier(spark):
    found = {r.board: r.moves for r in M.puzzle_distances(spark, 3, 3, "1,2,3,4,5,6,7,8,-1", 4).collect()}
    goal = (1, 2, 3, 4, 5, 6, 7, 8, -1)
    assert all(breadth_first(tuple(map(int, b.split(","))), goal) == n for b, n in found.items()) and len(found) == 1 + 2 + 4 + 8 + 16


def brute_coins(total, coins, limit):
    best = {0: 0}
    free = coins if limit is None else coins[1:]
    for t in range(1, total + 1):
        best[t] = min((best.get(t - c, 10**9) for c in free), default=10**9) + 1
    if limit is None:
        return best[total] if best[total] < 10**9 else None
    found = min((best.get(total - coins[0] * k, 10**9) + k for k in range(limit + 1) if total >= coins[0] * k), default=10**9)
    return found if found < 10**9 else None


def test_coins(spark):
    coins = [17, 10, 5, 2]
    df = spark.createDataFrame([(t,) for t in (0, 1, 2, 3, 17, 34, 41, 99)], "t int")
    last = None
    for limit in (0, 1, 2, 4, None):
        got = {r.t: r.n for r in df.select("t", M.fewest_coins(F.col("t"), coins, limit).alias("n")).collect()}
        assert got == {t: brute_coins(t, coins, limit) for t in got}
        assert last is None or all(got[t] is None or last[t] is None or got[t] <= last[t] for t in got)
        last = got
    assert sum(k * v for k, v in M.breakdown(7332, [1000, 500, 100, 50, 10, 5, 1]).items()) == 7332 and M.breakdown(1, [2]) == {}


def test_one_hot_items(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "tx int, item string")
    assert sorted(tuple(r) for r in M.one_hot_items(df, "tx", "item").collect()) == [(1, 1, 1), (2, 0, 1)]


def test_running_sums_over_ranges(spark):
    from quillon.core.ordering import running_sum

    rows = [(k * 37 % 101, k % 5, None if k % 9 == 0 else k) for k in range(101)]
    df = spark.createDataFrame(rows, "a long, b int, n int").repartition(7)
    upto, want = 0, {}
    for place, (a, b, n) in enumerate(sorted(rows, key=lambda r: r[0])):
        upto += n or 0
        want[a] = (place + 1, upto)
    places = {r.a: r.upto for r in running_sum(df, ["a"]).collect()}
    sums = {r.a: r.s for r in running_sum(df, ["a"], F.col("n"), "s").collect()}
    assert places == {a: p for a, (p, _) in want.items()}
    assert {a: s or 0 for a, s in sums.items()} == {a: s for a, (_, s) in want.items()}
    assert sorted(r.upto for r in running_sum(df, ["b"]).collect()) == list(range(1, 102))
    assert running_sum(df.limit(0), ["a"]).collect() == []


def test_coins_themselves(spark):
    df = spark.range(0, 60).select(F.col("id").cast("int").alias("t"))
    for coins in ([17, 10, 5, 1], [7, 4], [3]):
        for r in df.select("t", M.coin_breakdown(F.col("t"), coins).alias("c")).collect():
            want = M.breakdown(r.t, coins)
            if r.t and not want:
                assert r.c is None
            else:
                assert sum(r.c) == r.t and {c: r.c.count(c) for c in r.c} == want


def test_louds_search_against_the_code(spark):
    words = ["ab", "abc", "b", "bca", "", "cab"]
    asked = ["", "a", "ab", "abc", "abcd", "b", "bc", "bca", "c", "ca", "cab", "d", None]
    held = M.LoudsTrie(words)
    coded = M.louds(M.trie(spark.createDataFrame([(w,) for w in words], "w string"), "w"))
    found = M.louds_search(spark.createDataFrame([(q,) for q in asked], "q string"), "q", coded).collect()
    assert {r.q: (r.node, r.place) for r in found} == {q: (-1, -1) if q is None else (held.node(q), held.search(q)) for q in asked}
