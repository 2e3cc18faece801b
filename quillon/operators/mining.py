"""Bloom filters, tries, de Bruijn graphs, frequent itemsets, puzzles and payments."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.core.ordering import running_sum
from quillon.core.scratch import stored
from quillon.functions import vectors as V

# -- Bloom filters: a filter is the table of its set bits (slice, bit)


@dataclass(frozen=True)
class Bloom:
    """Slices and bits of a filter for a number of members and a rate of false positives."""

    capacity: int
    error_rate: float = 1e-3

    @property
    def slices(self) -> int:
        return max(1, round(math.log2(1 / self.error_rate)))

    @property
    def bits(self) -> int:
        return round(self.capacity * abs(math.log(self.error_rate)) / (self.slices * math.log(2) ** 2))

    def places(self, item: Column) -> Column:
        """One bit number for each slice, from salted 64-bit hashes."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.slices - 1)), lambda i: F.pmod(F.xxhash64(i, item), F.lit(self.bits)))

    def grown(self, *members: DataFrame) -> Bloom:
        """This filter, or one of doubled capacity until each table's distinct items fit; the rate stays as it is.

        Filters that are to be united or intersected are grown together, since theirs must be equal.
        """
        most, capacity = max(df.distinct().count() for df in members), self.capacity
        while capacity < most:
            capacity *= 2
        return replace(self, capacity=capacity)

    def add(self, df: DataFrame, item: str) -> DataFrame:
        """The set bits of a table's items; more distinct items than the capacity are an error (IndexError)."""
        items = df.select(item).distinct()
        if items.count() > self.capacity:
            raise IndexError("the filter is at capacity")
        return items.select(F.posexplode(self.places(F.col(item))).alias("slice", "bit")).distinct()

    def has(self, df: DataFrame, item: str, bits: DataFrame, out: str = "found") -> DataFrame:
        """df's distinct items with whether every one of their bits is set: no member is missed."""
        asked = df.select(F.col(item).alias("_item")).distinct()
        long = asked.select("_item", F.posexplode(self.places(F.col("_item"))).alias("slice", "bit"))
        # a merge, as the planner takes bits for as small as the items they come from and broadcasts them
        hit = long.join(bits.withColumn("_on", F.lit(1)).hint("merge"), ["slice", "bit"], "left").groupBy("_item").agg((F.count("_on") == self.slices).alias(out))
        return hit.withColumnRenamed("_item", item)

    def fill_ratio(self, bits: DataFrame) -> float:
        return bits.count() / (self.slices * self.bits)


def bloom_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of filters of equal capacity and rate."""
    return a.union(b).distinct()


def bloom_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.hint("merge"), ["slice", "bit"], "left_semi").distinct()


def _digest_plan(bits: int, count: int) -> tuple[int, str, int]:
    """(bytes of a number, digest, numbers of a digest)."""
    width = 2 if bits <= 1 << 16 else 4 if bits <= 1 << 32 else 8
    algorithm = next((name for name in ("md5", "sha1", "sha256", "sha384", "sha512") if hashlib.new(name).digest_size >= width * count), "sha512")
    return width, algorithm, hashlib.new(algorithm).digest_size // width


def digest_hashes(bits: int, count: int) -> Callable[[bytes], list[int]]:
    """Count numbers below bits for a key, cut from salted cryptographic digests.

    The digest is the shortest of md5, sha1, sha256, sha384 and sha512 that holds all numbers, or the longest.
    """
    width, algorithm, per = _digest_plan(bits, count)

    def run(key: bytes) -> list[int]:
        out: list[int] = []
        salt = 0
        while len(out) < count:
            d = hashlib.new(algorithm, salt.to_bytes(4, "little") + key).digest()
            out += [int.from_bytes(d[i * width : (i + 1) * width], "little") % bits for i in range(per)]
            salt += 1
        return out[:count]

    return run


def digest_places(bits: int, count: int) -> Callable[[Column], Column]:
    """G03 as a column of arrays: the numbers of digest_hashes(), by Spark's own digests."""
    width, algorithm, per = _digest_plan(bits, count)
    digest = {"md5": F.md5, "sha1": F.sha1}.get(algorithm) or (lambda b: F.sha2(b, int(algorithm[3:])))

    def places(item: Column) -> Column:
        key = item.cast("string").cast("binary")
        codes = [digest(F.concat(F.unhex(F.lit(salt.to_bytes(4, "little").hex())), key)) for salt in range(-(-count // per))]

        def number(i: int) -> Column:
            code, at = codes[i // per], i % per * width
            low_first = F.concat(*(F.substring(code, 2 * (at + b) + 1, 2) for b in reversed(range(width))))
            return (F.conv(low_first, 16, 10).cast("decimal(20,0)") % F.lit(bits)).cast("long")

        return F.when(item.isNotNull(), F.array(*map(number, range(count))))

    return places


# -- tries: a node is a distinct prefix


def trie(df: DataFrame, word: str) -> DataFrame:
    """(prefix, parent, depth, is_word) of all words' prefixes, the empty one included."""
    w = F.coalesce(F.col(word), F.lit(""))
    rows = df.where(F.col(word).isNotNull()).select(w.alias("w")).distinct()
    long = rows.select("w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("depth"))
    nodes = long.select(F.substr("w", F.lit(1), F.col("depth")).alias("prefix"), "depth", (F.length("w") == F.col("depth")).alias("is_word"))
    found = nodes.groupBy("prefix", "depth").agg(F.max("is_word").alias("is_word"))
    return found.select("prefix", F.when(F.col("depth") > 0, F.substr("prefix", F.lit(1), F.col("depth") - 1)).alias("parent"), "depth", "is_word")


def has_prefix(df: DataFrame, query: str, nodes: DataFrame) -> DataFrame:
    """The queries that begin some word."""
    return df.join(nodes.select(F.col("prefix").alias("_p")), F.col(query) == F.col("_p"), "left_semi")


def has_word(df: DataFrame, query: str, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.where("is_word").select(F.col("prefix").alias("_p")), F.col(query) == F.col("_p"), "left_semi")


def louds(nodes: DataFrame) -> DataFrame:
    """(number, prefix, label, bits): nodes numbered from 1 in breadth-first order, children by character.

    A node's bits are a 1 for each child and a 0; the whole code begins with those of a super-root, '10'.
    """
    numbered = running_sum(nodes, ["depth", "prefix"], out="number").withColumn("number", F.col("number").cast("int"))
    degree = nodes.where("parent is not null").groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    label = F.when(F.col("depth") > 0, F.substr("prefix", F.col("depth"), F.lit(1))).otherwise("")
    bits = F.concat(F.repeat(F.lit("1"), F.coalesce("n", F.lit(0))), F.lit("0"))
    return numbered.join(degree, "prefix", "left").select("number", "prefix", "depth", label.alias("label"), bits.alias("bits"), "is_word")


def louds_search(df: DataFrame, query: str, coded: DataFrame) -> DataFrame:
    """(query, node, place) of each row: the number of the node that a prefix leads to and the place of its 1 in the code.

    Both are -1 where no word begins so. Before the 1 of node n lie n - 1 others and a zero for each node up to the
    parent's left neighbour and for the super-root, so the place is n - 1 and the parent's number.
    """
    parent = F.when(F.col("c.depth") > 0, F.substr("c.prefix", F.lit(1), F.col("c.depth") - 1))
    above = coded.select(F.col("prefix").alias("_above"), F.col("number").alias("_parent"))
    placed = coded.alias("c").withColumn("_up", parent).join(above, F.col("_up") == F.col("_above"), "left")
    placed = placed.select(F.col("c.prefix").alias("_prefix"), "number", (F.col("number") - 1 + F.coalesce("_parent", F.lit(0))).alias("_place"))
    found = df.select(query).join(placed, F.col(query) == F.col("_prefix"), "left")
    return found.select(query, F.coalesce("number", F.lit(-1)).alias("node"), F.coalesce("_place", F.lit(-1)).alias("place"))


def louds_string(coded: DataFrame) -> str:
    """The whole code of a small trie, gathered in order."""
    rows = coded.select("number", "bits").orderBy("number").collect()
    return "10" + "".join(r["bits"] for r in rows)


class LoudsTrie:
    """Navigation by rank and select over a LOUDS code held in memory."""

    def __init__(self, words: list[str]):
        prefixes = sorted({w[:k] for w in words for k in range(len(w) + 1)}, key=lambda p: (len(p), p)) or [""]
        children: dict[str, list[str]] = {p: [] for p in prefixes}
        for p in prefixes:
            if p:
                children[p[:-1]].append(p)
        self.bits = "10" + "".join("1" * len(children[p]) + "0" for p in prefixes)
        self.labels = ["", *(p[-1:] for p in prefixes)]  # by node number
        self.words = {i + 1 for i, p in enumerate(prefixes) if p in set(words)}
        self.ones, self.zeros = [], []
        for i, b in enumerate(self.bits):
            (self.ones if b == "1" else self.zeros).append(i)

    def children(self, node: int) -> range:
        """The numbers of a node's children: ones between two zeros, counted."""
        start = self.zeros[node - 1] + 1
        first = start - node + 1  # ones before start, and one more
        return range(first, first + self.zeros[node] - start)

    def node(self, prefix: str) -> int:
        """The number of a prefix's node, -1 if no word begins so."""
        at = 1
        for c in prefix:
            at = next((k for k in self.children(at) if self.labels[k] == c), -1)
            if at < 0:
                return -1
        return at

    def search(self, prefix: str) -> int:
        """The place of the node's 1 in the code, or -1."""
        node = self.node(prefix)
        return self.ones[node - 1] if node > 0 else -1

    def __contains__(self, word: str) -> bool:
        return self.node(word) in self.words

    def __iter__(self) -> Iterator[str]:
        stack = [(1, "")]
        while stack:
            node, prefix = stack.pop()
            if node in self.words:
                yield prefix
            stack += [(k, prefix + self.labels[k]) for k in reversed(self.children(node))]


# -- de Bruijn graphs


def kmer_rows(df: DataFrame, text: str, k: int) -> DataFrame:
    """Distinct k-mers of a column of reads."""
    from quillon.operators.strings import kmers

    return df.select(F.explode(kmers(F.coalesce(F.col(text), F.lit("")), k)).alias("kmer")).distinct()


def debruijn_edges(df: DataFrame, text: str, k: int) -> DataFrame:
    """(src, dst, n): neighbouring k-mers of a read, and how often they are."""
    from quillon.operators.strings import kmers

    long = df.select(F.explode(kmers(F.coalesce(F.col(text), F.lit("")), k + 1)).alias("e"))
    return long.select(F.substr("e", F.lit(1), F.lit(k)).alias("src"), F.substr("e", F.lit(2), F.lit(k)).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def debruijn_sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K-mers that no edge enters."""
    return nodes.join(edges.select(F.col("dst").alias("kmer")).distinct(), "kmer", "left_anti")


def extensions(nodes: DataFrame, alphabet: str = "ATGC") -> DataFrame:
    """(kmer, next) of every one-character extension to the right."""
    return nodes.select("kmer", F.explode(F.array(*map(F.lit, alphabet))).alias("c")).select("kmer", F.concat(F.substr("kmer", F.lit(2)), F.col("c")).alias("next"))


def critical_false_positives(nodes: DataFrame, bloom: Bloom, bits: DataFrame, alphabet: str = "ATGC") -> DataFrame:
    """Extensions that the filter takes for k-mers and that are none."""
    asked = extensions(nodes, alphabet).select(F.col("next").alias("kmer")).distinct()
    claimed = bloom.has(asked, "kmer", bits).where("found").select("kmer")
    return claimed.join(nodes, "kmer", "left_anti")


def assemble(starts: DataFrame, nodes: DataFrame, max_len: int | None = None, false_positives: DataFrame | None = None, known: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(start, sequence): every trail to the right of each start, along all extensions that are k-mers.

    All trails grow together: a step is one join of the frontier with the k-mers, and a trail that forks becomes several.
    A trail ends where no extension is left; with max_len it also ends once it is longer than that, and without it a
    k-mer seen before on the way is no extension, so that cycles end. There can be as many trails as forks multiply to.

    k-mers are looked up in nodes, or as a filter holds them: known(candidates) gives those of a column `kmer` that the
    filter claims, and false_positives those among them that are none.
    """
    alphabet = "".join(r[0] for r in nodes.select(F.explode(F.split("kmer", "")).alias("c")).where("c <> ''").distinct().orderBy("c").collect())
    frontier = starts.select(F.col("kmer").alias("start"), F.col("kmer").alias("last"), F.col("kmer").alias("sequence"), F.array("kmer").alias("seen"))
    done = None
    while True:
        asked = frontier.select("*", F.explode(F.array(*map(F.lit, alphabet))).alias("c")).withColumn("kmer", F.concat(F.substr("last", F.lit(2)), F.col("c")))
        asked = asked.where(~F.array_contains("seen", F.col("kmer")) if max_len is None else F.length("sequence") <= max_len)
        if known is None:
            hits = asked.join(nodes.select("kmer"), "kmer")
        else:
            hits = asked.join(known(asked.select("kmer").distinct()), "kmer").join(false_positives, "kmer", "left_anti")
        hits = stored(hits.select("start", "sequence", "kmer", "c", "seen"), "assemble")
        stopped = frontier.select("start", "sequence").join(hits.select("start", "sequence").distinct(), ["start", "sequence"], "left_anti")
        done = stopped if done is None else done.union(stopped)
        frontier = hits.select("start", F.col("kmer").alias("last"), F.concat("sequence", "c").alias("sequence"), F.concat("seen", F.array("kmer")).alias("seen"))
        if frontier.isEmpty():
            return done


# -- itemsets


def one_hot_items(df: DataFrame, tx: str, item: str) -> DataFrame:
    """One 0/1 column for each distinct item, named by it."""
    kinds = [r[0] for r in df.select(item).distinct().orderBy(item).collect()]
    return df.groupBy(tx).agg(*(F.max((F.col(item) == k).cast("int")).alias(str(k)) for k in kinds))


def frequent_itemsets(df: DataFrame, tx: str, item: str, threshold: int, method: str = "all", max_size: int | None = None) -> DataFrame:
    """(items, n) of the itemsets in `threshold` transactions or more, the empty set included.

    Level by level: sets of k + 1 items come from a set of k in the transaction and a later frequent item, so what
    is not frequent is never extended. 'closed' keeps the sets no larger set has the same count as.
    """
    if method not in ("all", "closed"):
        raise KeyError(f"{method!r} is no method; there are 'all' and 'closed'")
    rows = df.select(F.col(tx).alias("tx"), F.col(item).cast("string").alias("item")).where("tx is not null and item is not null").distinct()
    root = rows.select("tx").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.array().cast("array<string>").alias("items"), "n")
    good = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    rows = stored(rows.join(good.select("item"), "item"), "itemsets-rows")
    level = stored(rows.select("tx", F.array("item").alias("items")), "itemsets")
    out = [root.where(F.col("n") >= threshold)]
    size = 1
    while True:
        counts = level.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
        counts = stored(counts, "itemsets-level")
        if counts.isEmpty():
            break
        out.append(counts)
        if max_size is not None and size >= max_size:
            break
        kept = level.join(counts.select("items"), "items").withColumn("last", F.element_at("items", -1))
        level = stored(kept.join(rows, "tx").where(F.col("item") > F.col("last")).select("tx", F.concat("items", F.array("item")).alias("items")), "itemsets")
        size += 1
    found = out[0]
    for part in out[1:]:
        found = found.unionAll(part)
    if method == "closed":
        # a set is not closed if one with one item more has its count: each larger set names its subsets
        larger = found.where(F.size("items") > 0).select("n", F.explode("items").alias("without"), "items").select(F.filter("items", lambda x: x != F.col("without")).alias("items"), "n")
        found = found.join(larger.distinct(), ["items", "n"], "left_anti")
    return found


# -- puzzles and payments


def manhattan(state: tuple[int, ...], goal: tuple[int, ...], columns: int) -> int:
    at = {v: i for i, v in enumerate(goal)}
    return sum(abs(i // columns - at[v] // columns) + abs(i % columns - at[v] % columns) for i, v in enumerate(state) if v != -1)


def misplaced(state: tuple[int, ...], goal: tuple[int, ...], columns: int) -> int:
    return sum(a != b for a, b in zip(state, goal, strict=True) if a != -1)


def puzzle_path(rows: int, columns: int, start: str, goal: str, heuristic: str = "manhattan", max_iter: int = 100) -> list[str] | None:
    """The boards from goal back to start of a shortest solution of the sliding puzzle (blank -1), by A*.

    None if max_iter boards were opened without reaching the goal.
    """
    estimates = {"manhattan": manhattan, "misplaced": misplaced}
    if heuristic not in estimates:
        raise KeyError(f"{heuristic!r} is no heuristic; there are {', '.join(estimates)}")
    guess = estimates[heuristic]
    first, last = (tuple(int(x) for x in s.split(",")) for s in (start, goal))
    if sorted(first) != sorted(last) or len(first) != rows * columns:
        raise ValueError("boards must hold the same numbers and fill the grid")
    parent: dict[tuple[int, ...], tuple[int, ...] | None] = {first: None}
    cost = {first: 0}
    heap = [(guess(first, last, columns), 0, first)]
    opened = 0
    while heap:
        _, g, state = heapq.heappop(heap)
        if g > cost[state]:
            continue
        if state == last:
            out = []
            while state is not None:
                out.append(",".join(map(str, state)))
                state = parent[state]
            return out
        opened += 1
        if opened > max_iter:
            return None
        blank = state.index(-1)
        r, c = divmod(blank, columns)
        for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
            if 0 <= r + dr < rows and 0 <= c + dc < columns:
                other = blank + dr * columns + dc
                board = list(state)
                board[blank], board[other] = board[other], -1
                near = tuple(board)
                if g + 1 < cost.get(near, 1 << 60):
                    cost[near], parent[near] = g + 1, state
                    heapq.heappush(heap, (g + 1 + guess(near, last, columns), g + 1, near))
    return None


def puzzle_distances(spark: SparkSession, rows: int, columns: int, start: str, depth: int) -> DataFrame:
    """G14 as a frontier: (board, moves) of all boards within `depth` moves, a join against those seen before."""
    n = rows * columns

    def moves(board: Column) -> Column:
        blank = F.array_position(board, F.lit(-1)).cast("int") - 1
        swapped = lambda other: F.transform(board, lambda v, i: F.when(i == blank, F.element_at(board, other + 1)).when(i == other, F.lit(-1)).otherwise(v))
        ok = {-columns: blank >= columns, columns: blank < n - columns, -1: blank % columns > 0, 1: blank % columns < columns - 1}
        return F.filter(F.array(*(F.when(c, swapped(F.when(c, blank + F.lit(d)).otherwise(blank))) for d, c in ok.items())), lambda b: b.isNotNull())

    seen = spark.createDataFrame([([int(x) for x in start.split(",")], 0)], "board array<int>, moves int")
    frontier = seen
    for step in range(1, depth + 1):
        frontier = frontier.select(F.explode(moves(F.col("board"))).alias("board")).distinct().join(seen.select("board"), "board", "left_anti")
        frontier = stored(frontier.withColumn("moves", F.lit(step)), "puzzle")
        seen = stored(seen.unionAll(frontier), "puzzle-seen")
        if frontier.isEmpty():
            break
    return seen.select(F.array_join(F.transform("board", lambda v: v.cast("string")), ",").alias("board"), "moves")


def fewest_coins(total: Column, coins: list[int], limit: int | None = None) -> Column:
    """The fewest coins that make a total, at most `limit` of them of the first kind; null if none do.

    A fold over the amounts up to the total; unreachable amounts count as a large number.
    """
    never = 1 << 30
    free = coins if limit is None else coins[1:]

    def best(t: Column) -> Column:
        def step(acc: Column, amount: Column) -> Column:
            options = [F.when(amount >= c, F.coalesce(F.get(acc, amount - c), F.lit(never)) + 1).otherwise(F.lit(never)) for c in free]
            return F.concat(acc, F.array(F.least(F.lit(never), *options)))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(t, F.lit(1))), F.array(F.lit(0)), step)

    def chosen(table: Column) -> Column:
        if limit is None:
            return F.get(table, total)
        picks = [F.when(total >= coins[0] * k, F.get(table, total - F.lit(coins[0] * k)) + k).otherwise(F.lit(never)) for k in range(limit + 1)]
        return F.least(*picks) if len(picks) > 1 else picks[0]

    found = V.let(best(total), chosen)
    return F.when(total == 0, F.lit(0)).when(found < never, found)


def breakdown(total: int, coins: list[int]) -> dict[int, int]:
    """One fewest set of coins for a total, larger coins first among equals; empty if there is none."""
    best = [0] + [1 << 30] * total
    for amount in range(1, total + 1):
        best[amount] = min((best[amount - c] + 1 for c in coins if c <= amount), default=1 << 30)
    out: dict[int, int] = {}
    while total and best[total] < 1 << 30:
        c = next(c for c in sorted(coins, reverse=True) if c <= total and best[total - c] == best[total] - 1)
        out[c] = out.get(c, 0) + 1
        total -= c
    return out


def coin_breakdown(total: Column, coins: list[int]) -> Column:
    """The coins of breakdown() as an array, largest first among equals; null if there is none."""
    never, down = 1 << 30, sorted(coins, reverse=True)

    def step(acc: Column, amount: Column) -> Column:
        options = [F.struct((F.coalesce(F.get(acc, amount - c)["n"], F.lit(never)) + 1).alias("n"), F.lit(-c).alias("c")) for c in down]
        nothing = F.struct(F.lit(never).alias("n"), F.lit(0).alias("c"))
        fair = [F.when(amount >= -o["c"], o).otherwise(nothing) for o in options]
        return F.concat(acc, F.array(F.least(nothing, *fair) if len(fair) else nothing))

    def walk(table: Column) -> Column:
        start = F.struct(total.cast("int").alias("left"), F.array().cast("array<int>").alias("taken"))

        def back(acc: Column, _: Column) -> Column:
            coin = -F.get(table, acc["left"])["c"]
            return F.struct((acc["left"] - coin).alias("left"), F.concat(acc["taken"], F.array(coin)).alias("taken"))

        n = F.get(table, total)["n"]
        told = F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), F.lit(2), F.greatest(n, F.lit(0))), start, back)["taken"]
        return F.when(n < never, told)

    first = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("c")))
    table = F.aggregate(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), first, step)
    return F.when(total == 0, F.array().cast("array<int>")).otherwise(V.let(table, walk))


def edges_dot(edges: DataFrame) -> str:
    """A small graph as Graphviz text."""
    rows = edges.orderBy("src", "dst").collect()
    return "\n".join(["digraph g {", *(f'  "{r["src"]}" -> "{r["dst"]}";' for r in rows), "}"])
