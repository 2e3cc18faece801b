"""Suffix arrays and what follows from them, prefix arrays, repeats, run-length coding (Q11 to Q30, Q34).

Two forms. For strings of a table's short columns: expressions, windows and joins over (id, rank) rows, all in the
JVM. For long strings: numpy and Python kernels over one string at a time, prefix doubling instead of sorting
suffixes as text, for use in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V

END = "$"

# -- rows


def suffixes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Q12: (id, rank, sa, suffix): the suffixes of each text and its end mark, in order. The text must not hold the mark.

    Suffixes are sorted as text, which is quadratic in a text's length: for short columns. An empty text has the
    mark alone.
    """
    marked = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(END))
    rows = df.select(F.col(id_col), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(marked)), lambda i: F.substr(marked, i))).alias("sa", "suffix"))
    order = Window.partitionBy(id_col).orderBy("suffix")
    return rows.select(id_col, (F.row_number().over(order) - 1).alias("rank"), "sa", "suffix")


def bwt(ranked: DataFrame, id_col: str) -> DataFrame:
    """Q13: suffixes() with the character before each suffix (the end mark before the whole text)."""
    # windows rather than joins here and below: the planner takes suffixes for as small as their texts and broadcasts them
    whole = F.max(F.when(F.col("sa") == 0, F.col("suffix"))).over(Window.partitionBy(id_col))
    before = F.when(F.col("sa") == 0, F.lit(END)).otherwise(F.substr("_whole", F.col("sa"), F.lit(1)))
    return ranked.withColumn("_whole", whole).withColumn("bwt", before).drop("_whole")


def occurrences(ranked: DataFrame, id_col: str) -> DataFrame:
    """Q14: bwt() rows with occ, the number of equal characters up to the rank, and smaller, that of smaller characters in all."""
    upto = Window.partitionBy(id_col, "bwt").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(id_col).orderBy("bwt")
    return ranked.withColumn("occ", F.count(F.lit(1)).over(upto)).withColumn("smaller", (F.rank().over(before) - 1).cast("long"))


def last_to_first(with_occ: DataFrame) -> DataFrame:
    """Q15: occurrences() with lf, the rank of the suffix one longer."""
    return with_occ.withColumn("lf", (F.col("smaller") + F.col("occ") - 1).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """Q16: the length of two texts' common prefix."""
    n = F.least(F.length(a), F.length(b))
    alike = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k))
    return F.when(n == 0, F.lit(0)).otherwise(alike)


def lcp(ranked: DataFrame, id_col: str) -> DataFrame:
    """Q16: suffixes() with the common prefix of each suffix and the next in order, -1 for the last."""
    following = F.lead("suffix").over(Window.partitionBy(id_col).orderBy("rank"))
    return ranked.withColumn("_next", following).withColumn("lcp", F.when(F.col("_next").isNull(), F.lit(-1)).otherwise(common_prefix(F.col("suffix"), F.col("_next")))).drop("_next")


def lpf(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Q20: (id, sa, lpf): the longest prefix of the suffix at sa that also starts earlier in the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(id_col), F.posexplode(_lpf_array(t)).alias("sa", "lpf"))


def _lpf_array(t: Column) -> Column:
    n = F.length(t)
    at = lambda i: F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: j < i), lambda j: common_prefix(F.substr(t, j + 1), F.substr(t, i + 1)))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def factors(t: Column) -> Column:
    """Q21: the LZ77 factors of a text: each as long as the longest earlier match, or one character."""
    lengths = _lpf_array(t)
    def walk(ls: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        merge = lambda acc, i: F.when(
            acc["at"] == i,
            V.let(
                F.greatest(F.get(ls, i), F.lit(1)),
                lambda n: F.struct((i + n).alias("at"), F.concat(acc["out"], F.array(F.substr(t, i + 1, n))).alias("out")),
            ),
        ).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(0), F.size(ls) - 1), start, merge)["out"]

    return V.let(lengths, lambda ls: F.when(F.size(ls) == 0, F.array().cast("array<string>")).otherwise(walk(ls)))


def z_array(t: Column) -> Column:
    """Q17: at each place, the longest prefix of the text that starts there too; 0 at the first."""
    n = F.length(t)
    at = lambda i: F.when(i == 0, F.lit(0)).otherwise(common_prefix(t, F.substr(t, i + 1)))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def failure_array(t: Column) -> Column:
    """Q19: the longest proper border of each prefix, from the first place whose Z-match reaches the prefix's end."""

    def borders(z: Column) -> Column:
        reach = F.transform(z, lambda length, i: F.when((i > 0) & (length > 0), i + length))
        starts = lambda end: F.filter(F.sequence(F.lit(0), end), lambda i: F.get(reach, i) > end)
        return F.transform(z, lambda _, end: F.coalesce(end + 1 - F.get(starts(end), F.lit(0)), F.lit(0)))

    return F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(V.let(z_array(t), borders))


def prefix_matches(pattern: Column, t: Column) -> Column:
    """Q18: at each place of the text, how much of the pattern's beginning stands there."""
    n = F.length(t)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: common_prefix(pattern, F.substr(t, i + 1))))


def characters(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i, F.lit(1)))


def run_length(t: Column) -> Column:
    """Q22: aaab as a3b1... with a count of 1 left out; digits in the text cannot be told from counts."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(0).alias("n"))
    shown = lambda a: F.concat(a["out"], a["last"], F.when(a["n"] > 1, a["n"].cast("string")).otherwise(""))
    merge = lambda a, c: F.when(c == a["last"], F.struct(a["out"].alias("out"), a["last"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(F.struct(shown(a).alias("out"), c.alias("last"), F.lit(1).alias("n")))
    return F.when(F.length(t) == 0, F.lit("")).otherwise(F.aggregate(characters(t), start, merge, shown))


def run_length_decoded(t: Column) -> Column:
    """Q22: the reverse."""
    pairs = F.regexp_extract_all(t, F.lit(r"(\D)(\d*)"), F.lit(0))
    return F.array_join(F.transform(pairs, lambda p: F.repeat(F.substr(p, F.lit(1), F.lit(1)), F.when(F.length(p) == 1, F.lit(1)).otherwise(F.substr(p, F.lit(2)).try_cast("int")))), "")


def occurrences_of(ranked: DataFrame, queries: DataFrame, id_col: str, query: str) -> DataFrame:
    """Q24: (query, id, sa) of every place where a query starts, by the range of suffixes that begin with it.

    Queries meet suffixes that share their first character, then the prefix test decides. The queries go to every
    task, which never moves the suffixes.
    """
    asked = queries.select(F.col(query).alias("query")).where(F.length("query") > 0).distinct().withColumn("_first", F.substr("query", F.lit(1), F.lit(1)))
    keyed = ranked.withColumn("_first", F.substr("suffix", F.lit(1), F.lit(1)))
    return keyed.join(F.broadcast(asked), "_first").where(F.startswith("suffix", "query")).select("query", id_col, "sa")


def tandem_score(hits: DataFrame, id_col: str) -> DataFrame:
    """Q25: (query, id, score): the query's length times its longest chain of adjacent occurrences."""
    q = F.length("query")
    order = Window.partitionBy("query", id_col, F.pmod(F.col("sa"), q)).orderBy("sa")
    chained = hits.withColumn("_g", F.floor(F.col("sa") / q) - F.row_number().over(order)).withColumn("_m", F.pmod(F.col("sa"), q))
    runs = chained.groupBy("query", id_col, "_m", "_g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("query", id_col).agg(F.max(F.col("n") * F.length("query")).alias("score"))


def best_tandem(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Q26, Q28: (id, score, period, unit): the longest stretch that repeats a unit at least twice, whole units only.

    For every period p, places with t[i] = t[i + p] form runs; a run of r gives r div p + 1 units. Of equal scores
    the smallest period, then the first place. Texts without a repeat have score 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), t.alias("t")).distinct()
    at = base.select("id", "t", F.explode(F.when(F.length("t") > 1, F.sequence(F.lit(1), F.floor(F.length("t") / 2).cast("int")))).alias("p"))
    at = at.select("id", "t", "p", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("p"))).alias("i"))
    same = at.where(F.substr("t", F.col("i"), F.lit(1)) == F.substr("t", F.col("i") + F.col("p"), F.lit(1)))
    g = F.col("i") - F.row_number().over(Window.partitionBy("id", "p").orderBy("i"))
    runs = same.withColumn("_g", g).groupBy("id", "t", "p", "_g").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("r")).where("r >= p")
    scored = runs.select("id", F.struct((-(F.floor(F.col("r") / F.col("p")) + 1) * F.col("p")).alias("s"), "p", "i", F.substr("t", F.col("i"), F.col("p")).alias("unit")).alias("b"))
    best = scored.groupBy("id").agg(F.min("b").alias("b"))
    return base.select("id").join(best, "id", "left").select(F.col("id").alias(id_col), F.coalesce(-F.col("b.s"), F.lit(0)).cast("long").alias("score"), F.coalesce("b.p", F.lit(0)).alias("period"), F.coalesce("b.unit", F.lit("")).alias("unit"))


def kmers(t: Column, k: int) -> Column:
    """Q34: the k-mers of a text in order; none of a shorter text."""
    return F.when(F.length(t) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substr(t, i, F.lit(k))))


#: Fixed values (Q11): the pairs of bases; wobble adds G with U.
PAIRS = {"AT", "TA", "AU", "UA", "GC", "CG"}


def base_pair(a: Column, b: Column, wobble: bool = False) -> Column:
    """Q11"""
    found = F.concat(F.upper(a), F.upper(b)).isin(*sorted(PAIRS | ({"GU", "UG"} if wobble else set())))
    return F.coalesce(found, F.lit(False))


def segment_sum(r: Column, least: int) -> Column:
    """Q29: the greatest sum of a set of segments of at least `least` places each (none is 0).

    A fold over the places: the best with the place left out, and the best with an open segment for each length
    up to `least`.
    """
    floor = F.lit(float("-inf"))
    start = F.struct(F.lit(0.0).alias("out"), F.array_repeat(floor, least).alias("open"))

    def merge(acc: Column, x: Column) -> Column:
        # open[k]: a segment of k + 1 places ends here; the last stands for `least` places or more
        opened = F.array(acc["out"] + x)
        longer = F.transform(F.slice(acc["open"], 1, least - 1), lambda v: v + x) if least > 1 else F.array().cast("array<double>")
        grown = F.concat(opened, longer)
        ready = F.greatest(F.element_at(grown, -1), F.element_at(acc["open"], -1) + x)
        kept = F.concat(F.slice(grown, 1, least - 1), F.array(ready)) if least > 1 else F.array(F.greatest(acc["out"] + x, F.element_at(acc["open"], -1) + x))
        return F.struct(F.greatest(acc["out"], F.element_at(acc["open"], -1)).alias("out"), kept.alias("open"))

    return F.aggregate(r, start, merge, lambda a: F.greatest(a["out"], F.element_at(a["open"], -1)))


# -- long strings


def suffix_array(text: str) -> np.ndarray:
    """Q12 for a string of any length: prefix doubling, each round one sort of pairs of ranks; the end mark comes first."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes) + 1
    rank = np.zeros(n, np.int64)
    rank[:-1] = np.unique(codes, return_inverse=True)[1] + 1 if len(codes) else []
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


def lcp_array(text: str, sa: np.ndarray) -> np.ndarray:
    """Q16 by walking the places in text order: a common prefix shrinks by one at most from place to place."""
    t, n = text + END, len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    out, h = np.full(n, -1, np.int64), 0
    for i in range(n):
        r = rank[i]
        if r == n - 1:
            h = 0
            continue
        j = sa[r + 1]
        while i + h < n and j + h < n and t[i + h] == t[j + h]:
            h += 1
        out[r] = h
        h = max(0, h - 1)
    return out


def inverse_bwt(transform: str) -> str:
    """Q15: the text whose transform (with its end mark) is given."""
    codes = np.frombuffer(transform.encode("utf-32-le"), np.uint32)
    lf = np.empty(len(codes), np.int64)
    lf[np.lexsort((np.arange(len(codes)), np.where(codes == ord(END), 0, codes)))] = np.arange(len(codes))
    out, at = [], 0
    for _ in range(len(codes) - 1):
        out.append(transform[at])
        at = lf[at]
    return "".join(reversed(out))


def longest_previous(text: str, sa: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Q20 by text place: each place's nearest ranks with smaller places decide, found with one stack."""
    out = np.zeros(len(sa), np.int64)
    stack: list[tuple[int, int]] = []  # (place, common prefix with the entry below)
    for r in range(len(sa)):
        low = common[r - 1] if r else 0
        while stack and stack[-1][0] > sa[r]:
            place, below = stack.pop()
            out[place] = max(out[place], below, low)
            low = min(low, below)
        out[sa[r]] = max(out[sa[r]], low if stack else 0)
        stack.append((int(sa[r]), int(low if stack else 0)))
    while stack:
        place, below = stack.pop()
        out[place] = max(out[place], below)
    return out[: len(text)]


def z_of(text: str) -> list[int]:
    """Q17, Q19 in linear time, by the match that reaches furthest."""
    n = len(text)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def failure(pattern: str) -> list[int]:
    """Q19: the longest proper border of each prefix."""
    out = [0] * len(pattern)
    k = 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = out[k - 1]
        k += pattern[i] == pattern[k]
        out[i] = k
    return out


def text_index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Q23: (id, n, sa, bwt, lcp, lpf, z) arrays of whole texts of any length; end marks in the text are replaced by a space."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                out = []
                for t in part.column(1).to_pylist():
                    t = (t or "").replace(END, " ")
                    sa = suffix_array(t)
                    common = lcp_array(t, sa)
                    whole = t + END
                    out.append((len(t), sa.tolist(), "".join(whole[i - 1] if i else END for i in sa), common.tolist(), longest_previous(t, sa, common).tolist(), z_of(t)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                ints = pa.list_(pa.int32())
                kinds = [pa.int64(), ints, pa.string(), ints, ints, ints]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_col, "n", "sa", "bwt", "lcp", "lpf", "z"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n long, sa array<int>, bwt string, lcp array<int>, lpf array<int>, z array<int>")


def find(sa: np.ndarray, text: str, query: str) -> list[int]:
    """Q24: all places of a query, in suffix order, by two binary searches over the suffix array."""
    whole, m = text + END, len(query)

    def bound(after: bool) -> int:
        low, high = 0, len(sa)
        while low < high:
            mid = (low + high) // 2
            head = whole[sa[mid] : sa[mid] + m].replace(END, "")
            if head < query or (after and head == query):
                low = mid + 1
            else:
                high = mid
        return low

    return [int(i) for i in sa[bound(False) : bound(True)]] if m else []


def to_tsv(ranked: DataFrame, path: str) -> None:
    """Q27: an index as tab-separated files."""
    ranked.write.option("sep", "\t").option("header", True).csv(path)
