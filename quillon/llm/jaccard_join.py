"""Near-duplicate join: documents whose word n-gram sets have a Jaccard similarity of a threshold or more.

1. Sign: every text becomes its set of n-gram hashes, a 128-bit name of that set, MinHash bands and a sketch, one
   byte of each MinHash. Rows of an Arrow batch with the same set share one entry; only entries go on. Bands and
   rows are chosen for a target recall at the threshold.
2. Band: representatives (one for each set) meet by band hash. Within a bucket sketches are compared, and only
   members whose sketches agree as often as a pair at the threshold does are joined: chance meetings, however many,
   do not chain unlike texts together. A bucket gives a spanning forest of edges, not its pairs, and a large one is
   dealt as pairs of blocks; connected components of the forests are the units of verification.
3. Verify: texts move once, to their component. All pairs of a component are compared on their full n-gram sets
   by an inverted index in memory, and only counts and a spanning forest come out. A component too large for
   one task is dealt as pairs of blocks, so that no task holds more than two blocks.
4. Name: components of the verified links are the classes.

Pairs are never rows. A group of m different near copies costs m * m / 2 set comparisons, since its links are
counted exactly, but m rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import small, stored, tidied

#: Members, and n-grams in all, of a block of a component.
BLOCK_ROWS, BLOCK_GRAMS = 2_000, 4_000_000
#: Members of a block of a band bucket, and sketches that are compared with all others at a time.
BUCKET_ROWS, SKETCHES = 4_000, 256
#: The side of a member whose block is compared with itself; 0 and 1 are the two blocks of a pair.
WITHIN = 2
#: Words that a worker remembers the hashes of before it starts afresh.
REMEMBERED = 200_000
MAX = np.uint64(2**64 - 1)


def banding(threshold: float, recall: float, most_hashes: int = 80) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands reach the recall at the threshold within most_hashes hashes.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands. More rows mean fewer chance
    meetings. If even one row needs more hashes than that, one row with as many bands as it takes.
    """
    found = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            found = (bands, rows)
    return found or (math.ceil(math.log(1 - recall) / math.log1p(-threshold)), 1)


def least_agreement(hashes: int, threshold: float, missed: float) -> int:
    """The most agreeing MinHashes of so many that a pair at the threshold falls short of with probability missed at most."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.exp(math.lgamma(hashes + 1) - math.lgamma(k + 1) - math.lgamma(hashes - k + 1) + k * math.log(threshold) + (hashes - k) * math.log1p(-threshold)) if threshold < 1 else float(k == hashes)
        if below > missed:
            return k
    return hashes


_WORDS: dict[bytes, int] = {}


def grams(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams; a text of fewer words is one gram, without words none."""
    split = (text or "").encode("utf-8").split()
    if not split:
        return np.empty(0, np.uint64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    known, digest = _WORDS, xxhash.xxh3_64_intdigest
    hashes = []
    for w in split:
        h = known.get(w)
        if h is None:
            h = known[w] = digest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    size = min(n, len(h))
    count = len(h) - size + 1
    with np.errstate(over="ignore"):
        g = np.full(count, size, np.uint64)
        for k in range(size):
            g = (g ^ h[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
    return np.unique(g)


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n multiply-add hash functions, the same in every worker."""
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(found: np.ndarray, n: int) -> np.ndarray:
    """The MinHash signature of a set of gram hashes: its least value under each of n hash functions."""
    a, b = _functions(n)
    low = np.full(n, MAX)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2_048):
            part = found[at : at + 2_048]
            low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return low


def folded(low: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit hash for each band of a signature."""
    with np.errstate(over="ignore"):
        out = np.zeros(bands, np.uint64)
        for r in range(rows):
            out = (out ^ low[r::rows][:bands]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


def band_hashes(found: np.ndarray, bands: int, rows: int) -> list[int]:
    """folded() of the signature of a set of gram hashes."""
    return folded(minima(found, bands * rows), bands, rows)


def sketch(low: np.ndarray) -> bytes:
    """One byte for each value of a signature: equal values have equal bytes, others in one case of 256."""
    with np.errstate(over="ignore"):
        return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sign(n: int, bands: int, rows: int, all_texts: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                uids, entries, names, counts, banded, sketches, texts = [], [], [], [], [], [], []
                first: dict[bytes, int] = {}
                same: dict[str | None, tuple[bytes, int]] = {}
                for text in part.column(1).to_pylist():
                    known = same.get(text)
                    found = None
                    if known is None:
                        found = grams(text, n)
                        known = same[text] = (hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found))
                    name, size = known
                    entry = first.setdefault(name, uid)
                    uids.append(uid)
                    entries.append(entry)
                    counts.append(size)
                    names.append(name if entry == uid else None)
                    low = minima(found, bands * rows) if entry == uid and size else None
                    banded.append(None if low is None else folded(low, bands, rows))
                    sketches.append(None if low is None else sketch(low))
                    texts.append(text if all_texts or (entry == uid and size) else None)
                    uid += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids, pa.int64()), part.column(0), pa.array(entries, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(banded, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(texts, pa.string()), *part.columns[2:]],
                    ["uid", "id", "entry", "name", "n_grams", "bands", "sketch", "text", *(f"c{i}" for i in range(part.num_columns - 2))],
                )

    return run


def alike(sketches: list[bytes], left: int, least: int) -> np.ndarray:
    """For each sketch, the first one that it is joined with by pairs of at least `least` equal bytes.

    If left is not 0, only pairs of one of the first `left` sketches and one of the others are looked at.
    """
    m = len(sketches)
    every = np.frombuffer(b"".join(sketches), np.uint8).reshape(m, -1)
    label = np.arange(m)
    if m == 2:
        return np.zeros(2, np.int64) if np.count_nonzero(every[0] == every[1]) >= least else label
    across = np.ascontiguousarray(every.T)
    end = left or m
    for at in range(0, end, SKETCHES):
        upto, low = min(end, at + SKETCHES), left or at
        agree = np.zeros((upto - at, m - low), np.uint8 if len(across) < 256 else np.uint32)
        for place in across:
            agree += place[at:upto, None] == place[None, low:]
        near = agree >= least
        for i in range(at, upto):
            met = np.append(label[low:][near[i - at]], label[i])
            first = met.min()
            if first != met.max():
                renamed = np.arange(m)
                renamed[met] = first
                label = renamed[label]
    return label


def _meet(least: int):
    """(unit, side, rep, sketch) sorted by unit and side -> (a, b), a < b: a spanning forest of each unit's alike members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, reps, sides, sketches = None, [], [], []
        low, high = [], []

        def settle() -> None:
            whole = bool(sides) and sides[0] == WITHIN
            left = 0 if whole else sides.count(0)
            if len(reps) > 1 and (whole or 0 < left < len(reps)):
                label = alike(sketches, left, least)
                for i in np.flatnonzero(label != np.arange(len(reps))).tolist():
                    x, y = reps[label[i]], reps[i]
                    low.append(min(x, y))
                    high.append(max(x, y))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

        for batch in batches:
            for key, side, rep, drawn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != unit:
                    settle()
                    unit, reps, sides, sketches = key, [], [], []
                reps.append(rep)
                sides.append(side)
                sketches.append(drawn)
            if low:
                yield told()
                low, high = [], []
        settle()
        if low:
            yield told()

    return run


def _dealt(placed: DataFrame, group: str) -> DataFrame:
    """placed (with blocks, and the block of each member) once for each pair of blocks of its group, with unit and side.

    A member of block i serves the pairs (i, j): as the first side if i <= j, as the second if i > j.
    """
    copies = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), WITHIN).otherwise((F.col("block") > F.col("other")).cast("int"))
    return copies.withColumn("unit", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", side)


def _block() -> Column:
    return F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b) edges, a < b -> (node, root): each node's component, named by its smallest node.

    Large-star and small-star steps by turns, which reach stars in a logarithmic number of rounds whatever the
    shape. Each round's edges are written to the shared folder, so the plan stays short and a lost executor
    costs one round. Joins are on the node and split by Spark where one node has many edges.
    """
    now = stored(edges.where("a < b").distinct(), name)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # a table of its own, so that Spark may split the side of a node with very many neighbours
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(least, "u").where("v > u and m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).union(small_least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        after = stored(small.distinct(), name)
        changed = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def linked(sets: list[np.ndarray], left: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the later sets that are similar to it, by an inverted index over all sets.

    If left is not 0, only pairs of one of the first `left` sets and one of the others are looked at.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    owner = owner[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(ranked))
    group = np.empty(len(ranked), np.int64)
    group[order] = np.cumsum(fresh) - 1
    lengths = ends - starts
    at = 0
    for i, size in enumerate(sizes):
        own = group[at : at + size]
        at += size
        if left and i >= left:
            break
        own = own[lengths[own] > 1]
        if not len(own):
            continue
        shared = np.zeros(len(sets), np.int64)
        for first in range(0, len(own), 1_024):  # bounds the postings that are laid out at once
            mine = own[first : first + 1_024]
            n = lengths[mine]
            places = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared += np.bincount(owner[places], minlength=len(sets))
        low = max(i + 1, left)
        inter = shared[low:]
        near = np.flatnonzero(inter >= threshold * (size + sizes[low:] - inter) - 1e-9) + low
        if len(near):
            yield i, near


def _verify(n: int, threshold: float):
    """(unit, side, rep, weight, text) sorted by unit and side -> (rep, root, links, text_links) of each unit."""

    def settle(reps: list[int], weights: list[int], sides: list[int], sets: list[np.ndarray]) -> tuple[list, ...]:
        parent = list(range(len(reps)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        left = sides.count(0)
        whole = sides[0] == WITHIN
        weight = np.array(weights)
        links, texts = np.zeros(len(reps), np.int64), np.zeros(len(reps), np.int64)
        for i, near in linked(sets, left, threshold) if whole or 0 < left < len(sides) else ():
            links[i] += weight[near].sum()
            texts[i] += len(near)
            links[near] += weight[i]
            texts[near] += 1
            for j in near.tolist():
                x, y = find(i), find(j)
                if x != y:
                    keep, drop = (x, y) if reps[x] < reps[y] else (y, x)
                    parent[drop] = keep
        return reps, [reps[find(i)] for i in range(len(reps))], links.tolist(), texts.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [], [], [])

        def told() -> pa.RecordBatch:
            columns = settle(*held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "root", "links", "text_links"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, side, rep, weight, text in zip(*columns, strict=True):
                if key != unit:
                    if held[0]:
                        yield told()
                    unit, held = key, ([], [], [], [])
                held[0].append(rep)
                held[1].append(weight)
                held[2].append(side)
                held[3].append(grams(text, n))
        if held[0]:
            yield told()

    return run


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """key, class_id, class_size, links, text_links, kept for every row of df.

    Words are runs of characters other than space and tab to carriage return, compared as they are; a text of
    one to n - 1 words is one gram. links counts the other rows of similarity threshold or more (copies
    included), text_links the other n-gram sets. class_id is the smallest key of a component of links (null only
    if all its keys are), and kept marks one row with that key. A null, empty or blank text has no grams and no
    links and is a class of its own row. Other columns of df are not read; an empty table gives no rows.

    Sets are compared exactly, as sets of 64-bit gram hashes; a pair at the threshold itself is found with
    probability `recall`, a pair above it with more.
    """
    _, told = _classes(df, key, text, threshold, n, recall, [])
    return told.select(
        F.col("id").alias(key),
        F.col("stays.id").alias("class_id"),
        F.col("class_size").cast("long").alias("class_size"),
        F.col("links").cast("long").alias("links"),
        F.col("text_links").cast("long").alias("text_links"),
        (F.col("uid") == F.col("stays.uid")).alias("kept"),
    )


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row of df for each class of join(), the one with the smallest key, with all its columns.

    The rows that go are named, and they are usually few: then the texts stay where they are.
    """
    others = [c for c in df.columns if c not in (key, text)]
    rows, told = _classes(df, key, text, threshold, n, recall, others or [key])
    gone = stored(told.where("uid <> stays.uid").select("uid"), "jaccard-gone")
    names = {key: F.col("id"), text: F.col("text")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return rows.join(small(gone), "uid", "left_anti").select(*(names[c].alias(c) for c in df.columns))


def _classes(df: DataFrame, key: str, text: str, threshold: float, n: int, recall: float, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows, with the carried columns, and for each row (uid, id, entry, stays, class_size, links, text_links)."""
    missed = (1 - recall) / 2  # by the bands, and as much again by the sketches
    bands, rows_ = banding(threshold, 1 - missed)
    least = least_agreement(bands * rows_, threshold, missed)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"uid long, id {kind[key]}, entry long, name binary, n_grams long, bands array<bigint>, sketch binary, text string", *(f"c{i} {kind[c]}" for i, c in enumerate(carry))])
    taken = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    rows = stored(taken.mapInArrow(tidied(_sign(n, bands, rows_, bool(carry))), schema), "jaccard-rows")

    counts = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    entries = rows.where("name is not null and n_grams > 0").select("entry", "name", "n_grams").join(counts, "entry")
    named = entries.groupBy("name").agg(F.min("entry").alias("rep"), F.sum("n").alias("weight"), F.max("n_grams").alias("n_grams"))
    reps = stored(entries.select("entry", "name").join(named, "name").select("entry", "rep", "weight", "n_grams"), "jaccard-reps")

    heads = reps.where("entry = rep")
    banded = rows.where("bands is not null").select(F.col("uid").alias("rep"), "bands").join(heads.select("rep"), "rep")
    met = banded.select("rep", F.posexplode("bands").alias("band", "hash")).select("rep", F.xxhash64("band", "hash").alias("hash"))
    buckets = met.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = met.join(buckets, "hash").select("hash", "rep", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks"))
    sketched = members.join(rows.where("sketch is not null").select(F.col("uid").alias("rep"), "sketch"), "rep")
    compared = _dealt(sketched.withColumn("block", _block()), "hash").select("unit", "side", "rep", "sketch").repartition("unit").sortWithinPartitions("unit", "side", "rep")
    forests = compared.mapInArrow(tidied(_meet(least)), "a long, b long")
    units = components(forests, "jaccard-candidates")

    found = units.withColumnRenamed("node", "rep").join(heads.select("rep", "weight", "n_grams"), "rep")
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("all_grams"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("all_grams") / BLOCK_GRAMS)).cast("int")
    placed = found.join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("block", _block())
    dealt = _dealt(placed, "root").select("unit", "side", "rep", "weight")
    texts = rows.where("name is not null and n_grams > 0").select(F.col("uid").alias("rep"), "text")
    checked = dealt.join(texts, "rep").select("unit", "side", "rep", "weight", "text").repartition("unit").sortWithinPartitions("unit", "side", "rep")
    told = stored(checked.mapInArrow(tidied(_verify(n, threshold)), "rep long, root long, links long, text_links long"), "jaccard-links")

    degrees = told.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    classes = components(told.select(F.col("root").alias("a"), F.col("rep").alias("b")), "jaccard-classes")

    answer = (
        reps.join(degrees, "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "entry",
            F.coalesce("root", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("text_links", F.lit(0)).alias("text_links"),
        )
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))).alias("least")
    heads_of = rows.where("n_grams > 0").groupBy("entry").agg(first, F.count(F.lit(1)).alias("n")).join(answer, "entry")
    stays = heads_of.groupBy("root").agg(F.min("least").alias("stays"), F.sum("n").alias("class_size"))
    settled = heads_of.join(stays, "root").select("entry", "stays", "class_size", "links", "text_links")
    alone = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    with_grams = rows.where("n_grams > 0").select("uid", "id", "entry").join(settled, "entry")
    without = rows.where("n_grams = 0").select("uid", "id", "entry", alone.alias("stays"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("text_links"))
    return rows, with_grams.select(without.columns).union(without)


#: All pairs that share an n-gram, with no candidates, for tables of some thousand rows.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS name FROM g GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS MATERIALIZED (
  SELECT a, b, x.name AS of_a, y.name AS of_b FROM shared s JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE s.n >= 0.8::DOUBLE * (x.n + y.n - s.n) - 1e-9::DOUBLE
), walk(id, root) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT b, root FROM walk JOIN linked ON a = id WHERE root < b
), classes AS (
  SELECT id, min(root) AS class_id FROM walk GROUP BY id
), degrees AS (
  SELECT a, count(*) AS links, count(DISTINCT of_b) FILTER (of_b <> of_a) AS text_links FROM linked GROUP BY a
)
SELECT id AS doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, coalesce(links, 0) AS links, coalesce(text_links, 0) AS text_links, id = class_id AS kept
FROM classes LEFT JOIN degrees ON a = id
"""
