"""Mixing sources to target weights, by a splitting tree over exact block quotas.

A source's documents, in a fixed pseudo-random order, form a stream of words, cut into blocks of equal length. The
blocks are put in a second pseudo-random order, and their words summed up along it: whole passes over all blocks, then
the blocks of one more pass until the source's target is met, make its quota, a whole number of blocks (of the last
one the first words only). The output shards are the leaves of a binary tree: at each node the blocks that go left are
a multivariate-hypergeometric draw from the node's quotas, so that every shard gets its exact share of blocks, and
every source exactly its quota over all shards. A shard then owns a range of each source's permuted blocks: ranges do
not overlap, so no block is drawn twice in a pass. What is taken of a document is what the blocks that shards drew hold
of it, and rows are shuffled inside a shard by a hash.

The tree sees one number for each source and shard, on the driver: sources are meant to be few (they are named to be
given weights). Rows and blocks see their places in both orders, which are two-level prefix sums: sums of 4,096 runs of
each source, then sums inside a run, so no task holds a whole source. Places and quotas are whole numbers of 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._shared import stored, words

#: Nothing is taken more often than this.
MOST = 3
#: Hex digits of a row's digest that name its run.
RUN_DIGITS = 3
#: Words of an output shard, if their number is not given, and the least number of shards.
SHARD_WORDS, LEAST_SHARDS = 1 << 25, 16


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share all words. A target stops at MOST
    times the source's size, and the excess is shared again by weight until none is above: in the end every
    target is min(MOST * size, level * weight) for one level, found by taking sources in the order in which a
    rising level would stop them. One row for each source; without words all targets are 0.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST)
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("stopped")).cast("double") / F.col("sharing").cast("double"))
        .withColumn("place", F.row_number().over(rising))
    )
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(reached, F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard: rows add up to the quotas, columns differ by one at most.

    A node that serves several shards sends floor(total * left / all) blocks left, a draw without replacement
    from its quotas (source by source, each hypergeometric given what is left), and the others right.
    """
    out = np.zeros((len(quotas), n_shards), dtype=np.int64)
    rng = np.random.default_rng(seed)
    todo = [(quotas.astype(np.int64), 0, n_shards)]
    while todo:
        own, first, shards = todo.pop()
        if shards == 1:
            out[:, first] = own
            continue
        half = shards // 2
        rest, want = int(own.sum()), int(own.sum()) * half // shards
        left = np.zeros_like(own)
        for s, n in enumerate(own):
            rest -= int(n)
            left[s] = _hypergeometric(rng, int(n), rest, want)
            want -= int(left[s])
        todo += [(left, first, half), (own - left, first + half, shards - half)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` from good + bad are good: the inverse of the distribution function, for counts of any size.

    Probabilities follow from their ratios, 12 standard deviations and 40 counts around the mode (all counts, if there
    are fewer); what lies beyond has less than 1e-30. The same rule serves every size; 1e10 blocks make 1e6 numbers.
    """
    least, most = max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    whole = good + bad
    mode = (draws + 1) * (good + 1) // (whole + 2)
    reach = math.ceil(12 * math.sqrt(draws / whole * good * (bad / whole) * ((whole - draws) / max(1, whole - 1)))) + 40
    first, last = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(first, last, dtype=float)
    rise = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(k + (bad - draws + 1))
    logs = np.concatenate([[0.0], np.cumsum(rise)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right").clip(0, last - first))


def _ordered(rows: DataFrame, amounts: dict[str, str], ties: list[str]) -> DataFrame:
    """rows with, for each (sum, column) of amounts, the sum of the column over the rows before, by _s in the order of _digest and ties.

    Two levels: the runs of a source (rows whose digests begin alike), and the rows of a run.
    """
    rows = rows.withColumn("_run", F.substring("_digest", 1, RUN_DIGITS))
    before = Window.partitionBy("_s").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_s", "_run").agg(*(F.sum(c).alias(f"_sum{i}") for i, c in enumerate(amounts.values())))
    sums = sums.select("_s", "_run", *(F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in range(len(amounts))))
    inside = Window.partitionBy("_s", "_run").orderBy("_digest", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i, c in enumerate(amounts.values()):
        rows = rows.withColumn(f"_within{i}", F.sum(c).over(inside) - F.col(c))
    rows = rows.join(sums, ["_s", "_run"])
    for i, name in enumerate(amounts):
        rows = rows.withColumn(name, F.col(f"_start{i}") + F.col(f"_within{i}"))
    return rows.drop("_run", *(f"_{kind}{i}" for kind in ("start", "within") for i in range(len(amounts))))


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    n_shards: int | None = None,
    block_words: int = 4_096,
    seed: int = 8,
    whole: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """key, source, size, source_size, target, taken, draws and the carried columns, one row for each row of df.

    size is the number of words of the text (null: 0). Without n_shards there are as many shards as give each
    SHARD_WORDS words, LEAST_SHARDS at least. draws has a struct (pass, block, words, shard, place) for each
    time that a shard draws a block with words of the row; taken is the sum of their words. Each source's taken words
    add up to its rounded target exactly: of the block at which the last pass ends the first words are taken only.
    With whole, documents are never cut: one belongs to the block of its first word, and in that last block it is taken
    if half of it or more would be, so a source may be off by half a document.

    Reruns agree: places follow from key and text alone; rows equal in both are interchangeable. A null key is a key, a
    null source a source (the last). An empty table gives no rows, one without words no draws.
    """
    keyed = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    carried = [c for c in carry if c not in (key, source)]
    measured = df.select(
        F.monotonically_increasing_id().alias("_uid"),
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_s"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), keyed, body).cast("binary")).alias("_digest"),
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)),
    )
    measured = stored(measured, "mix-rows")
    placed = _ordered(measured.select("_uid", "_s", "size", "_digest"), {"_at": "size"}, ["size"])
    placed = stored(placed, "mix-places")
    totals = measured.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumnRenamed("_source", "source")
    aims = [r.asDict() for r in targets(totals).orderBy(F.col("source").asc_nulls_last()).collect()]  # one row a source
    for a in aims:
        a |= {"_s": "" if a["source"] is None else "=" + a["source"], "_aim": round(a["target"])}

    # the blocks of each source, and what each row has in them
    if whole:
        pieces = placed.where("size > 0").selectExpr("_uid", "_s", "_digest", f"_at DIV {block_words} AS _block", "_at AS _from", "size AS _words")
    else:
        spread = placed.where("size > 0").selectExpr("_uid", "_s", "_digest", "size", "_at", f"explode(sequence(_at DIV {block_words}, (_at + size - 1) DIV {block_words})) AS _block")
        spread = spread.withColumn("_from", F.greatest("_at", F.col("_block") * block_words))
        pieces = spread.withColumn("_words", F.least(F.col("_at") + F.col("size"), (F.col("_block") + 1) * block_words) - F.col("_from")).drop("size", "_at")
    blocks = pieces.groupBy("_s", "_block").agg(F.sum("_words").alias("_held"), F.min("_from").alias("_begins"))
    blocks = blocks.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(f"block:{seed}"), "_block", "_s").cast("binary")))
    blocks = _ordered(blocks.withColumn("_one", F.lit(1).cast("long")), {"_rank": "_one", "_sum": "_held"}, ["_block"]).drop("_one")
    blocks = stored(blocks.join(_rows(df, aims, {"_s": "string", "_aim": "long", "source_size": "long"}), "_s"), "mix-blocks")

    # quotas, and the tree that deals them to shards
    rest = F.when(F.col("source_size") > 0, F.col("_aim") % F.greatest(F.col("source_size"), F.lit(1))).otherwise(0)
    counts = {r._s: (r.n, r.more) for r in blocks.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_sum") < rest).cast("long")).alias("more")).collect()}
    for a in aims:
        n, more = counts.get(a["_s"], (0, 0))
        a |= {"_n": n, "_full": a["_aim"] // max(1, a["source_size"]), "_rest": a["_aim"] % max(1, a["source_size"])}
        a["_quota"] = a["_full"] * n + more
    if n_shards is None:
        n_shards = max(LEAST_SHARDS, sum(a["_aim"] for a in aims) // SHARD_WORDS)
    shares = split_quotas(np.array([a["_quota"] for a in aims], dtype=np.int64), n_shards, seed)
    # a shard's range of a source's places, once for each stretch of `_stretch` places that it meets
    leaves = []
    for a, share in zip(aims, shares, strict=True):
        a["_stretch"] = max(1, a["_quota"] // n_shards)
        for shard, (end, n) in enumerate(zip(np.cumsum(share).tolist(), share.tolist(), strict=True)):
            if n:
                leaves += [(a["_s"], at, end - n, end, shard) for at in range((end - n) // a["_stretch"], (end - 1) // a["_stretch"] + 1)]
    leaves = df.sparkSession.createDataFrame(leaves, "_s string, _part long, _start long, _end long, shard int")

    plan = _rows(df, aims, {"_s": "string", "_n": "long", "_full": "long", "_rest": "long", "_stretch": "long", "_quota": "long"})
    slots = blocks.join(plan, "_s").select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass"))
    slots = slots.withColumn("_slot", F.col("pass") * F.col("_n") + F.col("_rank")).where("_slot < _quota").withColumn("_part", F.expr("_slot DIV _stretch"))
    most = F.when(F.col("pass") < F.col("_full"), F.col("_held")).otherwise(F.least(F.col("_held"), F.col("_rest") - F.col("_sum")))
    dealt = slots.join(leaves, ["_s", "_part"]).where("_start <= _slot AND _slot < _end").select("_s", "_block", "_begins", "pass", "shard", most.alias("_most"))

    part = F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_most") - (F.col("_from") - F.col("_begins"))))
    if whole:
        part = F.when(part * 2 >= F.col("_words"), F.col("_words")).otherwise(0)
    got = pieces.join(dealt, ["_s", "_block"]).withColumn("words", part).where("words > 0")
    place = F.xxhash64(F.lit(seed), "pass", "_block", "_digest").alias("place")
    got = got.select("_uid", F.struct("pass", F.col("_block").alias("block"), "words", "shard", place).alias("d"))
    got = got.groupBy("_uid").agg(F.array_sort(F.collect_list("d")).alias("draws"))
    none = F.array().cast("array<struct<pass:int,block:bigint,words:bigint,shard:int,place:bigint>>")
    named = _rows(df, aims, {"_s": "string", "source_size": "long", "target": "double"})
    return (
        measured.join(got, "_uid", "left")
        .join(named, "_s")
        .withColumn("draws", F.coalesce("draws", none))
        .select(
            F.col("_key").alias(key),
            F.col("_source").alias(source),
            "size",
            "source_size",
            "target",
            F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"),
            "draws",
            *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)),
        )
    )


def _rows(df: DataFrame, aims: list[dict], columns: dict[str, str]) -> DataFrame:
    """Some columns of the plan, one row a source."""
    return df.sparkSession.createDataFrame([tuple(a[c] for c in columns) for a in aims], ", ".join(f"{c} {t}" for c, t in columns.items()))


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: the columns of each row as often as it is taken, with its shard and its place in there."""
    rows = mixed.select("*", F.explode("draws").alias("_draw"))
    return rows.select(*columns, F.col("_draw.shard").alias("shard"), F.col("_draw.place").alias("place"), F.col("_draw.words").alias("words"))


def in_shards(drawn: DataFrame) -> DataFrame:
    """The rows of materialise(), those of a shard in one partition and there in their shuffled order; text moves once."""
    return drawn.repartition("shard").sortWithinPartitions("shard", "place")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('8:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS digest FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals
), levels AS (
  SELECT *, row_number() OVER r AS place,
    ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW r AS (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST)
), reached AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY place LIMIT 1
), aims AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM reached), 0) * weight) AS target FROM levels
), placed AS (
  SELECT s.*, a.source_size, a.target, round_even(a.target, 0)::BIGINT AS aim, coalesce('=' || s.source, '') AS s,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY digest, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS begins
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), pieces AS (
  SELECT digest, s, aim, source_size, size, block, greatest(begins, block * 4096) AS first,
    least(begins + size, (block + 1) * 4096) - greatest(begins, block * 4096) AS words
  FROM (SELECT *, unnest(range(begins // 4096, (begins + size - 1) // 4096 + 1)) AS block FROM placed WHERE size > 0)
), blocks AS (
  SELECT s, block, any_value(aim) // any_value(source_size) AS full_passes, any_value(aim) % any_value(source_size) AS rest, sum(words)::BIGINT AS held,
    md5('block:8:' || block::VARCHAR || ':' || s) AS place FROM pieces GROUP BY s, block
), summed AS (
  SELECT *, (sum(held) OVER (PARTITION BY s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - held)::BIGINT AS before FROM blocks
), got AS (
  SELECT digest, p.size, sum(words * full_passes + greatest(0, least(words, rest - before - (first - block * 4096))))::BIGINT AS taken
  FROM pieces p JOIN summed USING (s, block) GROUP BY digest, p.size
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed LEFT JOIN got USING (digest, size)
"""
