"""Sharding by jump consistent hashing: a key and a shard count decide the shard, with no ring table.

The hash is Lamping and Veach's: a 64-bit linear congruential generator seeded with the key says how far the
key jumps next, and the last jump that stays below the shard count is the shard. All of it runs as DataFrame
functions. Spark's long arithmetic raises on overflow under ANSI mode, so the 64-bit state is two 32-bit limbs
and every product is built from factors that stay below 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published generator: state * MULTIPLIER + 1 modulo 2**64, of which 31 bits are used.
MULTIPLIER = 2862933555777941757
MASK = (1 << 32) - 1
#: Hex digits of a key's digest that split a shard into runs, so that no task numbers a whole shard.
RUN_DIGITS = 3


def _times_low(limb: Column, factor: int) -> tuple[Column, Column]:
    """limb * factor for 32-bit numbers, as (upper 32 bits, lower 48 bits still to be carried)."""
    upper = F.shiftrightunsigned(limb, 16) * F.lit(factor)
    lower = limb.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    return F.shiftright(upper, 16), lower + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next state as two 32-bit limbs."""
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & MASK
    carry, rest = _times_low(low, c_low)
    rest = rest + F.lit(1)
    up = carry + F.shiftright(rest, 32)
    for limb, factor in ((low, c_high), (high, c_low)):
        over, part = _times_low(limb, factor)
        del over  # beyond 64 bits
        up = up + part.bitwiseAND(F.lit(MASK))
    return up.bitwiseAND(F.lit(MASK)), rest.bitwiseAND(F.lit(MASK))


def jump_shards(key: Column, n_shards: int) -> Column:
    """struct(shard, grown): the shard of a long key among n_shards, and among n_shards + 1, from one walk.

    A null key counts as -1. The walk ends by itself when the jump leaves the last shard; the fold's length
    n_shards + 1 is the largest number of jumps there can be, not a cut.
    """
    key = F.coalesce(key.cast("long"), F.lit(-1))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("jump"),
    )

    def step(acc: Column, _: Column) -> Column:
        high, low = _next_state(acc["high"], acc["low"])
        span = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        ahead = F.struct(
            high.alias("high"),
            low.alias("low"),
            F.when(acc["jump"] < n_shards, acc["jump"]).otherwise(acc["shard"]).alias("shard"),
            acc["jump"].alias("grown"),
            ((acc["jump"] + 1).cast("double") * span).cast("long").alias("jump"),
        )
        return F.when(acc["jump"] > n_shards, acc).otherwise(ahead)

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(n_shards)), start, step)
    return F.transform(F.array(walk), lambda w: F.struct(w["shard"].cast("int").alias("shard"), w["grown"].cast("int").alias("grown")))[0]


def shard(df: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, its slot in the shard, and the shard it would have with one more shard.

    Columns: the key, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32 (unsigned, of
    the UTF-8 bytes), law ('key'), shard, slot, grown_shard. Other columns of df are not read. Rows that share
    a key share a shard; a null key counts as -1 and keeps its null. Slots run from 0 without gaps in the order
    of (digest of the key, key, checksum, size); equal rows are interchangeable. An empty table gives no rows.

    A shard may hold a third of a very large table, so no task numbers a whole one: a key's digest splits each
    shard into 16**RUN_DIGITS runs, whose sizes (counted from the key column alone) become offsets.
    """
    where = jump_shards(F.col(key), n_shards)
    run = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, RUN_DIGITS)
    keys = df.select(F.col(key).alias("_key"), where.alias("_where"), run.alias("_run"))
    counts = keys.groupBy(F.col("_where.shard").alias("_shard"), "_run").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))

    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(key).alias("_key"),
        (F.length(body).cast("long") + 16).alias("size"),
        F.crc32(body).alias("text_crc32"),
        where.alias("_where"),
        run.alias("_run"),
    ).select("*", F.col("_where.shard").alias("_shard"))
    within = Window.partitionBy("_shard", "_run").orderBy("_key", "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(within).cast("long") - 1)
        .join(offsets, ["_shard", "_run"])
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            F.col("_shard").alias("shard"),
            (F.col("_offset") + F.col("_at")).alias("slot"),
            F.col("_where.grown").alias("grown_shard"),
        )
    )


def jump_python(key: int, n_shards: int) -> int:
    """The published loop in plain Python integers, for tests and for clients without Spark."""
    state, last, jump = key & ((1 << 64) - 1), -1, 0
    while jump < n_shards:
        last = jump
        state = (state * MULTIPLIER + 1) % (1 << 64)
        jump = int((last + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return last


#: The same rows in DuckDB: 128-bit integers hold the products, and the checksum is folded byte by byte.
ORACLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda x: x::BIGINT)),
      lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), body AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sums AS (
  SELECT rid, doc_id, strlen(text)::BIGINT + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(text)),
          lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM body, crc_table
), walk(rid, state, shard, grown, jump) AS (
  SELECT rid, CASE WHEN coalesce(doc_id, -1) < 0 THEN 18446744073709551616::HUGEINT + coalesce(doc_id, -1) ELSE doc_id::HUGEINT END,
    0::BIGINT, 0::BIGINT, 0::BIGINT FROM body
  UNION ALL
  SELECT rid, following, CASE WHEN jump < 40 THEN jump ELSE shard END, jump,
    floor((jump + 1)::DOUBLE * (2147483648::DOUBLE / ((following // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS following FROM walk WHERE jump <= 40)
), done AS (SELECT rid, max(shard) AS shard, max(grown) AS grown FROM walk GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown::INTEGER AS grown_shard
FROM sums JOIN done USING (rid)
"""
