"""Exact deduplication over an extendible-hash index on shared files.

1. Combine: each Arrow batch of rows folds its equal texts into one entry, so a group of copies, however large,
   sends a text only once for each batch. Rows and entries are written to the shared folder.
2. Directory: the distinct keys are counted in cells of their leading bits. Starting from one bucket, overfull
   buckets split on their next bit, and the directory doubles whenever a bucket as deep as itself splits.
3. Owners: entries go to the task that owns their bucket, a range of keys, in key order. Within a key the owner
   keeps a chain of the different texts seen, compares bytes, and names each entry's place in the chain. These
   rows, without texts, are the index on the shared files.
4. Lookup: the index names the row that stays for every chain place; rows find their entry and with it the answer.

The hash finds candidates only; bytes decide. Text moves once. Nothing of a whole group meets in one task: an
owner streams a chain's entries, and rows join by entry, which holds a batch at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._shared import SPACE, small, stored, tidied

#: Leading key bits that the directory may use: it has 2**MAX_DEPTH pointers at most. Buckets at that depth grow
#: beyond the capacity instead of splitting, and stay exact.
MAX_DEPTH = 16
#: Distinct keys in a bucket before it splits.
CAPACITY = 2_000


class Directory:
    """An extendible-hash directory over leading key bits: pointers[address] is a bucket, depths[bucket] its depth."""

    def __init__(self) -> None:
        self.depth, self.pointers, self.depths = 0, [0], [0]

    def split(self, bucket: int) -> int:
        """Split a bucket on its next bit, doubling the directory if it is as deep as the directory; the new bucket."""
        if self.depths[bucket] == self.depth:
            self.pointers = [b for b in self.pointers for _ in range(2)]
            self.depth += 1
        self.depths[bucket] += 1
        fresh = len(self.depths)
        self.depths.append(self.depths[bucket])
        own = [a for a, b in enumerate(self.pointers) if b == bucket]
        for a in own[len(own) // 2 :]:
            self.pointers[a] = fresh
        return fresh

    @classmethod
    def of(cls, cells: dict[int, int], capacity: int, cell_bits: int = MAX_DEPTH) -> Directory:
        """Split until no bucket holds more than capacity keys, given the number of keys in each cell."""
        before = [0]
        for c in range(1 << cell_bits):
            before.append(before[-1] + cells.get(c, 0))
        directory = cls()
        first, todo = {0: 0}, [0]  # the first cell of each bucket
        while todo:
            bucket = todo.pop()
            width = 1 << (cell_bits - directory.depths[bucket])
            load = before[first[bucket] + width] - before[first[bucket]]
            if load > capacity and width > 1:
                fresh = directory.split(bucket)
                first[fresh] = first[bucket] + width // 2
                todo += [bucket, fresh]
        return directory


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE}+", " ")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, normalised text, raw text, others) -> (uid, key, entry, hash, raw text, others).

    entry is the uid of the first row in the batch with the same normalised text. Without other columns only
    these rows carry their text.
    """
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        entry_of: dict[str, int] = {}
        uids = list(range(uid, uid + batch.num_rows))
        entries = [entry_of.setdefault(t, u) for t, u in zip(batch.column(2).to_pylist(), uids, strict=True)]
        raw = batch.column(3)
        if batch.num_columns == 4:
            first = pa.array([e == u for e, u in zip(entries, uids, strict=True)], pa.bool_())
            raw = pa.compute.if_else(first, raw, pa.scalar(None, raw.type))
        others = list(batch.columns[4:])
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), batch.column(0), pa.array(entries, pa.int64()), batch.column(1), raw, *others], ["uid", "id", "entry", "hash", "raw", *(f"c{i}" for i in range(len(others)))])
        uid += batch.num_rows


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, hash, entry, text) in (bucket, hash) order -> the same without text, with chain, digest and bytes."""
    now, chain = None, {}
    for batch in batches:
        hashes, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        places, digests, sizes = [], [], []
        for h, text in zip(hashes, texts, strict=True):
            if h != now:
                now, chain = h, {}
            found = chain.get(text)  # compares bytes
            if found is None:
                raw = text.encode("utf-8")
                found = chain[text] = (len(chain), hashlib.sha256(raw).hexdigest(), len(raw))
            places.append(found[0])
            digests.append(found[1])
            sizes.append(found[2])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int32()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())],
            ["bucket", "hash", "entry", "chain", "text_sha256", "n_bytes"],
        )


def _answers(df: DataFrame, key: str, text: str, capacity: int, hash_of: Column | None, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows (uid, id, entry, hash, raw, carried columns) and each entry's answer."""
    spark = df.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(key).alias("id"), normalised(F.col(text)).alias("text"), F.col(text).cast("string").alias("raw"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    rows = rows.select("id", (F.xxhash64("text") if hash_of is None else hash_of).alias("hash"), "text", "raw", *(f"c{i}" for i in range(len(carry))))
    schema = ", ".join([f"uid long, id {kind[key]}, entry long, hash long, raw string", *(f"c{i} {kind[c]}" for i, c in enumerate(carry))])
    rows = stored(rows.mapInArrow(tidied(_combine), schema), "dedup-rows")

    cell = F.shiftrightunsigned("hash", 64 - MAX_DEPTH)
    entries = rows.where(F.col("uid") == F.col("entry"))
    cells = entries.select("hash").distinct().groupBy(cell.alias("cell")).count()
    directory = Directory.of({r["cell"]: r["count"] for r in cells.collect()}, capacity)
    span = 1 << (MAX_DEPTH - directory.depth)
    pointers = spark.createDataFrame([(a, b) for a, b in enumerate(directory.pointers)], "address long, bucket int")

    owned = (
        entries.select("hash", "entry", normalised(F.col("raw")).alias("text"), F.floor(cell / span).cast("long").alias("address"))
        .join(F.broadcast(pointers), "address")  # 2**MAX_DEPTH rows at most
        .select("bucket", "hash", "entry", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "hash", "entry")
    )
    index = stored(owned.mapInArrow(tidied(_chains), "bucket int, hash long, entry long, chain int, text_sha256 string, n_bytes long"), "dedup-index")

    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    heads = rows.groupBy("entry").agg(best.alias("head"), F.count(F.lit(1)).alias("n"))
    named = index.join(heads, "entry")
    stays = named.groupBy("hash", "chain").agg(F.min("head").alias("stays"), F.sum("n").alias("group_size"))
    return rows, named.join(stays, ["hash", "chain"]).select("entry", "bucket", "stays", "group_size", "text_sha256")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hash_of: Column | None = None) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256, bucket for every row of df, dropped ones too.

    Texts are equal when the same after each run of white space becomes one space; null counts as empty. Of
    equal texts the row with the smallest key stays; null keys come last, and of rows that agree in key and
    text one stays. text_sha256 is of the normalised text in UTF-8. Other columns of df are not read. An empty
    table gives no rows. hash_of replaces the 64-bit hash of the column `text` (tests use it to force collisions).
    """
    rows, answer = _answers(df, key, text, capacity, hash_of, [])
    return (
        rows.select("uid", "id", "entry")
        .join(answer, "entry")
        .select(
            F.col("id").alias(key),
            F.col("stays.id").alias("keep_id"),
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("uid") == F.col("stays.uid")).alias("kept"),
            "text_sha256",
            "bucket",
        )
    )


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of df that deduplicate() keeps, with all their columns.

    The rows that go are named, and they are usually few: then the texts stay where they are.
    """
    others = [c for c in df.columns if c not in (key, text)]
    rows, answer = _answers(df, key, text, capacity, None, others or [key])
    gone = rows.select("uid", "entry").join(answer.select("entry", F.col("stays.uid").alias("stay")), "entry").where("uid <> stay").select("uid")
    names = {key: F.col("id"), text: F.col("raw")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    return rows.join(small(stored(gone, "dedup-gone")), "uid", "left_anti").select(*(names[c].alias(c) for c in df.columns))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
