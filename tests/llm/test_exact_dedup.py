import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup as x

SCHEMA = "bucket string, doc_id long, text string, kept int, entry string"


def brute(rows):
    groups = {}
    for i, (_, key, text, *_rest) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((key is None, key, i))
    out = []
    for t, members in groups.items():
        keep = min((m for m in members), key=lambda m: (m[0], m[1] if m[1] is not None else 0))[1]
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(m[1], keep, len(members), sha) for m in members]
    return sorted(out, key=str)


def check(spark, rows, **kwargs):
    found = x.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(3), **kwargs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    return found


ROWS = [
    ("a", 5, "x  y", 1, None), ("a", 3, "x\ty", 1, None), ("a", 4, "x y ", 1, None), ("a", 1, "", 1, None), ("a", 2, None, 1, None),
    ("a", None, "x y", 1, None), ("a", None, "only", 1, None), (None, 3, "x y", 1, "e"), (None, 3, "x y", 1, "e"), ("a", 9, "é" * 200_000, 1, None),
    ("a", 8, "é" * 200_000, 1, None), ("a", 10, " ", 1, None), ("a", 11, "\n\n", 1, None),
]


def test_cases(spark):
    check(spark, ROWS + [("z", 100 + i, f"copy {i % 7}", 0, "") for i in range(500)])


def test_collisions_are_chained(spark):
    rows = [("z", i, f"text {i % 40}", 0, "") for i in range(400)]
    found = check(spark, rows, hash_of=F.length("text").cast("long"), capacity=1)
    assert len({r.keep_id for r in found}) == 40


def test_empty_table(spark):
    assert x.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_directory_doubles_and_splits(capacity):
    bits = 8
    cells = {c: (c * 37) % 11 for c in range(1 << bits)}
    d = x.Directory.of(cells, capacity, bits)
    assert len(d.pointers) == 1 << d.depth
    for b in range(len(d.depths)):
        own = [a for a, p in enumerate(d.pointers) if p == b]
        assert own == list(range(own[0], own[0] + (1 << (d.depth - d.depths[b]))))
        span = 1 << (bits - d.depth)
        load = sum(cells[c] for a in own for c in range(a * span, (a + 1) * span))
        assert load <= capacity or d.depths[b] == bits


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(None, r.doc_id, r.text) for r in docs.collect()]
    found = x.deduplicate(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)


def test_kept_rows_are_whole(spark):
    rows = ROWS + [("z", 100 + i, f"copy {i % 7}", i, "q") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [tuple(r) for r in x.kept_rows(df).collect()]
    assert x.kept_rows(df).columns == df.columns
    told = [r for r in x.deduplicate(df).collect() if r.kept]
    assert sorted(str(r[1]) for r in kept) == sorted(str(r.doc_id) for r in told)
    assert all(r in rows for r in kept)
    assert x.kept_rows(df.limit(0)).collect() == []


def test_kept_rows_by_a_shuffle_too(spark, monkeypatch):
    from quillon.llm import _shared

    monkeypatch.setattr(_shared, "BROADCAST_IDS", 0)
    test_kept_rows_are_whole(spark)
