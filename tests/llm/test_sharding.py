import zlib

import pytest

from quillon.llm import sharding

SCHEMA = "text string, shard string, doc_id long, slot int"


def brute(rows, n):
    return {r[2]: (sharding.jump_python(-1 if r[2] is None else r[2], n), sharding.jump_python(-1 if r[2] is None else r[2], n + 1)) for r in rows}


def test_matches_the_published_loop(spark):
    ids = [0, 1, 2, -1, -5, 2**62, 2**63 - 1, -(2**63), *range(100, 1100)]
    rows = [(f"text {i % 7}", "x", i, 3) for i in ids]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 40).collect()
    want = brute(rows, 40)
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == want
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40)
        assert r.text_crc32 == zlib.crc32(f"text {r.doc_id % 7}".encode())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_other_shard_counts(spark, n):
    rows = [("", "", i * 7919, 0) for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), n).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in got} == brute(rows, n)


def test_nulls_repeats_and_long_texts(spark):
    long = "é" * 300_000
    rows = [(None, None, None, None), (None, "a", 5, 1), ("", "b", 5, 1), ("", "b", 5, 1), (long, "c", 6, 2)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.size) for r in got} == {(None, 16), (5, 16), (6, 600_016)}
    assert {r.text_crc32 for r in got if r.size == 16} == {0}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
