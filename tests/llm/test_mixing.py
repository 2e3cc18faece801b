import hashlib

import numpy as np
import pytest

from quillon.llm import mixing

SCHEMA = "size string, doc_id long, source string, text string, taken int"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in names if s not in stopped)
        want = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / share for s in names}
        above = {s for s in names if s not in stopped and want[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return want
        stopped |= above


def rows_of(counts):
    rows, i = [], 0
    for source, texts in counts.items():
        for t in texts:
            rows.append(("x", i, source, t, 0))
            i += 1
    return rows


@pytest.mark.parametrize("whole", [False, True])
def test_targets_are_met(spark, whole):
    counts = {"b": ["w " * (i % 17) for i in range(300)], "a": ["v " * 5] * 10, "ü": ["one two"] * 4, None: ["z z z"] * 50, "": ["", None]}
    rows = rows_of(counts)
    sizes = {s: sum(len((t or "").split()) for t in texts) for s, texts in counts.items()}
    want = brute_targets(sizes)
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_words=7, whole=whole).collect()
    assert len(found) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.size == len((rows[r.doc_id][3] or "").split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert r.taken == sum(d.words for d in r.draws) <= 3 * r.size
        assert not whole or r.size == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= (9 if whole else 0.5)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5), block_words=7, whole=whole).collect()
    assert sorted((r.doc_id, r.taken, str(r.draws)) for r in found) == sorted((r.doc_id, r.taken, str(r.draws)) for r in again)


def test_tree_splits_exactly():
    quotas = np.array([1000, 3, 0, 517, 1])
    shares = mixing.split_quotas(quotas, 7, 1)
    assert (shares.sum(axis=1) == quotas).all() and (shares >= 0).all()
    assert shares.sum(axis=0).max() - shares.sum(axis=0).min() <= 2
    assert (mixing.split_quotas(quotas, 7, 1) == shares).all()
    many = np.mean([mixing.split_quotas(quotas, 7, s)[:, 2] for s in range(300)], axis=0)
    assert np.allclose(many, quotas / 7, atol=1.5)


def test_blocks_are_disjoint(spark):
    rows = rows_of({"a": ["w"] * 400, "b": ["w"] * 100})
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_words=1, n_shards=5)
    drawn = mixing.materialise(found, ["doc_id", "source"]).collect()
    shards = np.bincount([r.shard for r in drawn], minlength=5)
    assert shards.sum() == 500 and shards.max() - shards.min() <= 2
    per = {}
    for r in drawn:
        per.setdefault((r.source, r.shard), []).append(r.doc_id)
    assert len(per) == 10


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    found = mixing.mix(spark.createDataFrame(rows_of({"a": [None, "", " "]}), SCHEMA)).collect()
    assert [(r.size, r.target, r.taken, r.draws) for r in found] == [(0, 0.0, 0, [])] * 3


def test_carried_columns_and_copies(spark):
    rows = rows_of({"a": ["w x y"] * 30, "b": ["z"] * 5, None: [None]})
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(df.select("doc_id", "source", "text", df["taken"].alias("n_chars")), carry=("text", "n_chars"), whole=True)
    copies = mixing.materialise(mixed, ["doc_id", "text", "n_chars", "source"]).collect()
    by_id = {r[1]: r for r in rows}
    assert all(r.text == by_id[r.doc_id][3] and r.source == by_id[r.doc_id][2] for r in copies)
    assert len(copies) == sum(len(r.draws) for r in mixed.collect())


def test_hypergeometric_of_any_size():
    rng = np.random.default_rng(0)
    for good, bad, draws in ((7, 5, 6), (300, 2, 50), (40_000, 90_000, 1_000)):
        got = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(4_000)])
        want = np.random.default_rng(1).hypergeometric(good, bad, draws, 4_000)
        assert abs(got.mean() - want.mean()) < 5 * want.std() / 60 and abs(got.std() - want.std()) < 0.1 * max(want.std(), 1)
        assert max(0, draws - bad) <= got.min() and got.max() <= min(good, draws)
    good, bad, draws = 4 * 10**9, 6 * 10**9, 5 * 10**9
    got = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(20)], float)
    spread = (draws * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(got.mean() - 2 * 10**9) < 5 * spread / 20**0.5 and 0.4 * spread < got.std() < 2 * spread
    assert [mixing._hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 0), (5, 5, 10))] == [0, 3, 0, 5]


def brute_mix(rows, block_words, n_shards, seed=8):
    """taken of each row, word by word, from the same quotas and tree."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    split = [(i, r[2], len((r[3] or "").split()), md5(f"{seed}:{'null' if r[1] is None else r[1]}:{md5(r[3] or '')}")) for i, r in enumerate(rows)]
    sizes = {}
    for _, source, n, _ in split:
        sizes[source] = sizes.get(source, 0) + n
    aims = brute_targets(sizes)
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    quotas, plans = [], []
    for s in names:
        stream = [i for i, source, n, _ in sorted(split, key=lambda r: (r[3], r[2])) if source == s for _ in range(n)]
        blocks = [stream[k : k + block_words] for k in range(0, len(stream), block_words)]
        order = sorted(range(len(blocks)), key=lambda k: md5(f"block:{seed}:{k}:{'' if s is None else '=' + s}"))
        left, drawn = round(aims[s]), []
        while left > 0:
            for k in order:
                if left > 0:
                    drawn.append(blocks[k][:left])
                    left -= len(drawn[-1])
        quotas.append(len(drawn))
        plans.append(drawn)
    taken, shards = [0] * len(rows), [0] * len(rows)
    for drawn, share in zip(plans, mixing.split_quotas(np.array(quotas, dtype=np.int64), n_shards, seed), strict=True):
        owner = np.repeat(np.arange(n_shards), share)
        for shard, block in zip(owner.tolist(), drawn, strict=True):
            for i in block:
                taken[i] += 1
                shards[i] += shard
    return taken, shards


def test_draws_against_word_by_word(spark):
    counts = {"b": [f"{i} " + "w " * (i % 17) for i in range(120)], "a": [f"v{i} " * 5 for i in range(10)], "ü": ["one two"], None: ["z z z", None, ""], "long": ["x " * 900]}
    rows = rows_of(counts)
    rows = [(r[0], None if i % 9 == 0 else i % 90, *r[2:]) for i, r in enumerate(rows)]  # null and repeated keys
    for block_words, n_shards in ((7, 5), (64, 16)):
        df = spark.createDataFrame([(*r[:4], i) for i, r in enumerate(rows)], SCHEMA)
        found = mixing.mix(df, block_words=block_words, n_shards=n_shards, carry=("taken",)).toDF("doc_id", "source", "size", "source_size", "target", "words", "draws", "row")
        taken, shards = brute_mix(rows, block_words, n_shards)
        for r in found.collect():
            assert r.words == taken[r.row] and sum(d.words * d.shard for d in r.draws) == shards[r.row]
            assert len({(d["pass"], d.block) for d in r.draws}) == len(r.draws)
