import random

import numpy as np

from quillon.llm import jaccard_join as j

SCHEMA = "links string, doc_id long, text string, rep int, uid string"


def gram_set(text, n=5):
    w = (text or "").encode().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    sets = [gram_set(r[2]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[1])
    least = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return sorted(((r[1], least[find(i)], len(groups[find(i)]), links[i]) for i, r in enumerate(rows)), key=str)


def check(spark, rows, **kwargs):
    found = j.join(spark.createDataFrame(rows, SCHEMA).repartition(3), **kwargs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.links) for r in found), key=str) == brute(rows)
    assert sum(r.kept for r in found) == len(rows) - sum(1 for r in found if not r.kept)
    return found


def varied(seed, families=12, members=6, words=80):
    rng = random.Random(seed)
    rows, key = [], 0
    for f in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(words + f)]
        for m in range(members):
            text = list(base)
            for _ in range(rng.randrange(5) if m else 0):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9999)}"
            rows.append(("z", key, " ".join(text), 0, "u"))
            key += 1
    rng.shuffle(rows)
    return rows


def test_families_against_all_pairs(spark):
    rows = varied(1) + [("z", 900, None, 0, ""), ("z", 901, "", 0, ""), ("z", 902, " \n", 0, ""), ("z", 903, "one two", 0, ""), ("z", 904, "one  two", 0, ""), ("z", None, "one two", 0, ""), ("z", 5, "same key twice here now", 0, ""), ("z", 5, "same key twice here now", 0, "")]
    check(spark, rows)


def test_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_ROWS", 2)
    check(spark, varied(2, families=4, members=9, words=60))


def test_long_text(spark):
    text = " ".join(f"w{i % 9973}" for i in range(60_000))
    found = check(spark, [("z", 1, text, 0, ""), ("z", 2, text + " tail", 0, ""), ("z", 3, "tail", 0, "")])
    assert sum(r.kept for r in found) == 2


def test_empty_table(spark):
    assert j.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_banding():
    for threshold in (0.5, 0.8, 0.95):
        for recall in (0.9, 0.9999):
            bands, rows = j.banding(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall
    assert j.banding(0.8, 0.9999) == (18, 4)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    found = dict(j.components(spark.createDataFrame(edges, "a long, b long"), "test").collect())
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(both[:360]), np.unique(both[40:])  # similarity 0.8
        hits += bool(set(enumerate(j.band_hashes(a, 18, 4))) & set(enumerate(j.band_hashes(b, 18, 4))))
    assert hits >= 298


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(None, r.doc_id, r.text) for r in docs.collect()]
    found = j.join(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.links) for r in found), key=str) == brute(rows)


def test_kept_rows_are_whole(spark):
    rows = varied(3, families=5, members=5) + [("z", 900, None, 0, ""), ("y", 901, "", 1, None), ("z", 903, "one two", 0, ""), ("z", 904, "one  two", 0, ""), ("z", None, "one two", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = [tuple(r) for r in j.kept_rows(df).collect()]
    assert j.kept_rows(df).columns == df.columns and all(r in rows for r in kept)
    assert sorted(r[1] for r in kept) == sorted({c for _, c, _, _ in brute(rows)})
    assert j.kept_rows(df.limit(0)).collect() == []


def test_least_agreement_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(7)
    for hashes, threshold, missed in ((76, 0.8, 0.00005), (40, 0.5, 0.01), (6, 1.0, 0.01)):
        least = j.least_agreement(hashes, threshold, missed)
        agreed = rng.binomial(hashes, threshold, 200_000)
        assert (agreed < least).mean() <= 3 * missed and 0 < least <= hashes
    assert j.least_agreement(76, 0.8, 0.00005) > 40


def test_alike_sketches_in_blocks_and_sides(monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, (3, 76), dtype=np.uint8)
    rows = [r.copy() for r in base for _ in range(5)] + [rng.integers(0, 256, 76, dtype=np.uint8)]
    for r in rows[:15]:
        r[rng.integers(0, 76, 8)] ^= 1
    sketches = [r.tobytes() for r in rows]
    expected = [0] * 5 + [5] * 5 + [10] * 5 + [15]
    for step in (1, 4, 256):
        monkeypatch.setattr(j, "SKETCHES", step)
        assert j.alike(sketches, 0, 45).tolist() == expected
        sided = j.alike(sketches, 7, 45).tolist()
        assert sided == [0, 1, 2, 3, 4] + [5] * 5 + [10, 11, 12, 13, 14, 15]
    assert j.alike(sketches[:2], 0, 45).tolist() == [0, 0] and j.alike(sketches[4:6], 1, 45).tolist() == [0, 1]


def test_chance_meetings_do_not_chain_texts(spark, monkeypatch):
    # every text holds the same passage (similarity of some 0.4), so most meet in some band
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    rows = [("z", k, " ".join(passage + [f"t{rng.randrange(10**6)}" for _ in range(40)]), 0, "u") for k in range(120)]
    rows += [("z", 500 + k, rows[k][2] + " more", 0, "u") for k in range(10)]
    seen = []
    plain = j.components
    monkeypatch.setattr(j, "components", lambda edges, name: seen.append(plain(edges, name)) or seen[-1])
    check(spark, rows)
    assert 20 <= seen[0].count() <= 60


def test_bucket_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(j, "BUCKET_ROWS", 2)
    check(spark, varied(4, families=4, members=9, words=60))
