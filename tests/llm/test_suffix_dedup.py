import hashlib
import random

import numpy as np
import pytest

from quillon.llm import _shared
from quillon.llm import suffix_dedup as s

SCHEMA = "spans string, doc_id long, text string, n_bytes int, key string"
W = s.WINDOW


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    places = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - W + 1):
            places.setdefault(raw[i : i + W], []).append((d, i))
    gone = [np.zeros(len(r) + 1, bool) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + W] = True
    out = []
    for raw, g in zip(raws, gone, strict=True):
        kept = bytes(np.frombuffer(raw, np.uint8)[~g[:-1]])
        out.append((len(raw), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[0]) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    rows = [("x", i, t, 0, "k") for i, t in enumerate(texts)]
    found = s.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(texts)
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert sum(x.end - x.start for x in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return found


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90), text(150), text(400)]
    out = [None, "", "short", "short", "a" * 399, "a" * 400, "a" * 401, "ab" * 1_000, text(600)]
    for i in range(30):
        parts = [text(rng.randrange(5, 120)) for _ in range(3)]
        parts.insert(rng.randrange(3), shared[i % 3])
        out.append(" ".join(parts))
    base = text(500)
    out += [base, base, base, base.replace("a", "b", 3), base[:700] + "!" + base[700:], base[300:], base[:1500] + text(20) + base[1500:]]
    edge = text(200)
    out += ["<" + edge[:399] + ">", "[" + edge[:399] + "]", "{" + edge[:400] + "}", "(" + edge[:400] + ")", edge[:400] + edge[:400]]
    return out


def test_against_every_window(spark):
    found = check(spark, corpus())
    assert sum(r.n_removed > 0 for r in found) > 30


def test_small_parts_and_moving_all_texts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(s, "PART", 7)
    monkeypatch.setattr(_shared, "BROADCAST_IDS", 0)
    check(spark, corpus(1))


def test_ranks_fall_back_to_all_bits():
    found = np.array([5, 5, 1 << 60, (1 << 60) + 1, 7, 1 << 60], np.uint64)
    for size in (len(found), len(found) + 3):
        got = s.ranks(found, size)
        assert (got[len(found) :] == -1).all()
        assert all((got[i] == got[j]) == (found[i] == found[j]) for i in range(len(found)) for j in range(len(found)))


def test_many_shards_merge_to_the_same():
    rng = random.Random(5)
    base = bytes(rng.randrange(97, 103) for _ in range(3_000))
    segments = [base[rng.randrange(1000) :][: rng.randrange(400, 1500)] for _ in range(60)]
    segments += [bytes(rng.randrange(97, 99) for _ in range(700)), b"z" * 1_000]
    places = {}
    for j, x in enumerate(segments):
        for i in range(len(x) - W + 1):
            places.setdefault(x[i : i + W], []).append((j, i))
    want = [np.zeros(len(x) - W + 1, bool) for x in segments]
    for found in places.values():
        if len(found) > 1:
            for j, i in found:
                want[j][i] = True
    for shard in (1, 2_000, 10**9):
        assert all((a == b).all() for a, b in zip(s.repeated(segments, shard), want, strict=True))


def test_merge_keeps_suffix_order():
    """The merged order is the order of all suffixes by their first symbols, whatever the shards."""
    rng = np.random.default_rng(2)
    n = 40 * s.BLOCK
    symbols = rng.integers(0, 3, n)  # a symbol for each place; the suffix at i is symbols[i], symbols[i + BLOCK], ...
    before = np.full(2 * (n + 1), -1)
    orders, ends = [], []
    for k in range(2):
        at = k * (n + 1)
        before[at + s.BLOCK : at + n + 1] = np.roll(symbols, k)[: n + 1 - s.BLOCK]
        ends.append(np.arange(at + n + 1 - s.BLOCK, at + n + 1))
        orders.append(s.shard_bwt(np.arange(at, at + n + 1), before, ends[-1], 4))
    merged, classes = s.merge(orders, ends, before, 4)
    word = lambda i: tuple(before[j + s.BLOCK] for j in range(i, i // (n + 1) * (n + 1) + n + 1 - s.BLOCK, s.BLOCK))[:4]
    words = [word(int(i)) for i in merged]
    assert words == sorted(words) and sorted(merged.tolist()) == list(range(2 * (n + 1)))
    for a, b, x, y in zip(words, words[1:], classes, classes[1:], strict=False):
        assert (x == y) == (a == b and len(a) == 4) or len(a) < 4


@pytest.mark.parametrize("size", [8, 40, 64, 100])
def test_hashes_depend_on_their_bytes_alone(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 4, 500, dtype=np.uint8)
    again = np.concatenate([rng.integers(0, 4, 37, dtype=np.uint8), data])
    assert (s.hashes(again, size)[37:] == s.hashes(data, size)).all()
    other = data.copy()
    other[size - 1] ^= 1
    assert s.hashes(other, size)[0] != s.hashes(data, size)[0]


def test_anchors_of_long_texts(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(97, 100, 20_000, dtype=np.uint8))
    whole = s.runs(raw)
    monkeypatch.setattr(s, "STRIDE", 3_000)
    spread = lambda found: {(int(k), int(p), w) for k, p, a, b in zip(*found, strict=True) for w in range(a, b + 1)}
    assert spread(whole) == spread(s.runs(raw)) and len(spread(whole)) == len(raw) - W + 1


def test_empty_table_and_repeated_rows(spark):
    assert s.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("x", 7, "q" * 500, 0, ""), ("x", 7, "q" * 500, 0, ""), ("x", None, None, 0, "")]
    found = s.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("7", 500), ("7", 500), ("None", 0)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([k for k, _ in texts], brute([t for _, t in texts]), strict=True))
    for r in s.remove_repeats(docs).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def brute_passages(texts):
    n = s.WORDS.window
    split = [(t or "").encode().split() for t in texts]
    places = {}
    for d, words in enumerate(split):
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), []).append((d, i))
    hit = [np.zeros(len(w) + 1, bool) for w in split]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                hit[d][i : i + n] = True
    return [(int((h[1:] & ~h[:-1]).sum() + h[0]), int(h.sum())) for h in hit]


def passages_agree(spark, texts):
    rows = [("x", i, t, 0, "k") for i, t in enumerate(texts)]
    found = s.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute_passages(texts)
    assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in found} == dict(enumerate(want))
    return want


def test_passages_of_words(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(n))
    shared = [text(50), text(51), text(52), text(80)]
    texts = [text(rng.randrange(0, 60)) + ("\t" if i % 2 else " \n ") + shared[i % 4] + " " + text(rng.randrange(0, 40)) for i in range(40)]
    texts += [None, "", "one", "a " * 50, "a " * 52, text(300) + " x" * 51, shared[3], shared[3]]
    want = passages_agree(spark, texts)
    assert sum(n > 0 for n, _ in want) > 25 and sum(n == 0 for n, _ in want) > 5
    passages_agree(spark, corpus(2))


def test_hot_groups_are_cut_in_halves(spark, monkeypatch):
    """One passage in many surroundings, in groups of a few segments at most."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    texts = [text(12) + " " + passage + " " + text(12) for _ in range(60)] + [passage[: -i - 1] + "#" + text(30) for i in range(40)]
    largest = []
    judged = s._judged
    monkeypatch.setattr(s, "_judged", lambda members: largest.append(judged(members)) or largest[-1])
    monkeypatch.setattr(s, "HOT", 4_000)
    check(spark, texts)
    passages_agree(spark, texts)
    assert len(largest) > 4
    assert largest[0].agg({"volume": "max"}).first()[0] > 4_000
    monkeypatch.setattr(s, "HOT", 0)
    check(spark, texts + corpus(3))
    passages_agree(spark, texts + corpus(3))


def test_many_surroundings_meet_in_bounded_groups(spark):
    """20,000 different surroundings of one passage: no group that is merged has more than HOT bytes."""
    passage = " ".join(f"w{i}" for i in range(120))
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"concat(sha2(concat('a', id), 512), ' {passage} ', sha2(concat('b', id), 512)) AS text")
    levels = []
    grouped = s._grouped
    try:
        s._grouped = lambda bodies: levels.append(grouped(bodies)) or levels[-1]
        found = s.remove_repeats(docs).where("n_spans <> 1 OR n_removed < " + str(len(passage))).count()
    finally:
        s._grouped = grouped
    assert found == 0 and len(levels[0]) > 1
    assert all(not j.where(f"kinds > 1 AND volume > {s.HOT}").count() for _, j in levels[0])


@pytest.mark.parametrize("stride", [1 << 22, 50])
def test_word_hashes(monkeypatch, stride):
    monkeypatch.setattr(s, "STRIDE", stride)
    rng = random.Random(3)
    raw = "".join(rng.choice("ab é\t\n\x0b  ") for _ in range(3_000)).encode()
    names = s.word_hashes(raw)
    split = raw.split()  # of bytes: the same white space
    assert len(names) == len(split)
    known = dict(zip(split, names.tolist(), strict=True))
    assert len(set(known.values())) == len(known) and all(known[w] == h for w, h in zip(split, names.tolist(), strict=True))
    assert len(s.word_hashes(b"")) == len(s.word_hashes(b" \n ")) == 0
