import numpy as np

from quillon.llm import byte_cnn as b

SCHEMA = "score string, doc_id long, text string, lang string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = b.fit(docs, labels, max_rows=1_500)
    told = b.classify(docs, net).join(labels, "doc_id").where("held_out").collect()
    assert all(b.crc_fold(r.doc_id) == 1 for r in told) and len(told) > 1000
    good, bad = [r for r in told if r.quality], [r for r in told if not r.quality]
    assert np.mean([r.predicted for r in good]) > 0.98 and np.mean([1 - r.predicted for r in bad]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in told)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = b.train([b"abc " * 40, b"#$%& " * 150], [1, 0], epochs=1, least_steps=1)
    rows = [b.padded(bytes(rng.integers(97, 123, n, dtype=np.uint8))) for n in (900, 30, 0)]
    y = np.array([1.0, 0.0, 1.0])

    def loss(n):
        total = 0.5e-4 * (n.out**2).sum()
        for (d, s), want in zip(rows, y, strict=True):
            t = np.einsum("bv,wvf->wbf", n.symbols(), n.filters)
            _, doc = b.features(b.segment_maxima(t, d, s), n.bias)
            z = doc @ n.out + n.shift
            total += (np.log1p(np.exp(z)) - want * z) / len(rows)
        return total

    grads = b._gradients(net, rows, y)
    for name, at in (("bias", (3,)), ("out", (5,)), ("out", (b.FILTERS + 2,)), ("filters", (1, 2, 3)), ("vectors", (101, 1)), ("echo", (2,))):
        value = getattr(net, name)
        keep, eps = value[at], 1e-5
        value[at] = keep + eps
        up = loss(net)
        value[at] = keep - eps
        down = loss(net)
        value[at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at])), name


def test_every_byte_counts_and_blocks_agree():
    net = b.train([b"abc " * 40, b"#$%& " * 50], [1, 0], epochs=2, least_steps=20)
    long = b"abcd efgh " * 20_000
    assert b.score(net, long) != b.score(net, long + b"#$%& " * 50)
    data, n = b.padded(long)
    whole = b.responses(net.tables(), data, n).max(axis=1)
    assert np.allclose(whole, b.segment_maxima(net.tables(), data, n))


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    rows = [("s", 1, "fine words", "en"), ("s", 2, "### $$$", None), ("s", None, None, None), ("s", 4, "", "x"), ("s", 4, "", "x"), ("s", 5, "é" * 300_000, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = b.classify(df, b.fit(df, labels), carry=("lang",)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [True]
    assert b.classify(df.limit(0), b.fit(df.limit(0), labels)).collect() == []
    assert b.train([], []).shift == 0.0


def test_training_sees_every_byte(monkeypatch):
    rng = np.random.default_rng(4)
    clean = [bytes(rng.integers(97, 123, 60 * b.SEGMENT, dtype=np.uint8)) for _ in range(8)]
    junk = b"#$%&!" * (2 * b.SEGMENT // 5)
    first = 3 * b.SEGMENT - len(junk) // 2  # a few segments of sixty, and not the first ones or the last
    spoilt = [t[:first] + junk + t[first + len(junk) :] for t in clean]
    net = b.train([*clean, *spoilt], [1] * 8 + [0] * 8, least_steps=200)
    assert min(b.score(net, t) for t in clean) > 0.9 and max(b.score(net, t) for t in spoilt) < 0.1
    rows, y = [b.padded(t) for t in (clean[0], spoilt[0])], np.array([1.0, 0.0])
    whole = b._gradients(net, rows, y)
    monkeypatch.setattr(b, "BLOCK", 7)
    sliced = b._gradients(net, rows, y)
    assert all(np.allclose(whole[k], sliced[k]) for k in whole)


def test_training_texts_are_whole(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(30_000))
    df = spark.createDataFrame([("s", i, text, "en") for i in (1, 2, 3)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    seen = b.sample(df, labels, "doc_id", "text", "quality", 3)
    assert seen and all(raw == text.encode() for _, raw in seen)
