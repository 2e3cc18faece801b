import numpy as np

from quillon.llm import toxicity as t

SCHEMA = "score string, doc_id long, text string, grade string"


def test_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = t.fit(docs, labels)
    told = t.grade(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in told if r.toxic], [r for r in told if not r.toxic]
    assert len(toxic) > 100 and np.mean([r.predicted for r in toxic]) > 0.88  # some labelled texts hold no toxic word
    assert np.mean([r.predicted for r in clean]) < 0.01
    assert np.mean([r.severity for r in toxic]) > 1 > 0.1 > np.mean([r.severity for r in clean])
    assert all(0 <= r.severity <= t.TOP and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in told)
    assert (np.diff(model.thresholds) > 0).all()


def test_ordinal_fit_finds_weights_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6_000, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=6_000)
    grade = np.searchsorted([-1.0, 0.5, 2.0], score)
    w, cuts = t.fit_ordinal(x, grade, ridge=0)
    assert np.allclose(w, [2, -1, 0], atol=0.15) and np.allclose(cuts, [-1, 0.5, 2], atol=0.2)


def test_more_insults_are_more_severe(spark):
    model = t.Severity([("idio*", 1), ("idiot", 2), ("idiot", 4)], np.array([3.0, 2.0, 2.0]), np.array([2.0, 4.0, 6.0]))
    texts = ["calm words only", "calm idiots words here " + "w " * 500, "idiot words idiot", "Idiot! idiot, IDIOT. (idiot)"]
    got = {r.doc_id: r for r in t.grade(spark.createDataFrame([("", i, x, "") for i, x in enumerate(texts)], SCHEMA), model).collect()}
    assert got[0].severity < got[1].severity < got[2].severity < got[3].severity
    assert t.tokens("  Idiot! (idiot), «x»  ... ") == ["idiot", "idiot", "x"] and t.tokens(None) == []


def test_odd_rows_and_tables(spark):
    rows = [("", 1, "bad words", ""), ("", 2, "good words", ""), ("", None, None, None), ("", 4, "", ""), ("", 4, "", ""), ("", 5, "word " * 100_000, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 0), (None, 1), (5, None), (77, 1)], "doc_id long, toxic int")
    found = t.grade(df, t.fit(df, labels)).collect()
    assert len(found) == 6 and [r.held_out for r in found if r.doc_id is None] == [True]
    one_class = t.fit(df, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in t.grade(df, one_class).collect())
    assert t.grade(df.limit(0), t.fit(df.limit(0), labels)).collect() == []


def test_repeated_rows_do_not_change_the_fit(spark):
    rows = [("", k, f"word{k % 7} text " + ("vile idiot " * (1 + k % 3) if k % 2 else "plain line"), "") for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    one, more = t.fit(df, labels), t.fit(df.union(df.where("doc_id % 3 = 0")).union(df.where("doc_id < 40")), labels)
    assert one.features == more.features and len(one.features) > 0
    assert np.allclose(one.weights, more.weights) and np.allclose(one.thresholds, more.thresholds)
