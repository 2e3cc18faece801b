import re

from quillon.llm import quality_rules as q

SCHEMA = "kept string, doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, marked = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                marked |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def check(spark, texts, rules=None):
    rows = [("x", i, t, None) for i, t in enumerate(texts)]
    got = q.judge(spark.createDataFrame(rows, SCHEMA), rules or q.DecisionList()).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    return got


def test_counts_of_odd_texts(spark):
    check(
        spark,
        [None, "", " \n\t ", "a", "a a a a", "a b c a b c", "a b c d a b c", "x\ny\nx\n\n \nx", "é ü ß é ü ß", "a\x0bb\x0cc\rd", "<#> **", "\U0001f600 \U0001f600 ok",
         " ".join(["lorem"] * 20_000), " ".join(str(i) for i in range(30_000)), "a b c\nx a b\nc a b c"],
    )


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = q.judge(docs, q.DecisionList()).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_learned_list_on_rows_it_did_not_see(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = q.fit(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    assert rules.rules and str(rules).endswith("keep")
    told = q.judge(docs, rules).join(labels.where("pmod(xxhash64(doc_id), 2) = 1"), "doc_id").collect()
    good = [r for r in told if r.quality == 1 and not r.base_failed]
    bad = [r for r in told if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    for r in told:  # the CASE expression says what the list says
        if not r.base_failed:
            assert r.kept == rules.keeps({m: float(r[m]) for m in q.MEASURES})


def test_empty_tables_and_labels_without_use(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    rules = q.fit(docs, labels)
    assert rules.rules == [] and q.judge(docs, rules).collect() == []
    assert q.learn([]).rules == []
