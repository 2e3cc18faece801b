"""Each stage, on its predecessor's rows, against a plain version."""

import hashlib
import re
import struct

import public_tokenizers
import sentencepiece

import corpus_pipeline
from quillon.llm import byte_cnn, mixing
from tests.llm.test_jaccard_join import gram_set
from tests.llm.test_mixing import brute_targets

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        kept.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema)
    (all_, good), (_, distinct), (_, apart), (_, mixed) = kept

    net = byte_cnn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in all_ if byte_cnn.score(net, (r.text or "").encode()) >= 0.5]
    assert sorted(good) == sorted(want) and 0.8 * len(all_) < len(good) < len(all_)

    least = {}
    for r in good:
        name = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if name not in least or r.doc_id < least[name].doc_id:
            least[name] = r
    assert sorted(distinct) == sorted(least.values())

    sets = {r.doc_id: gram_set(r.text) for r in distinct}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in apart) == sorted(k for k in ids if find(k) == k)

    sizes, per, taken = {}, {}, {}
    for r in apart:
        n = len(r.text.encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        per[r.doc_id] = n
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + per[r.doc_id]
    aims = brute_targets(sizes)
    for s, aim in aims.items():
        assert abs(taken.get(s, 0) - aim) <= max(per[r.doc_id] for r in apart if r.source == s) / 2 + 1
    by_id = {r.doc_id: r for r in apart}
    assert all(r == by_id[r.doc_id] for r in mixed)
    assert max([sum(1 for r in mixed if r.doc_id == k) for k in by_id], default=0) <= mixing.MOST

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect():
        ids = library.encode(by_id[r.doc_id].text, add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_run_counts_what_the_stages_keep(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "ids" in found.columns


ODD = "n_chars long, doc_id long, text string, label int, source string, lang string, quality string"


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, 1, None, None, ""), (1, None, "", 1, "web", "en", ""), (1, 3, "", 1, "web", "en", ""), (1, 4, long, 1, "web", None, "")]
    rows += [(1, 5, "the same row twice over", 1, "b", "en", "")] * 2 + [(1, 6, "the  same row\ttwice over", 1, "b", "en", "")]
    return rows + [(1, None, f"row {i} without a key", 1, None, "en", "") for i in range(3)]


def test_stages_take_odd_rows(spark):
    """Null keys, texts and sources, repeated rows, a very long text, further columns with clashing names."""
    docs = spark.createDataFrame(odd_rows(), ODD)
    by_name = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    good = by_name["quality classifier"](spark, docs, SF)
    net = byte_cnn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert good.count() <= len(odd_rows()) and net is not None
    distinct = sorted(by_name["exact dedup"](spark, docs, SF).collect(), key=key)
    assert [(r.doc_id, (r.text or "")[:5]) for r in distinct] == [(3, ""), (4, "word0"), (5, "the s"), (None, "row 0"), (None, "row 1"), (None, "row 2")]
    apart = sorted(by_name["n-gram Jaccard join"](spark, docs, SF).collect(), key=key)
    assert [(r.doc_id, (r.text or "")[:5]) for r in apart] == [(3, ""), (4, "word0"), (5, "the s"), (None, ""), (None, ""), (None, "row 0"), (None, "row 1"), (None, "row 2")]
    mixed = by_name["mixing sources to target weights"](spark, docs, SF)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.text for r in mixed.collect()} <= {r[2] for r in odd_rows() if r[2]}
    assert by_name["SentencePiece encoding"](spark, docs, SF).count() == len(odd_rows())


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_shards_lie_in_one_partition_each(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs, whole=True, n_shards=5, block_words=512)
    drawn = mixing.in_shards(mixing.materialise(mixed, ["doc_id"])).selectExpr("*", "spark_partition_id() AS p").collect()
    assert len(drawn) and len({(r.shard, r.p) for r in drawn}) == len({r.shard for r in drawn}) == 5
    for p in {r.p for r in drawn}:
        order = [(r.shard, r.place) for r in drawn if r.p == p]
        assert order == sorted(order)
