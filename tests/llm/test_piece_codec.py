import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import piece_codec as p

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


CODEC = p.Codec(p.PieceTable.from_model(MODEL))
PARTS = ["a", "b", "e", "t", "h", " ", "  ", "▁", "\n", "\t", "é", "ß", "中", "文", "<", "0x", ">", "the", "ing", "    ", "12", ".", "...", "==", "​", "\U0001f600", "ﬁ", "\r", "AB", "<s>", "</s>", "<0x41>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=["Cs"]), max_size=40).map("".join))
def test_same_as_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == library.decode(ids)
    assert CODEC.both(text)[1] == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 600), max_size=30))
def test_decodes_any_ids_like_the_library(ids):
    assert CODEC.decode(ids) == sentencepiece.SentencePieceProcessor(model_file=MODEL).decode(ids)


def test_long_runs(library):
    for text in ["a" * 50_000, " " * 20_000 + "x", "=" * 30_000, "ab" * 30_000, "\n" * 10_000, "中" * 9_999, "the " * 9_999]:
        assert CODEC.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_compatibility_against_merging():
    pieces = [x for x in CODEC.table.pieces if 1 < len(x) < 5 and "▁" not in x][:4000:37]
    for a in pieces:
        for b in pieces:
            if CODEC.halves(a) and CODEC.halves(b):
                assert CODEC.compatible(a, b) == (CODEC.merged(a + b)[0] == [a, b])


def test_rows(spark, library):
    texts = [None, "", " ", "plain text", "plain text", "x" * 100_000]
    df = spark.createDataFrame([("q", i, t, 0) for i, t in enumerate(texts)] + [("q", None, "no key", 0)], "ids string, doc_id long, text string, n_tokens int")
    found = p.decode(p.encode(df, MODEL), MODEL).collect()
    assert len(found) == 7
    for r in found:
        text = "no key" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert p.encode(df.limit(0), MODEL).collect() == []


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in p.encode(docs, MODEL, keep_ids=False).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
