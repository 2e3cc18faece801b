"""The registered queries that SQL can say, held against DuckDB, and the shape of all others."""

import duckdb
import pytest

from quillon.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(ORACLE[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(r[i]) for i in places]) for r in found.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == want


COLUMNS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_toxicity": ["doc_id", "severity"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_jaccard_join": ["doc_id", "class_id", "links"],
    "op6_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op7_piece_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_warc": ["record_id", "outcome", "response_id"],
    "op10_byte_cnn": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert [c for c in COLUMNS[name] if c not in df.columns] == []
    if name != "op9_warc":
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
