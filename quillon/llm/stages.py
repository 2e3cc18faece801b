"""The stages of the corpus pipeline, each over all rows that its predecessor kept.

A stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents. Every stage takes
null keys, texts and sources, empty and very long texts, repeated rows, further columns, and a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.core.session import shipped
from quillon.llm import byte_cnn, exact_dedup, jaccard_join, mixing, piece_codec
from quillon.llm._shared import documents, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def piece_model() -> str:
    """Where the public 32k model file lies; every caller may name another."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network finds good, label 1 likelier than not.

    Each row is judged by its own text; a null text counts as empty, and repeated rows get the same verdict. Without
    labels, or with labels of one kind only, every row gets that verdict (0.5, which stays, if there are none).
    """
    net = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_cnn.classify(docs, net, carry=tuple(COLUMNS)).where(F.col("predicted") == 1).select(*COLUMNS)


@shipped
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the least key, one of these if they are tied.

    Null and empty texts are equal; a null key comes after all others.
    """
    return exact_dedup.kept_rows(docs.select(*COLUMNS))


@shipped
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, similarity 0.8 or more; the one with the least key.

    A text without words is like no other and stays.
    """
    return jaccard_join.kept_rows(docs.select(*COLUMNS))


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: whole documents, as often as shards draw them.

    The rows of an output shard lie in one partition (so in one file, when written), in their shuffled order.
    A document without words is never drawn; a null source is a source.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), whole=True, carry=("text", "lang", "n_chars"))
    return mixing.in_shards(mixing.materialise(mixed, COLUMNS)).select(*COLUMNS)


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, with the digests that prove the round trip; a null text is empty."""
    return piece_codec.encode(docs, piece_model())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]

#: SQL expresses neither the network nor the tokens; tests hold the stages against brute force instead.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
