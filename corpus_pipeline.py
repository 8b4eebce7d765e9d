"""A training-data pipeline over ``documents``: drop toxic documents, keep one document
of each near-duplicate group, redact secrets, mix the sources, encode to byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Null texts pass every stage but the last as null, and empty texts stay; the mix takes
neither, for they have no words. Of repeated rows of one doc_id near-dedup keeps one;
rows without doc_id are no duplicates of anything and stay. Where documents tie, the
smallest doc_id wins. Columns beside those of documents pass unread, whatever their names,
up to the last stage. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardtrail.llm import byte_bpe, mixing, neardup, secret_scan, toxicity
from cardtrail.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity score doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each near-duplicate group."""
    return neardup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets in their texts replaced."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for every pass that takes words of them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text decoded from them, of every document of the mix."""
    return byte_bpe.encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            scratch.drop(f"stage{number - 1}")
    return docs
