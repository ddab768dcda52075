"""The corpus pipeline: from ``documents`` to token ids in training order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegrist.llm.exact_dedup import deduplicated
from tablegrist.llm.language_id import accepted
from tablegrist.llm.mixing import by_rank, mixed_documents
from tablegrist.llm.rows import in_written_order
from tablegrist.llm.sentence_pieces import counted, with_tokens
from tablegrist.llm.super_minhash import one_of_each
from tablegrist.session import cut_lineage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a language of the labelled ones; texts without a letter go."""
    return accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents that are equal but for blanks."""
    return deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of all documents linked by 80 of 100 common five-word shingles."""
    return one_of_each(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, sources at weights 1, 2, 3 by name; one row
    for each time a document is fed."""
    return mixed_documents(docs, by_rank(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, packed as little-endian unsigned 32-bit numbers, and
    its ``position`` in training order, which is the order the rows were written in.
    An empty table gives no rows; null and empty texts have begin and end only."""
    ordered = in_written_order(docs.drop("position"))
    return with_tokens(ordered, derive=counted, columns="n_tokens bigint, ids binary", carried=("position",))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentence_pieces", encoded),
]

#: Cosines to learnt centroids and merges of pieces have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared
    folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
