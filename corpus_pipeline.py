"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that the one before it kept and decides alone what it drops or changes; all
but the last return the columns of documents, whatever others there are and however they are named. Repeated rows are
documents of their own until near-dedup keeps one of them. An empty table passes all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import stored, table
from tidemark.llm.decontam import drop_leaks
from tidemark.llm.langid import keep_identified
from tidemark.llm.packing import pack_documents
from tidemark.llm.secret_scan import redact_secrets
from tidemark.llm.simhash import keep_first


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if no language has more than half of their words' probability: null texts, those without letters, mixtures."""
    return keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id; all texts without words are one class."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null items and texts leak nothing."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null and empty texts as they are."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences, which ``packing.sequences`` puts together."""
    return pack_documents(docs, with_ids=True)


STAGES = [("language ID", language), ("SimHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate), ("secret scans", redact), ("best-fit packing", pack)]

#: SQL can't express the learned, iterative and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
