"""Corpus preparation from raw documents to tokens, as stages that each read what the one before wrote.

Every stage takes the documents that the one before kept, whole, and all but the last return the columns of documents. Nulls, repeated rows and ids, texts without words,
very long ones and further columns are as the operator of each stage says; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.byte_bpe import round_trip_digests
from sievework.llm.decontaminate import decontaminated
from sievework.llm.language_id import identified
from sievework.llm.near_dedup import keep_one_of_each
from sievework.llm.paragraph_dedup import without_repeated_passages
from sievework.llm.session import cut, documents, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted. A null text, and one without a letter, has none and goes; repeated rows are judged each."""
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of least doc_id. A null doc_id, and a text without words, is alone in its class; rows that repeat the kept id stay."""
    return keep_one_of_each(docs)


def paragraph_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of earlier documents; a document of which nothing is left goes. A null doc_id, or text, stays as it is."""
    return without_repeated_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document with half of its words in them goes. A null text stays."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and hashes of the ids and of the decoded bytes of each document; a null text has no ids."""
    return round_trip_digests(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("paragraph_dedup", paragraph_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL has no form of clustered centroids, component labels and merges by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each result written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
