"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, source mixing and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetframe.llm._common import cut, table
from facetframe.llm.decontaminate import clean
from facetframe.llm.langid import spoken
from facetframe.llm.minhash import deduplicated
from facetframe.llm.mixing import repeated
from facetframe.llm.sharding import byte_balanced


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language: a null or empty text, or one without a letter, or one that fits no language clearly.

    Repeated rows go or stay together; an empty table stays empty. All columns are as they are.
    """
    return spoken(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the smallest doc_id, first by its text.

    Rows of one doc_id are one document, repeated ones too. A null text, and one without words, is alike to no other. Rows of a
    null doc_id are documents of their own. An empty table stays empty. All columns are as they are.
    """
    return deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that overlap an item of the benchmark; null and empty texts and items overlap nothing.

    Repeated rows go or stay together; without items, or without rows, nothing changes. All columns are as they are.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows as the weights of their sources ask; drops none. A null source is one of its own.

    A null or empty text counts one token; an empty table stays empty. All columns are as they are.
    """
    return repeated(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-balanced shards and slots: the manifest of the corpus, a row for each row.

    Equal texts, a null one as an empty one, share a shard; repeated rows have slots of their own. An empty table gives an
    empty manifest; other columns are left out.
    """
    return byte_balanced(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding),
]

#: Code lengths, MinHash candidates and differencing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read by the next; an empty table gives an empty manifest."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
