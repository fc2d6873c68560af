"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recfuse.llm import ngram_join, packing, quality_rules, secrets, suffix_dedup
from recfuse.llm.common import stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least doc_id."""
    return ngram_join.keep_first(docs)


#: Passages of this many words that start anywhere else too are removed; none of them is shorter than the strings compared.
PASSAGE_WORDS = 50
PASSAGE = suffix_dedup.Cut(length=200, window=128)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more (and 200 bytes) that start anywhere else too."""
    return suffix_dedup.remove(docs, PASSAGE, PASSAGE_WORDS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("n-gram join", one_of_each), ("suffix dedup", without_repeats), ("secret scan", redacted), ("packing", packed)]

#: The tokenizers and the packing can't be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
