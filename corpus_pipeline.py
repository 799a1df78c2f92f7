"""Documents to token ids: the stages of the training-data pipeline, in order.

Each stage takes all documents its predecessor kept and returns the columns of
``documents``; the last one returns token ids beside the digests that prove them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.llm import byte_bpe, decontaminate, line_dedup, pu_quality, simhash
from plenum.llm.common import prepared, saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; labels come from the given table."""
    return pu_quality.keep_good(docs, table(prepared(spark), sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly, go; every document stays."""
    prepared(spark)
    return line_dedup.drop_duplicate_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepared(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, table(prepared(spark), sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and digests of ids and decoded bytes."""
    prepared(spark)
    return byte_bpe.encoded(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_deduplication", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage is written and read again."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
