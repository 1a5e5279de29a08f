"""Corpus pipeline: five stages, each one operator over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet into the shared folder
and read back as the next stage's documents; what a stage stored on its way goes when its result is written.  All but
the last return the columns of ``documents``.

Defined results for odd input: a null or empty text has no 50 words, so the rules reject it; a null doc_id is a value
like any other and never speaks for a group that has another id; of repeated rows one stays; a caller's further
columns, whatever their names, keep their values; very long texts are worked on whole; ties go to the least doc_id;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import bpe, decontaminate, minhash, quality, substrings
from veldspar.llm.common import dropped, scratch, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words or more that stand elsewhere too."""
    return substrings.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the final texts, and what they decode to."""
    return bpe.encoded(docs, full=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]

#: MinHash groups are connected components and BPE merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            done = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        dropped(docs)
        docs = done
    return docs
