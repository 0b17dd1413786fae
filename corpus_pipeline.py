"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but
the last return the columns of documents. Nulls, empty and very long texts, repeated rows, empty tables
and further columns are handled as the operators' docstrings say: quality rules reject null and empty
texts, of repeated rows one stays, and a null doc_id stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symatlas.llm import common, decontaminate, near_dedup, packing, quality_rules, suffix_dedup

#: Words of a shingle where no contract says otherwise.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly supervised rules reject."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that of the smallest doc_id."""
    return near_dedup.keep_first(docs, SHINGLE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of over 50 words, or of 400 bytes, that is found elsewhere; emptied documents stay, with an empty text."""
    return suffix_dedup.strip(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Quality posteriors and the packing of windows are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
