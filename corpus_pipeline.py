"""The corpus pipeline: quality rules, quality classifier, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywake.llm import near_dup, packing, quality, rules
from tallywake.llm.storage import stored, table


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the isolation forest keep."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dup.keep_one(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every kept document in windows of at most 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", apply_rules),
    ("quality classifier", classify),
    ("near copies", drop_near_copies),
    ("packing", pack_windows),
]

#: Trees, min-hashing and packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
