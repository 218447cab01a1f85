"""Registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywake.llm import bpe, conversation_repair, hard_negatives, licenses, near_dup, neighbours, packing, quality, rules, sharding, token_counts, token_file, warc
from tallywake.llm.storage import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_round_trip(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.moved_labels(table(spark, sf_dir, "embeddings")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired_digests(turns, conversation_repair.damage(turns))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_token_file": (op2_token_file, None),
    "op3_bpe": (op3_bpe, None),
    "op4_near_dup": (op4_near_dup, None),
    "op5_packing": (op5_packing, None),
    "op6_neighbours": (op6_neighbours, None),
    "op7_quality": (op7_quality, None),
    "op8_shards": (op8_shards, sharding.oracle()),
    "op9_licenses": (op9_licenses, licenses.oracle()),
    "op10_rules": (op10_rules, None),
    "op11_warc": (op11_warc, warc.oracle()),
    "op12_hard_negatives": (op12_hard_negatives, hard_negatives.oracle()),
    "op13_conversations": (op13_conversations, conversation_repair.oracle()),
}
