"""Queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailquarry.llm import chat, decontaminate, langid, license, mixing, pii, sharding, simhash, syncmers, toxicity
from mailquarry.llm.common import table


#: Key of the registered query; a caller brings a secret one.
PII_KEY = "registered query"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "pii")


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_swapped_answers(table(spark, sf_dir, "conversations"))
    return chat.preference_segments(turns, chat.adjacent_pairs(turns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.notices(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_pairs(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_preferences, op3_toxicity, op4_syncmers, op5_mixing, op6_simhash, op7_sharding, op8_decontamination, op9_licenses, op10_language_id)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that DuckDB can express; the others are tested against brute force in tests/llm."""
    return {"op2_preferences": chat.ORACLE_SQL, "op8_decontamination": decontaminate.ORACLE_SQL, "op9_licenses": license.oracle_sql()}
