"""The registered queries ``opN_<name>`` and ``pipeline`` of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bagminhash,
    collocations,
    context_tree,
    conversation_trie,
    decontaminate,
    digest_merge,
    langid,
    licenses,
    main_text,
    quality_rules,
    secrets,
    sharding,
    spm_tokens,
)
from .common import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(spark, read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.page_report(read_table(spark, sf_dir, "pages"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_report(spark, read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(spark, read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(spark, read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(spark, read_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicate_report(spark, read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_tokens.token_report(spark, read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie_report(spark, read_table(spark, sf_dir, "conversations"))


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_merge.duplicate_report(spark, read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocation_report(spark, read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_main_text": op2_main_text,
    "op3_context_tree": op3_context_tree,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_license_scan": op7_license_scan,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_exact_duplicates": op12_exact_duplicates,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.REPORT_SQL,
    "op7_license_scan": licenses.REPORT_SQL,
    "op9_decontamination": decontaminate.REPORT_SQL,
    "op11_conversation_trie": conversation_trie.REPORT_SQL,
    "op12_exact_duplicates": digest_merge.REPORT_SQL,
    "op13_collocations": collocations.REPORT_SQL,
}
