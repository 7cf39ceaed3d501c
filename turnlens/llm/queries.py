"""The registry of this subpackage's queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnlens.llm import align, anchors, decontaminate, gam, jaccard, licenses, rules, secrets, spm, tokencount, toxicity, trie, wrapper
from turnlens.llm.oracle import ORACLE_SQL as ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def token_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.digest(_read(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(_read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(_read(spark, sf_dir, "documents"), token_file("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.digest(_read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.digest(_read(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(_read(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"), token_file("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(_read(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_secret_scan,
        op3_jaccard_join,
        op4_license_scan,
        op5_token_counts,
        op6_quality_rules,
        op7_sentencepiece,
        op8_quality_classifier,
        op9_substring_dedup,
        op10_html_extraction,
        op11_tokenizer_alignment,
        op12_prefix_trie,
        op13_toxicity,
    )
}
