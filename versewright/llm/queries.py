"""The queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, licenses, line_dedup, mixing, nearest, pieces, quality_model, quality_rules, simhash, token_counts
from .common import table, tokenizer_path
from .sql import OP2_SQL, OP7_SQL


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op1(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op2(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op4(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.op6(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op8(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op10(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_token_counts, op2_line_dedup, op3_quality_classifier, op4_license_scans, op5_simhash_near_dedup,
        op6_nearest_neighbours, op7_quality_rules, op8_sentencepiece, op9_source_mixing, op10_language_id,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op7_quality_rules": OP7_SQL, "op9_source_mixing": mixing.OP9_SQL}
