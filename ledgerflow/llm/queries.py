"""The queries opN_<name>: each applies its operator, with production parameters, to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import read_table
from ledgerflow.llm.decontaminate import contaminated
from ledgerflow.llm.hmm import lm_scores
from ledgerflow.llm.license_scan import license_scan, license_scan_sql
from ledgerflow.llm.packing import pack
from ledgerflow.llm.quality import quality_scores
from ledgerflow.llm.secret_scan import secret_scan
from ledgerflow.llm.simhash import near_duplicates
from ledgerflow.llm.token_counts import token_counts
from ledgerflow.llm.topk import exact_top_k, exact_top_k_sql
from ledgerflow.llm.toxicity import toxicity_scores


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_secret_scan, op4_simhash_near_dedup, op5_best_fit_packing, op6_toxicity, op7_quality_classifier, op8_benchmark_decontamination, op9_exact_top_k, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan_sql(), "op9_exact_top_k": exact_top_k_sql()}
