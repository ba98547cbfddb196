"""The registered queries of the operators: thin calls over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment
from .class_lm import score_documents
from .common import table
from .decontam import find_leaks
from .langid import identify_languages
from .license_scan import oracle_sql as license_sql
from .license_scan import scan_licenses
from .mixing import mix_documents
from .mixing import oracle_sql as mixing_sql
from .packing import pack_documents
from .periodic import periodic_runs, run_digest, with_planted_runs
from .quality import quality_rules
from .secret_scan import scan_secrets
from .simhash import near_duplicates
from .token_counts import token_counts
from .toxicity import grade_toxicity


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination, op2_toxicity, op3_secret_scan, op4_token_counts, op5_class_lm, op6_language_id, op7_simhash, op8_best_fit_packing,
            op9_quality_rules, op10_license_scan, op11_periodic_runs, op12_token_alignment, op13_source_mix,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": license_sql(), "op13_source_mix": mixing_sql()}
