"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearcite.llm import (
    decontamination,
    filter_audit,
    html_extraction,
    kneser_ney,
    license_scan,
    line_dedup,
    near_dedup,
    pii,
    piece_coding,
    quality_classifier,
    quality_rules,
    ranked_search,
    sql,
    toxicity,
)
from nearcite.llm.common import documents


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(documents(spark, sf_dir))


def op8_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.report(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(documents(spark, sf_dir))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kneser_ney, op2_near_dedup, op3_quality_rules, op4_pii, op5_line_dedup, op6_html_extraction,
        op7_decontamination, op8_piece_coding, op9_quality_classifier, op10_license_scan, op11_toxicity, op12_ranked_search,
        op13_filter_audit,
    )
}
#: The other methods rest on models, pieces or trees: tests/llm holds them against plain Python.
ORACLES: dict[str, str] = {
    "op2_near_dedup": sql.NEAR_DEDUP,
    "op3_quality_rules": sql.QUALITY_RULES,
    "op5_line_dedup": sql.LINE_DEDUP,
    "op7_decontamination": sql.DECONTAMINATION,
    "op10_license_scan": sql.LICENSE_SCAN,
    "op12_ranked_search": sql.RANKED_SEARCH,
    "op13_filter_audit": sql.FILTER_AUDIT,
}
