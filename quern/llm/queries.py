"""The corpus operators applied to their whole tables, by query name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, html_crf, katz, langid, licenses, mixing, pii, quality_model, rule_ledger, simhash
from quern.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clustered(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("row_key")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extracted(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judged(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_katz_scoring, op3_simhash_near_dedup, op4_pii, op5_language_id,
        op6_source_mixing, op7_benchmark_decontamination, op8_html_extraction, op9_license_scan, op10_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_source_mixing": mixing.ORACLE_SQL, "op9_license_scan": licenses.ORACLE_SQL, "op10_quality_rules": rule_ledger.ORACLE_SQL}
