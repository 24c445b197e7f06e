"""Registered queries of the subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, lm, main_text, minhash, mixing, negatives, pii, quality, repeats, secrets, simhash, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the near-duplicate contract.
SHINGLE, MAX_BITS = 3, 2


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stupid_backoff(table(spark, sf_dir, "documents"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "finish")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"), repeats.planted)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), lambda vec_id: vec_id % 50 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_lm_scores, op2_simhash_near_duplicates, op3_benchmark_decontamination, op4_mix_sources, op5_quality_classifier, op6_secret_scan,
    op7_minhash_fingerprints, op8_url_filter, op9_license_scan, op10_personal_data,
    op11_main_text, op12_periodic_runs, op13_hard_negatives)}

SQL: dict[str, str] = {"op1_lm_scores": lm.LM_SQL, "op4_mix_sources": mixing.MIX_SQL, "op8_url_filter": urls.URL_SQL,
                       "op13_hard_negatives": negatives.NEGATIVES_SQL}
