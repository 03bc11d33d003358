"""The registered queries of the training-data operators: ``opN_<name>`` over whole tables, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import codes, language, licences, linecrf, linededup, mixing, packing, permuterm, repetition, secrets, simhash, tokencount, topk
from tickloom.llm.common import table
from tickloom.plans.registry import Registry

R = Registry()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents"))


R.add("op1_quality_rules", op1_quality_rules)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.domain_labels(table(spark, sf_dir, "labels"))
    return mixing.report(table(spark, sf_dir, "documents"), labels, mixing.TARGETS)


R.add("op2_source_mixing", op2_source_mixing)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


R.add("op3_language_id", op3_language_id)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


R.add("op4_best_fit_packing", op4_best_fit_packing)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


R.add("op5_exact_topk", op5_exact_topk, topk.SQL)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


R.add("op6_secret_scans", op6_secret_scans, secrets.sql())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


R.add("op7_token_counts", op7_token_counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


R.add("op8_line_dedup", op8_line_dedup)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


R.add("op9_license_scans", op9_license_scans)


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


R.add("op10_simhash_neardup", op10_simhash_neardup)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


R.add("op11_quality_classifier", op11_quality_classifier)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.variants(table(spark, sf_dir, "documents"))


R.add("op12_spelling_variants", op12_spelling_variants, permuterm.SQL)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"))


R.add("op13_vector_codes", op13_vector_codes, codes.sql())
