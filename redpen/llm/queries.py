"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, lm, nbest, packing, quality, simhash, substrings, suffixes, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_token_counts, op3_nbest, op4_lm_scores, op5_quality, op6_substrings, op7_simhash, op8_licenses, op9_suffixes, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_substrings": substrings.deduplicated_sql(), "op8_licenses": licenses.scan_sql()}
