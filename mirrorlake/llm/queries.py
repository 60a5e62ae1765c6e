"""The thin queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, chat_format, license_scan, lm_score, merkle_manifest, near_duplicates, ogg_audio, packing, quality_model, quality_rules, token_counts, toxicity, vector_codes
from .common import documents, labels


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=1024, with_ids=False)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_held_out(documents(spark, sf_dir), mod=10, held=0)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digests(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(documents(spark, sf_dir), words=2, percent=80)


def op8_ogg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_audio.store(documents(spark, sf_dir), with_media=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), limit=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir), fanout=2, tampered=merkle_manifest.every_seventh)


ALL = (op1_packing, op2_license_scan, op3_quality_rules, op4_quality_model, op5_lm_score, op6_bpe_codec, op7_near_duplicates, op8_ogg_audio, op9_token_counts, op10_toxicity, op11_chat_format, op12_vector_codes, op13_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op11_chat_format": chat_format.oracle(), "op12_vector_codes": vector_codes.oracle(), "op13_merkle_manifest": merkle_manifest.oracle()}
