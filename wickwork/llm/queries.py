"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wickwork.llm import alignment, bpe, exact_dedup, fingerprint, knn, langid, merkle, mixing, ngram_join, pii, quality, token_count, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_read(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.grouped(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("w_key")


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"), tamper=merkle.tampered()).drop("w_path")


def queries() -> dict:
    return {
        "op1_voronoi_topk": op1_voronoi_topk,
        "op2_token_counts": op2_token_counts,
        "op3_quality": op3_quality,
        "op4_url_filters": op4_url_filters,
        "op5_ngram_join": op5_ngram_join,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pii": op8_pii,
        "op9_mixing": op9_mixing,
        "op10_bpe_encode_decode": op10_bpe_encode_decode,
        "op11_fingerprints": op11_fingerprints,
        "op12_alignment": op12_alignment,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_voronoi_topk": knn.ORACLE_SQL,
        "op4_url_filters": url_filter.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op13_merkle": merkle.ORACLE_SQL,
    }
