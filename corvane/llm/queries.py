"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import alignment, bpe_chunks, centroids, crf, decontaminate, line_dedup, minhash, quality, shards, simhash, token_counts, token_files, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_table(_docs(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.predict(_docs(spark, sf_dir))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(_docs(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_docs(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_docs(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_docs(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_docs(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_docs(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_docs(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_chunks": op1_bpe_chunks,
    "op2_warc": op2_warc,
    "op3_crf_language": op3_crf_language,
    "op4_shards": op4_shards,
    "op5_token_counts": op5_token_counts,
    "op6_token_files": op6_token_files,
    "op7_minhash": op7_minhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_alignment": op11_alignment,
    "op12_simhash": op12_simhash,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.PAGES_SQL,
    "op7_minhash": minhash.LINKS_SQL,
    "op8_line_dedup": line_dedup.LINE_SQL,
    "op10_quality_rules": quality.QUALITY_SQL,
    "op13_centroids": centroids.CLUSTER_SQL,
}
