"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe_stream, hd_language, mil_quality, minmax_dedup, packing, quartile_digest, scratch, spaced_seeds, suffix_dedup, url_reputation, warc_table


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def op4_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_table.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.new_path(spark, "warc")).drop("n_chunks")


def op6_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_language.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests_only=True)


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.new_path(spark, "packed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minmax_near_dedup": op1_minmax_near_dedup,
        "op2_quartile_digest": op2_quartile_digest,
        "op3_suffix_groups": op3_suffix_groups,
        "op4_mil_quality": op4_mil_quality,
        "op5_warc_chunks": op5_warc_chunks,
        "op6_hd_language": op6_hd_language,
        "op7_bpe_stream": op7_bpe_stream,
        "op8_host_reputation": op8_host_reputation,
        "op9_spaced_seeds": op9_spaced_seeds,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_chunks": warc_table.ORACLE_SQL, "op8_host_reputation": url_reputation.ORACLE_SQL}
