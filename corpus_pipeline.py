"""From raw documents to token ids: five stages, each a Spark job over all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes what
each returns to the shared folder and reads it for the next, so a failure costs one stage at most. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe_stream, hd_language, minmax_dedup, scratch, spaced_seeds, suffix_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labelled ones are in go: those without text or a letter, and those whose best
    prototype is no nearer than an unrelated vector may be. Null and repeated ids are judged row by row."""
    return hd_language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, likeness 0.8) the document of the smallest id stays.
    Documents without words, and rows without an id, stay; of rows that repeat an id one stays."""
    return minmax_dedup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier one covers are cut out; documents of which nothing is left go, as do null and empty
    ones. Rows without an id lose nothing."""
    return suffix_dedup.deduplicate(docs).where("text <> ''")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go. Null and empty texts and rows without an id stay; so does all without items."""
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests in place of the texts; a null text has no tokens. Other columns stay, whatever their names."""
    return bpe_stream.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("bpe_tokens", tokens),
]

#: SQL can express neither the learnt languages nor the tokens; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
