"""A corpus pipeline of five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from netloom.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go from the text."""
    return suffix_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document read twice is two rows."""
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded: one row of counts and digests for each row."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(WORD_BPE), ["doc_id", "source"])


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("mix_sources", mix), ("bpe", tokens)]
#: DuckDB has no XXH64, so SQL can't express the fingerprints; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
