"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import bpe, embedding_dedup, langid, mixing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, warc
from netloom.llm.common import new_folder, table


#: The vocabulary file that the encoding query uses; a parameter of the operator.
WORD_BPE = "word_bpe_49k.json"


def remainder(column: str, by: int) -> Column:
    """crc32 of an id written as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % by


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; nulls, ties, repeats and empty tables as ``mixing.mix_sources`` says."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels outside the fold; odd rows as ``toxicity.score`` says."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 3) == 1
    sample = toxicity.bounded_sample(labels.filter(~held_out), "toxic")
    labelled = toxicity.labelled_texts(docs, sample)  # SAMPLE rows at most
    model = toxicity.fit(labelled)
    return toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; odd rows as ``simhash.with_components`` says."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labels outside the fold; odd rows as ``quality_classifier.score`` says."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    sample = toxicity.bounded_sample(labels.filter(~held_out), "quality", quality_classifier.SAMPLE)
    labelled = toxicity.labelled_texts(docs, sample)  # SAMPLE rows at most
    model = quality_classifier.fit(labelled)
    return quality_classifier.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of words that repeats an earlier passage; odd rows as ``suffix_dedup.find_repeats`` says."""
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; odd rows as ``warc.write_archives`` says."""
    folder = new_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the fold; odd rows as ``langid.identify`` says."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    known = langid.profiles(docs.filter(~held_out))
    return langid.identify(docs.withColumn("held_out", held_out), known, ["doc_id", "held_out"])


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; odd rows as ``embedding_dedup.near_vectors`` says."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; odd rows as ``quality_rules.apply_quality_rules`` says."""
    judged = quality_rules.apply_quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; odd rows as ``bpe.encode`` says."""
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), ["doc_id"])


QUERIES = {"op1_mix_sources": op1_mix_sources, "op2_toxicity": op2_toxicity, "op3_simhash_near_dedup": op3_simhash_near_dedup, "op4_quality_classifier": op4_quality_classifier, "op5_suffix_array_dedup": op5_suffix_array_dedup, "op6_warc": op6_warc, "op7_language_id": op7_language_id, "op8_embedding_near_dedup": op8_embedding_near_dedup, "op9_quality_rules": op9_quality_rules, "op10_bpe": op10_bpe}
