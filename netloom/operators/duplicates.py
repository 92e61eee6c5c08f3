"""Identical feature vectors: groups, conflicts, leakage between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_hash(df: DataFrame, features: list[str]):
    """256 bits over the features, null apart from every value, so that wide rows shuffle as one key."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in features]
    return F.sha2(F.concat_ws("\u001f", *cells), 256)


def groups(df: DataFrame, features: list[str], run: str | None, split: str | None, label: str | None) -> DataFrame:
    """One row for each vector that occurs twice or more: n, runs, splits, labels, label_set."""
    absent = F.lit(None).cast("string")
    cols = [(F.col(c) if c else absent).alias(n) for c, n in ((run, "__run"), (split, "__split"), (label, "__label"))]
    keyed = df.select(feature_hash(df, features).alias("vector"), *cols)
    g = keyed.groupBy("vector").agg(
        F.count("*").alias("n"),
        F.size(F.collect_set("__run")).alias("runs"),
        F.size(F.collect_set("__split")).alias("splits"),
        F.sort_array(F.collect_set("__label")).alias("label_set"),
    )
    return g.filter("n > 1").withColumn("labels", F.size("label_set"))


def statistics(df: DataFrame, features: list[str], run: str | None = None, split: str | None = None, label: str | None = None) -> DataFrame:
    """One row: exact, cross-run, cross-split and conflicting groups; rows and rate of cross-split ones."""
    total = df.agg(F.count("*").alias("rows"))
    g = groups(df, features, run, split, label).agg(
        F.count("*").alias("exact_duplicate_groups"),
        F.count_if(F.col("runs") > 1).alias("cross_run_duplicate_groups"),
        F.count_if(F.col("splits") > 1).alias("cross_split_duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("splits") > 1, F.col("n"))), F.lit(0)).alias("cross_split_duplicate_rows"),
        F.count_if(F.col("labels") > 1).alias("conflicting_label_groups"),
    )
    rate = F.when(F.col("rows") > 0, F.col("cross_split_duplicate_rows") / F.col("rows")).otherwise(F.lit(0.0))
    return g.join(total).withColumn("cross_split_duplicate_rate_raw", rate).drop("rows")


def conflicts(df: DataFrame, features: list[str], label: str, examples: int = 5) -> DataFrame:
    """Up to ``examples`` label sets of vectors with several labels."""
    return groups(df, features, None, None, label).filter("labels > 1").orderBy("label_set", "vector").select("label_set").limit(examples)


def mark_cross_split(df: DataFrame, features: list[str], split: str) -> DataFrame:
    """``df`` with n_splits, the number of splits that hold the row's vector."""
    keyed = df.withColumn("__v", feature_hash(df, features))
    counts = keyed.groupBy("__v").agg(F.count_distinct(split).alias("n_splits"))
    return keyed.join(counts, "__v").drop("__v")


def row_overlap(real: DataFrame, other: DataFrame, features: list[str]) -> DataFrame:
    """(n_rows, n_shared, share): rows of ``other`` whose vector ``real`` has too."""
    known = real.select(feature_hash(real, features).alias("__v")).distinct().withColumn("__hit", F.lit(1))
    j = other.select(feature_hash(other, features).alias("__o")).join(known, F.col("__o") == F.col("__v"), "left")
    out = j.agg(F.count("*").alias("n_rows"), F.count("__hit").alias("n_shared"))
    return out.withColumn("share", F.when(F.col("n_rows") > 0, F.col("n_shared") / F.col("n_rows")).otherwise(F.lit(0.0)))


def same_content(inputs: DataFrame, digest: str = "sha256") -> DataFrame:
    """Digests that several inputs share, with the inputs' number."""
    return inputs.groupBy(digest).agg(F.count("*").alias("n")).filter("n > 1")
