"""Run-disjoint and temporal splits, chronology, coverage of labels and runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.sources.shared import stored


def by_plan(df: DataFrame, plan: dict[int, str], run: str = "run_id") -> DataFrame:
    """``df`` with the split that a campaign plans for each run; runs that it lacks are null."""
    mapping = F.create_map(*[F.lit(x) for kv in plan.items() for x in kv])
    return df.withColumn("split", F.try_element_at(mapping, F.col(run)))


def hold_out_runs(df: DataFrame, run: str = "run_id", test: int | None = None, val: int | None = None) -> DataFrame:
    """``df`` with split: the test run (the greatest by default), the validation run if given, else train."""
    top = df.agg(F.max(run).alias("__top"))
    d = df.join(F.broadcast(top)) if test is None else df.withColumn("__top", F.lit(test))
    split = F.when(F.col(run) == F.col("__top"), "test")
    if val is not None:
        split = split.when(F.col(run) == val, "val")
    return d.withColumn("split", split.otherwise("train")).drop("__top")


def real_split(df: DataFrame, run: str = "run_id", time: str = "timestamp", tie: str | None = None, seed: int = 0) -> tuple[DataFrame, str]:
    """``df`` with split, and how: the last run tests where there are several, else the latest 30 % by time, else 30 % by a hash."""
    if run in df.columns and df.filter(F.col(run).isNotNull()).select(run).distinct().limit(2).count() > 1:
        return hold_out_runs(df, run), "last run"
    if time in df.columns:
        return by_time(df, time, tie or time, 0.3), "latest 30 % by time"
    row = F.xxhash64(F.lit(seed), *[F.col(c) for c, kind in df.dtypes if "map<" not in kind])
    return df.withColumn("split", F.when(F.pmod(row, F.lit(1000)) < 300, "test").otherwise("train")), "30 % by hash"


def ranks(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 1 by a total order, without gathering all rows in one task.

    Rows are dealt in ranges of all order columns, so ties of the first are no hot range, and
    written with their range; a range's ranks start behind the counts of earlier ranges, of which
    there is one row each.
    """
    d = stored(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "ranges")
    counts = d.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return d.withColumn("__r", inside).join(F.broadcast(before), "__b").withColumn("rank", (F.col("__before") + F.col("__r")).cast("long")).drop("__b", "__r", "__before")


def running_ranges(df: DataFrame, order: list[str], value: str, key: str, carry: list[str]) -> DataFrame:
    """``key``, ``carry`` and ``<value>_upto`` of the rows that have a key: the sum over all rows up to and with this one by ``order``.

    Rows are dealt in ranges of all order columns and sorted there; a whole number is summed as they
    pass, a batch at a time. Only rows with a key are written, with one row a range for its sum, and
    the sums of earlier ranges are added. Rows alike in ``order`` come in any order.
    """
    upto, columns = f"{value}_upto", [key, *carry]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, total, last = TaskContext.get().partitionId(), 0, None
        names = [*columns, upto, "__b"]
        for last in batches:
            sums = np.cumsum(last.column(value).to_numpy(zero_copy_only=False)) + total
            total = int(sums[-1]) if len(sums) else total
            held = last.select(columns).append_column(upto, pa.array(sums, pa.int64())).filter(pc.is_valid(last.column(key)))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(np.full(len(held), b), pa.int32())], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, last.column(c).type) for c in columns), pa.array([total], pa.int64()), pa.array([b], pa.int32())], names=names)

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, F.col(value).cast("long"))
    d = stored(dealt.mapInArrow(run, ", ".join([*kinds, f"`{upto}` long, __b int"])), "ranges")
    before = d.filter(F.col(key).isNull()).select("__b", F.coalesce(F.sum(upto).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return d.filter(F.col(key).isNotNull()).join(F.broadcast(before), "__b").select(*columns, (F.col("__before") + F.col(upto)).alias(upto))


def by_time(df: DataFrame, time: str, tie: str, test_share: float) -> DataFrame:
    """``df`` with split: the first int((1 - share) n) rows by time train, the rest tests."""
    n = df.count()
    return ranks(df, [time, tie]).withColumn("split", F.when(F.col("rank") <= int((1 - test_share) * n), "train").otherwise("test")).drop("rank")


def chronology(df: DataFrame, time: str, split: str = "split") -> DataFrame:
    """One row: bounds by split and whether train < val < test strictly.

    Without validation rows, train must lie before test. Times that are null or not finite don't
    count; where a needed bound is unknown, ``ordered`` is null.
    """
    t = F.col(time).cast("double")
    fine = F.when(F.abs(t) < float("inf"), t)
    at = lambda f, s: f(F.when(F.col(split) == s, fine))
    d = df.agg(at(F.max, "train").alias("train_max"), at(F.min, "val").alias("val_min"), at(F.max, "val").alias("val_max"), at(F.min, "test").alias("test_min"), F.count_if(F.col(split) == "val").alias("__val"))
    three = (F.col("train_max") < F.col("val_min")) & (F.col("val_max") < F.col("test_min"))
    known = F.col("train_max").isNotNull() & F.col("test_min").isNotNull() & ((F.col("__val") == 0) | F.col("val_min").isNotNull())
    return d.withColumn("ordered", F.when(known, F.when(F.col("__val") == 0, F.col("train_max") < F.col("test_min")).otherwise(three))).drop("__val")


def manifest(df: DataFrame, time: str, run: str = "run_id", split: str = "split") -> DataFrame:
    """(split, run, rows, ts_min, ts_max): whole seconds."""
    whole = lambda c: F.floor(c).cast("long")
    return df.groupBy(split, run).agg(F.count("*").alias("rows"), whole(F.min(time)).alias("ts_min"), whole(F.max(time)).alias("ts_max"))


def missing_labels(df: DataFrame, expected: list[str], splits: list[str], label: str = "label", split: str = "split") -> DataFrame:
    """(split, label) that are expected and absent."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(s, x) for s in splits for x in expected], "split string, label string")
    return grid.exceptAll(df.select(F.col(split).alias("split"), F.col(label).alias("label")).distinct())


def unexpected_labels(df: DataFrame, expected: list[str], label: str = "label") -> DataFrame:
    return df.select(F.col(label).alias("label")).distinct().filter(~F.col("label").isin(*expected))


def coverage(spark: SparkSession, planned: list, observed: DataFrame, column: str) -> DataFrame:
    """(value, side): what is planned and not observed, or observed and not planned, with repeats."""
    kind = observed.schema[column].dataType.simpleString()
    p = spark.createDataFrame([(x,) for x in planned], f"value {kind}")
    o = observed.select(F.col(column).alias("value"))
    return p.exceptAll(o).withColumn("side", F.lit("missing")).unionByName(o.exceptAll(p).withColumn("side", F.lit("extra")))


def union_runs(frames: list[DataFrame]) -> DataFrame:
    """Rows of all runs; every run must have the same columns of compatible types."""
    first = frames[0]
    for f in frames[1:]:
        if set(f.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(f.columns) ^ set(first.columns))}")
        numeric = ("int", "bigint", "double", "float", "smallint")
        for c, kind in f.dtypes:
            other = dict(first.dtypes)[c]
            if kind != other and not (kind in numeric and other in numeric):
                raise ValueError(f"{c}: {other} and {kind}")
    out = first
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def schema_difference(df: DataFrame, official: list[str]) -> tuple[list[str], list[str]]:
    """Columns that are missing, and extra ones."""
    return [c for c in official if c not in df.columns], [c for c in df.columns if c not in official]


def run_of_path(path: Column, ordinal: Column) -> Column:
    found = F.regexp_extract(path, r"run[_-]?(\d+)", 1)
    return F.when(found != "", found.try_cast("int")).otherwise(ordinal)
