"""Helpers shared by the corpus operators: tables in the shared folder, words, components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a Java regex class body.
BLANKS = r"\x20\x09-\x0D"
#: Where to write in a local session that names no shared folder.
OWN_FOLDER = "/tmp/checkpoints/netloom"
#: Keys with over a KEYS-th of all rows, and over LEAST_HOT of them, are hot: there are fewer than KEYS.
KEYS, LEAST_HOT = 1000, 10_000
#: Links up to so many need no look at their hubs: all that a node can have is little work for a task.
FEW_LINKS = 1_000_000
#: Rows of texts that a Python worker has in hand at a time.
SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session, whose driver is the executor too, may do without and gets one of our own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that driver and executors share")
    return OWN_FOLDER


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def free(name: str, taken: list[str]) -> str:
    """The name of a result column: with the ending ``_found`` where a carried column has that name."""
    while name in taken:
        name += "_found"
    return name


def written(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write ``df`` to the shared folder as Parquet: its path, and the table read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` written to the shared folder and read back.

    A lost executor loses nothing of it, and later steps don't compute it again.
    """
    return written(df, name)[1]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return memory that is free in this worker to the system; Python workers stay for later tasks, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def in_slices(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over slices of at most so many rows, as what is made of texts is larger than they are; at its end memory is given back."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches))
        give_back()

    return bounded


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def join_named(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``named``, which has one row a key and in ``n`` how many of the rows have it; inner, no null keys.

    A key may hold a third of all rows. Hot keys, fewer than KEYS by their definition, are
    broadcast, so their rows stay where they are; all other keys meet in a shuffle. ``named`` and
    ``rows`` are read twice.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    bound = max(LEAST_HOT, total // KEYS)
    if total <= LEAST_HOT:
        return rows.join(named.drop(n), key)
    hot = named.filter(F.col(n) > bound)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.filter(F.col(n) <= bound).drop(n), key)
    return cold.unionByName(rows.join(F.broadcast(hot.drop(n)), key).select(*cold.columns))


def components(links: DataFrame, name: str = "components", max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected links (a long, b long).

    Returns (node, component), component being the smallest node reachable. Each round joins
    every node's neighbours to the smallest of them (large star), then halves the paths to the
    root (small star); rounds grow as the logarithm of the longest chain. Edges are one row per
    neighbour and never gathered; hubs are joined apart. Each round's table is written to the
    shared folder, and deleted when the next one is there.
    """
    spark = links.sparkSession

    def round_of(edges: DataFrame, i: int) -> tuple[str, DataFrame, tuple]:
        path, out = written(edges, f"{name}-{i}")
        return path, out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old: list[str] = []

    def kept(table: DataFrame, i: int) -> DataFrame:
        path, out = written(table, f"{name}-part-{i}")
        old.append(path)
        return out

    def with_least(pairs: DataFrame, many: bool, i: int) -> DataFrame:
        """``pairs`` (u, v) with ``m``, the least v of their u."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return join_named(pairs, kept(least, i), "u") if many else pairs.join(least.drop("n"), "u")

    first = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    path, edges, mark = round_of(first, 0)
    for i in range(1, max_rounds):
        many = mark[0] > FEW_LINKS
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, many, i).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = with_least(kept(large.distinct(), i) if many else large, many, i)
        pairs = large.select("m", F.explode(F.array("u", "v")).alias("x")).filter("x <> m")
        small = pairs.select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()
        old.append(path)
        before = mark
        path, edges, mark = round_of(small, i)
        discard(spark, *old)
        old.clear()
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
