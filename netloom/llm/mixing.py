"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import BLANKS, free, stored

#: Epochs a source may be read at most.
EPOCHS = 3


def source_targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target).

    Sources rank by code point, null last, and weigh 1, 2, 3, 1, ... A target is the source's
    weighted share of all sizes, but ``epochs`` times its size at most; what is cut off goes to the
    others by weight. That is the water level at which the filled caps and the weighted rest add
    up to the total: with sources ordered by cap / weight, the level after each prefix of filled
    caps is known, and the first source whose cap lies above its level ends the prefix.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", epochs * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)),
        }
    )
    ranked = ranked.withColumn("level", F.col("left_words").cast("double") / F.col("left_weight"))
    over = F.col("level") * F.col("weight") < F.col("cap")
    ranked = ranked.withColumn("water", F.min(F.when(over, F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    share = F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", "rank", F.least(share, F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, carry: list[str] | None = None, seed: int = 17, epochs: int = EPOCHS) -> DataFrame:
    """Each document with the number of times the mix reads it.

    ``docs`` needs doc_id (of any type that sorts), text, source; ``carry`` names further columns to
    keep. A result whose name is also carried gets the ending ``_found``. Adds size
    (words; null text: 0), source_size, target, finish (virtual time of the first copy: words of
    its source up to and including it in shuffled order, divided by the target) and copies.
    All copies of all documents in the order of finish time make the mix, which is cut off where
    its words would exceed the words of all sources. Null source: a source of its own. Empty
    texts have size 0 and take nothing; texts of any length are counted whole. Equal rows are
    documents of their own, ties go by id and size. An empty table gives an empty mix. Reruns agree:
    the shuffle is a hash of the id and the text.

    A source may hold most rows, so running sums are taken in about sqrt(n) blocks of hash range
    with the sums of earlier blocks added; the cut is searched likewise in ranges of finish time.
    """
    own = docs.select(
        *[F.col(c).alias(f"__{c}") for c in carry or ()],
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))), 1, 15), 16, 10).cast("long").alias("shuffle"),
    )
    # Without carried columns all rows are small: words are counted once. Else the texts stay where they are, and are counted again.
    slim = stored(own.drop(*[f"__{c}" for c in carry or ()]), "mix-sizes")
    own = own if carry else slim
    n = max(slim.count(), 1)
    bits = max(1, ceil(log2(n) / 2))
    block = F.shiftright("shuffle", 60 - bits).alias("block")
    own = own.select("*", block)

    blocks = stored(slim.select("source", "size", block).groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = stored(source_targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), epochs), "mix-targets")

    ties = ["shuffle", "doc_id", "size"]
    inside = Window.partitionBy("source", "block").orderBy(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = blocks.alias("b")
    queued = own.withColumn("inside", F.sum("size").over(inside)).alias("q")
    queued = queued.join(b, F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.block") == F.col("b.block")))
    queued = queued.select("q.*", (F.col("b.before") + F.col("q.inside")).alias("upto")).alias("q")
    t = targets.alias("t")
    queued = queued.join(t, F.col("q.source").eqNullSafe(F.col("t.source"))).select("q.*", "t.source_size", "t.rank", "t.target")
    queued = stored(queued, "mix-queue")

    copies = queued.select("rank", "size", *ties[:2], "target", "source_size", "upto", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("copy"))
    copies = copies.filter("size > 0").withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
    grain = 1 << bits
    late = grain + F.floor(grain * F.log2(F.greatest("finish", F.lit(1.0))))
    copies = copies.withColumn("range", F.when(F.col("finish") < 1, F.floor(F.col("finish") * grain)).otherwise(late))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    # One row per range of virtual time: about sqrt(n), so one task orders them.
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("upto", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = ranges.filter(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("words")).first()
    key = F.struct("finish", "rank", "copy", "shuffle", "doc_id", "size")
    last = None
    if at:
        within = Window.orderBy("finish", "rank", "copy", "shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = copies.filter(F.col("range") == at[0]).withColumn("sum", F.sum("size").over(within) + at[1])
        last = cut.filter(F.col("sum") > budget).agg(F.min(key)).first()[0]
    taken = F.lit(0)
    for copy in range(epochs):
        time = (copy * F.col("source_size") + F.col("upto")) / F.col("target")
        mine = F.struct(time, "rank", F.lit(copy), "shuffle", "doc_id", "size")
        kinds = ("double", "int", "int", "long", docs.schema["doc_id"].dataType, "long")
        read = F.lit(True) if last is None else mine < F.struct(*[F.lit(x).cast(k) for x, k in zip(last, kinds, strict=True)])
        taken = taken + F.when((F.col("size") > 0) & read, 1).otherwise(0)
    kept = [c for c in carry or () if c not in ("doc_id", "source")]
    found = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "finish": F.when(F.col("target") > 0, F.col("upto") / F.col("target")), "copies": taken.cast("int")}
    return queued.select(*[F.col(f"__{c}").alias(c) for c in kept], "doc_id", "source", *[c.alias(free(n, kept)) for n, c in found.items()])


def take_mix(docs: DataFrame, seed: int = 17, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix reads, each as often as it is read, in the order of their virtual finish times; all columns stay.

    The order is global: rows are range-sorted, so files in the order of their names hold the mix.
    """
    mixed = mix_sources(docs.withColumn("__row", F.struct(*docs.columns)), ["__row"], seed, epochs)
    read = mixed.filter("copies > 0").select("__row", "finish", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), (F.col("source_size") / F.col("target")).alias("lap"))
    time = F.col("finish") + (F.col("copy") - 1) * F.col("lap")
    return read.select("__row", time.alias("time")).repartitionByRange("time").sortWithinPartitions("time").select("__row.*")
