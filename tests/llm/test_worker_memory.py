"""A Python worker holds few texts' shingles at a time, and keeps no free memory for later."""

import numpy as np
import psutil
import pyarrow as pa

from netloom.llm import common


def test_batches_come_in_slices_and_whole():
    seen = []

    def run(batches):
        for b in batches:
            seen.append(b.num_rows)
            yield b

    given = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (1201, 0, 3)]
    got = list(common.in_slices(run)(iter(given)))
    assert max(seen) <= common.SLICE and pa.Table.from_batches(got).column("x").to_pylist() == [*range(1201), *range(3)]


def test_free_memory_goes_back_to_the_system():
    own = lambda: psutil.Process().memory_info().rss / 1e6

    def run(batches):
        for b in batches:
            held = [np.ones(2000) for _ in range(10_000)]  # 160 MB of small pieces
            yield b
            last = held[-1]  # one piece at the end of the heap keeps all below it
            del held
        assert len(last)

    one = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    list(common.in_slices(run)(iter([one])))
    before = own()
    list(run(iter([one])))
    list(common.in_slices(run)(iter([one])))
    assert own() - before < 60


def test_stages_of_near_copies_read_slices(spark, monkeypatch):
    from pyspark.sql import functions as F

    from netloom.llm import simhash

    rows = []
    monkeypatch.setattr(simhash, "in_slices", lambda run, rows_=7: (rows.append(rows_), common.in_slices(run, rows_))[1])
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g h i j"), (F.col("id") % 4).cast("string")).alias("text"))
    kept = sorted(r[0] for r in simhash.keep_one(docs).select("doc_id").collect())
    assert len(rows) >= 3 and kept[0] == 0 and len(kept) == len({*kept}) <= 4
