"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netloom.llm.common import free, stored

#: Ranks of a profile; also the distance of an n-gram that a profile lacks.
RANKS = 300
LONGEST = 3
#: Profiles are sent to the workers: RANKS n-grams a language, of about so many languages at once.
AT_ONCE = 2000
#: n-grams that a worker gathers before it adds them up, and different ones that it holds before it passes them on.
GATHERED, HELD = 2_000_000, 4_000_000
UNKNOWN = "und"
#: Stands for a word boundary.
EDGE = 1


@cache
def letters() -> np.ndarray:
    """Of each code point: itself if it is a letter, else EDGE."""
    return np.fromiter((c if chr(c).isalpha() else EDGE for c in range(sys.maxunicode + 1)), dtype=np.int64, count=sys.maxunicode + 1)


def ngrams(text: str | None) -> np.ndarray:
    """All n-grams of 1 to LONGEST letters of the lower-cased text, as numbers with repeats.

    A run of other characters is one word boundary, and the text's ends are boundaries too; no
    n-gram has a boundary inside, and none is a boundary alone. Each character takes 21 bits.
    """
    if not text:
        return np.empty(0, dtype=np.int64)
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    codes = np.concatenate(([EDGE], codes, [EDGE]))
    codes = codes[np.concatenate(([True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)))]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    return np.concatenate((codes[codes != EDGE], two, three[codes[1:-1] != EDGE]))


def ranked(text: str | None) -> np.ndarray:
    """A text's most frequent n-grams, RANKS at most, most frequent first, ties by number."""
    grams, counts = np.unique(ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:RANKS]]


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, gram, rank from 0): of each language, the n-grams most frequent in all its documents (text, lang not null).

    Workers add up their batches; ties go by number. Any number of languages is learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        n: dict[str, int] = {}

        def add(lang: str) -> None:
            grams, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in sums:
                grams, where = np.unique(np.concatenate((sums[lang][0], grams)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((sums[lang][1], counts))).astype(np.int64)
            sums[lang], n[lang] = (grams, counts), 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang in list(waiting):
                add(lang)
            for lang, (grams, counts) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                got = ngrams(text.as_py())
                waiting.setdefault(lang, []).append(got)
                n[lang] = n.get(lang, 0) + len(got)
                if n[lang] > GATHERED:
                    add(lang)
            if sum(n.values()) + sum(len(g) for g, _ in sums.values()) > HELD:
                yield from passed_on()
        yield from passed_on()

    counted = docs.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return stored(counted.withColumn("rank", rank - 1).filter(F.col("rank") < RANKS).select("lang", "gram", "rank"), "profiles")


def identify(docs: DataFrame, known: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) with lang_pred and score, by the ``profiles`` that are known.

    The out-of-place distance to a profile sums, over the text's ranked n-grams, how far the ranks
    lie apart; an n-gram that the profile lacks counts RANKS. The nearest profile wins, ties by
    name; the score is 1 less the distance's share of the largest possible. Texts that are null,
    empty or without a letter, and all texts where no profile is known, get ``und`` and score 0.
    Whole texts of any length count, equal rows are told alike, no rows give none. A result whose
    name is also carried gets the ending ``_found``. With more than AT_ONCE languages, texts are
    held against one part of them after the other, and the best so far goes along.
    """
    parts = max(1, -(-known.select("lang").distinct().count() // AT_ONCE))
    held = [f"c{i}" for i in range(len(carry))]
    d = docs.select(*[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)], F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.col("text").alias("text"))
    for part in range(parts):
        mine = known.filter(F.pmod(F.xxhash64(F.lit(3), "lang"), F.lit(parts)) == part) if parts > 1 else known
        by: dict[str, list[int]] = {}
        for r in mine.orderBy("lang", "rank").collect():
            by.setdefault(r.lang, []).append(r.gram)
        d = d.mapInArrow(nearest(by, len(held)), d.schema)
        d = stored(d, "languages") if part + 1 < parts else d
    return d.select(*[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], F.coalesce("lang", F.lit(UNKNOWN)).alias(free("lang_pred", carry)), F.col("score").alias(free("score", carry)))


def nearest(known: dict[str, list[int]], carried: int):
    """A function over batches (carried columns, lang, score, text) that puts in the language where one of ``known`` is nearer."""
    names = sorted(known)
    grams = np.unique(np.array([g for k in names for g in known[k]], dtype=np.int64))
    ranks = np.full((len(names), len(grams) + 1), -1, dtype=np.int16)
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(grams, known[k])] = np.arange(len(known[k]))

    def of(text: str | None) -> tuple[str | None, float]:
        mine = ranked(text)
        if not len(mine) or not names:
            return None, 0.0
        at = np.searchsorted(grams, mine)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != mine)] = len(grams)
        theirs = ranks[:, at].astype(np.int32)
        far = np.where(theirs < 0, RANKS, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(far.argmin())
        return names[best], 1.0 - float(far[best]) / (RANKS * len(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = zip(*(batch.column(carried + i).to_pylist() for i in (0, 1)), strict=True)
            out = []
            for (old, reached), t in zip(before, batch.column(carried + 2), strict=True):
                lang, score = of(t.as_py())
                out.append((old, reached) if lang is None or old is not None and (-reached, old) <= (-score, lang) else (lang, score))
            arrays = [*[batch.column(i) for i in range(carried)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), batch.column(carried + 2)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run
