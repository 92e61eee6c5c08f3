"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import free, stored

#: Features are hashed to so many bits; weights have 2**BITS entries at most.
BITS = 20
#: Labelled documents that the model is fitted on, those with the smallest hash of their id.
SAMPLE = 8000
EPOCHS = 12
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.0
#: ASCII upper case to lower case; ASCII characters that are no letter or digit to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Odd multipliers that tell word, pair and skip-gram positions apart.
SECOND, SKIPPED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: bytes | None) -> np.ndarray:
    """Hashed features of a whole text, with repeats: words, pairs of neighbours, pairs with one word between."""
    ws = text.translate(PLAIN).split() if text else []
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    pairs = h[:-1] * SECOND ^ h[1:]
    skips = h[:-2] * SKIPPED ^ h[2:]
    mixed = np.concatenate((h, pairs, skips))
    mixed ^= mixed >> np.uint64(33)
    return (mixed * SECOND >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; the intercept is not penalised."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= ALPHA * g / (BETA + np.sqrt(self.bias_n))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[float, dict[int, float]]:
    """Intercept and non-zero weights from (doc_id, text, label 0 or 1).

    ``labelled`` holds ``sample`` documents at most (the caller bounds it), so one task sees them
    all, in the order of a hash of the id; rows with a null label are left out. Without rows the
    model is the intercept 0. L1 leaves few weights, at most 2**BITS of 12 bytes: they can be broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, float]] = []
        for batch in batches:
            seen += [(np.unique(features(t)), y) for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, y in seen:
                model.learn(at, y)
        w = model.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], model.bias), pa.float64())], ["at", "w"])

    one = labelled.filter("label is not null").select(F.col("text"), F.col("label").cast("double"), F.xxhash64(F.lit(5), "doc_id", "text").alias("o"))
    one = one.repartition(1).sortWithinPartitions("o", "label").select("text", "label")
    rows = {r["at"]: r["w"] for r in stored(one.mapInArrow(run, "at long, w double"), "ftrl").collect()}
    return rows.pop(-1, 0.0), rows


def bounded_sample(labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of ``sample`` labelled ids at most, those with the smallest hash; one row an id.

    An id with several labels counts as 1 if one of them is; null ids and labels are left out.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return one.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the ids in ``sample``, which the caller bounds: one text an id, however many rows have it.

    Of several texts of an id that with the smallest hash counts. Copies are dropped before the shuffle.
    """
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = F.min(F.struct(F.xxhash64(F.lit(13), "text").alias("h"), "text")).alias("t")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "t.text", "label")


def score(docs: DataFrame, model: tuple[float, dict[int, float]], carry: list[str], threshold: float = 0.7) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) with score (0 to 1) and predicted (score >= threshold).

    A result whose name is also carried gets the ending ``_found``. Whole texts of any length count,
    each feature once however often it occurs; null and empty texts have no features and get the
    intercept's score. Equal rows, and texts with the same features, score alike. No rows give none.
    """
    bias, weights = model
    held = [f"c{i}" for i in range(len(carry))]
    named = docs.select(*[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)], F.col("text").alias("text"))
    schema = named.select(*held).schema.add("score", "double").add("predicted", "integer")
    at, w = np.array(list(weights), dtype=np.int64), np.array(list(weights.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = w
        known = dense != 0
        for batch in batches:
            sums = []
            for t in batch.column(len(held)).cast(pa.binary()).to_pylist():
                got = features(t)
                sums.append(bias + dense[np.unique(got[known[got]])].sum())
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -35, 35)))
            columns = [batch.column(i) for i in range(len(held))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*held, "score", "predicted"])

    out = named.mapInArrow(run, schema)
    return out.select(*[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], *[F.col(c).alias(free(c, carry)) for c in ("score", "predicted")])
