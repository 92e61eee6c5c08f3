"""Removal of passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only where the content selects them: a suffix starts at the minimiser of some 50
words, the least hash among the 16-word grams in them. Two equal passages of 50 words select the
same suffix, so its first 16 words stand in the sorted array next to an equal neighbour: a match.

Matches are extended left and right. A suffix knows its surroundings, all words on both sides of the
passages whose minimiser it is. If all suffixes that start alike have like surroundings, their match
extends over these as a whole. Otherwise the match is extended by each possible number of words to
the left, and to the right up to 50 words. Extended matches are sorted once more, by what they hold
and then by place, and compared with their neighbours: what equals an earlier one repeats it. So
every passage is compared with every equal one, however many there are, and what is found is what
comparing all passages would find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import discard, stored, written

#: Words of a passage that counts as repeated, and those at a suffix's start that are sorted by.
PASSAGE, PREFIX = 50, 16
REACH = PASSAGE - PREFIX + 1
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ONE, TWO = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, by in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = (Powers(ONE), Powers(TWO))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(TWO)
    return h ^ (h >> np.uint64(29))


def span_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    """A polynomial hash of the word hashes from each start to its stop, by running sums."""
    up, down = _powers[which].get(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
    return mixed((sums[stop] - sums[start]) * down[start])


def word_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of each word of a UTF-8 text; of no use, and empty, with fewer words than a passage."""
    ws = text.split() if text else []
    if len(ws) < PASSAGE:
        return np.empty(0, np.uint64)
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))


def selected(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each word, and for each passage the position of its minimiser (ascending)."""
    at = np.arange(len(words) - PREFIX + 1)
    grams = span_hashes(words, at, at + PREFIX, 0)
    least = np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(axis=1)
    return grams, least + np.arange(len(least))


def suffixes(docs: DataFrame) -> DataFrame:
    """(gram, around, doc, doc_id, place) of the content-selected suffixes of ``docs`` (__doc, doc_id, text).

    ``around`` hashes the surroundings; ``place`` packs the suffix's position, 20 more bits of that
    hash, and the numbers of passages that start before and after the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)):
                words = word_hashes(text)
                if not len(words):
                    continue
                grams, chosen = selected(words)
                at, start, n = np.unique(chosen, return_index=True, return_counts=True)
                stop = start + n - 1 + PASSAGE
                check = span_hashes(words, start, stop, 1) >> np.uint64(44)
                place = (at.astype(np.uint64) << np.uint64(32)) | (check << np.uint64(12)) | ((at - start).astype(np.uint64) << np.uint64(6)) | (start + n - 1 - at + REACH).astype(np.uint64)
                for column, x in zip(columns, (grams[at].view(np.int64), span_hashes(words, start, stop, 0).view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), i), place.view(np.int64)), strict=True):
                    column.append(x)
            if columns[0]:
                made = [np.concatenate(x) for x in columns]
                arrays = [pa.array(made[0]), pa.array(made[1]), pa.array(made[2]), batch.column(1).take(pa.array(made[3])), pa.array(made[4])]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "around", "doc", "doc_id", "place"])

    return docs.select("__doc", "doc_id", "text").mapInArrow(run, "gram long, around long, doc long, doc_id long, place long")


def with_equal_neighbour(array: DataFrame) -> DataFrame:
    """(around, doc, doc_id, place, alike) of the suffixes whose start equals that of a neighbour in the sorted array.

    The array is sorted over all suffixes, in ranges; a gram that many documents share spreads over
    ranges, as its suffixes differ in the further keys. ``alike`` tells that all suffixes of the
    gram have the same surroundings. That is only said of a gram whose suffixes lie within one
    batch; at the edges of batches and ranges suffixes stay without it, and are extended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before = True  # whether the held suffix stays on account of what came before it
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            gram, around = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = gram[1:] == gram[:-1]
            stays = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            size = np.diff(np.append(start, len(gram)))
            one = around[start] == around[start + size - 1]
            one[0] = one[-1] = False
            before, held = bool(len(same) and same[-1]), batch.slice(batch.num_rows - 1)
            stays[-1] = False
            yield out(batch, stays, np.repeat(one, size))
        if held is not None:
            yield out(held, np.array([True]), np.array([False]))

    def out(batch: pa.RecordBatch, stays: np.ndarray, alike: np.ndarray) -> pa.RecordBatch:
        some = pa.array(np.flatnonzero(stays))
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(some) for i in range(1, 5)], pa.array(alike[stays])], ["around", "doc", "doc_id", "place", "alike"])

    keys = ["gram", "around", "doc", "place"]
    ordered = array.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "around long, doc long, doc_id long, place long, alike boolean")


def extended(docs: DataFrame) -> DataFrame:
    """(hash, check, doc, doc_id, pos, n=1): each match extended left and right to a passage, in every way.

    ``docs`` has __doc, doc_id, text and __at, the matched positions of the document. A passage
    belongs to the suffix that is its minimiser, so each is made once: the words it takes to the
    left of a matched suffix, and to the right of it, are those up to the bounds of its minimiser.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            ids = batch.column(1)
            for i, (doc, text, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True)):
                words = word_hashes(text)
                if not len(words):
                    continue
                matched = np.zeros(len(words), bool)
                matched[at.values.to_numpy()] = True
                start = np.flatnonzero(matched[selected(words)[1]])
                columns[0].append(span_hashes(words, start, start + PASSAGE, 0).view(np.int64))
                columns[1].append((span_hashes(words, start, start + PASSAGE, 1) >> np.uint64(44)).astype(np.int32))
                columns[2].append(np.full(len(start), doc, np.int64))
                columns[3].append(np.full(len(start), i, np.int64))
                columns[4].append(start.astype(np.int32))
            if columns[0]:
                made = [np.concatenate(x) for x in columns]
                arrays = [pa.array(made[0]), pa.array(made[1]), pa.array(made[2]), ids.take(pa.array(made[3])), pa.array(made[4]), pa.array(np.ones(len(made[0]), np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["hash", "check", "doc", "doc_id", "pos", "n"])

    return docs.select("__doc", "doc_id", "text", "__at").mapInArrow(run, "hash long, check int, doc long, doc_id long, pos int, n int")


ROWS = "doc long, doc_id long, pos int, n int, head boolean, hash long, check int, first_none boolean, first_id long, first_doc long, first_pos int"


def repeats(found: DataFrame) -> tuple[str, DataFrame]:
    """The path of a table, and from it (doc, doc_id, pos, n, first_id) of the extended matches (``found``) that equal one at an earlier place.

    A second sorted array: equal ones are neighbours, the earliest first. It is sorted over all of
    them in ranges, a hot passage spreads over as many as it fills. A range tells its rows' first
    place as far as it knows, and the first row of its first and its last run; runs that cross a
    range's edge are settled by these rows, two a range, which are broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list | None = None  # hash, check and place of the row that starts the current run
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            place = [batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).fill_null(0).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy()]
            fresh = np.concatenate(([head is None or [key[0][0], key[1][0]] != head[:2]], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])))
            opened = head is None
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), -1))
            first = [np.where(at < 0, x.dtype.type(0 if head is None else head[2 + i]), x[at]) for i, x in enumerate(place)]
            later = np.logical_or.reduce([a != b for a, b in zip(place, first, strict=True)])
            rows = np.flatnonzero(later)
            yield made(batch.take(pa.array(rows)), [x[rows] for x in first], False)
            if opened:
                yield made(batch.slice(0, 1), [x[:1] for x in first], True)
            head = [key[0][-1], key[1][-1], *[x[-1] for x in first]]
        if head is not None:
            none, doc_id, doc, pos = (x.item() for x in head[2:])
            edge = [head[0].item(), head[1].item(), none, None if none else doc_id, doc, pos, 0]
            yield made(pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(edge, KINDS, strict=True)], NAMES), [np.array([x]) for x in head[2:]], True)

    def made(batch: pa.RecordBatch, first: list[np.ndarray], head: bool) -> pa.RecordBatch:
        hash_, check, _, doc_id, doc, pos, n = batch.columns
        first_id = pa.array(first[1], pa.int64(), mask=first[0].astype(bool))
        arrays = [doc, doc_id, pos, n, pa.array([head] * batch.num_rows, pa.bool_()), hash_, check, pa.array(first[0].astype(bool)), first_id, pa.array(first[2], pa.int64()), pa.array(first[3], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in ROWS.split(", ")])

    array = found.select("hash", "check", F.col("doc_id").isNull().alias("none"), "doc_id", "doc", "pos", "n")
    keys = ["hash", "check", "none", "doc_id", "doc", "pos"]
    path, compared = written(array.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, ROWS), "repeats")
    first = F.struct("first_none", "first_id", "first_doc", "first_pos")
    edges = compared.filter("head").groupBy("hash", "check").agg(F.min(first).alias("edge"), F.count("*").alias("k")).filter("k > 1").drop("k")
    known = F.least(first, F.coalesce("edge", first))
    rows = compared.join(F.broadcast(edges), ["hash", "check"], "left").withColumn("known", known)
    place = F.struct(F.col("doc_id").isNull().alias("first_none"), F.col("doc_id").alias("first_id"), F.col("doc").alias("first_doc"), F.col("pos").alias("first_pos"))
    # A run's head is a row of its own only where an earlier range has the same run.
    return path, rows.filter((place > F.col("known")) & (F.col("n") > 0)).select("doc", "doc_id", "pos", "n", F.col("known.first_id").alias("first_id"))


NAMES = ["hash", "check", "none", "doc_id", "doc", "pos", "n"]
KINDS = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def merged(rows: DataFrame) -> DataFrame:
    """(doc, doc_id, start, stop, first) from ``repeats``: runs of words, ends exclusive, ``first`` the least id known.

    Rows come sorted by document and position and are merged as they come, so none are gathered.
    """
    wide = np.int64(1) << np.int64(33)
    most = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # doc, doc_id, start, stop and first of the run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, n = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
            ids, first = batch.column(1), batch.column(4).fill_null(most).to_numpy()
            stop = pos + n - 1 + PASSAGE
            if held is not None:
                doc, pos, stop, first = (np.concatenate(([x], y)) for x, y in zip((held[0], held[2], held[3], held[4]), (doc, pos, stop, first), strict=True))
                ids = pa.concat_arrays([pa.array([held[1]], pa.int64()), ids])
            which = np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1]))) * wide
            reach = np.maximum.accumulate(which + stop)
            start = np.flatnonzero(np.concatenate(([True], which[1:] + pos[1:] > reach[:-1])))
            last = np.append(start[1:], len(doc)) - 1
            ends, least = reach[last] - which[last], np.minimum.reduceat(first, start)
            held = (doc[start[-1]], ids[int(start[-1])].as_py(), pos[start[-1]], ends[-1], least[-1])
            yield out(doc[start[:-1]], ids.take(pa.array(start[:-1])), pos[start[:-1]], ends[:-1], least[:-1])
        if held is not None:
            yield out(*[np.array([held[0]]), pa.array([held[1]], pa.int64()), *[np.array([x]) for x in held[2:]]])

    def out(doc: np.ndarray, ids: pa.Array, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(doc, pa.int64()), ids, pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(first, pa.int64(), mask=first == most)]
        return pa.RecordBatch.from_arrays(arrays, ["doc", "doc_id", "start", "stop", "first"])

    ordered = rows.repartition("doc").sortWithinPartitions("doc", "pos").select("doc", "doc_id", "pos", "n", "first_id")
    return ordered.mapInArrow(run, "doc long, doc_id long, start int, stop int, first long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __doc, a hash of id and text: rows that are equal in both are one document."""
    return docs.withColumn("__doc", F.xxhash64(F.lit(23), F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), "text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, start, stop, first) of the runs of words that go from documents (__doc, doc_id, text).

    A word goes if it lies in a passage of PASSAGE words that also stands at an earlier place:
    in a document of smaller id (null ids last), or further left in the same one; of equal ids that
    with the smaller hash of id and text is earlier. Words are compared as they are written.
    ``first`` is the least id that holds one of the run's passages first. A text of any length is
    read as a whole, by one task; its matches and runs are rows that no task gathers.
    """
    spark = docs.sparkSession
    whole_array, array = written(suffixes(docs), "suffixes")
    matches, matched = written(with_equal_neighbour(array), "matched")
    discard(spark, whole_array)
    at = F.shiftright("place", 32).cast("int")
    bits = lambda low, n: F.shiftright("place", low).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    start, after = at - bits(6, 6), bits(0, 6) - REACH
    whole = matched.filter("alike").select(F.col("around").alias("hash"), bits(12, 20).alias("check"), "doc", "doc_id", start.alias("pos"), (after + bits(6, 6) + 1).alias("n"))
    rest = matched.filter("not alike").groupBy(F.col("doc").alias("__of")).agg(F.collect_set(at).alias("__at"))
    asked = docs.select("__doc", "doc_id", "text").join(rest, F.col("__doc") == F.col("__of"))
    later, found = repeats(whole.unionByName(extended(asked)))
    discard(spark, matches)
    spans = stored(merged(found), "spans")
    discard(spark, later)
    return spans


def find_repeats(docs: DataFrame) -> DataFrame:
    """One row for each run of repeated words: doc_id, start_word, stop_word, n_words, first_doc_id.

    Null, empty and short texts repeat nothing. Rows that are equal in id and text are one document
    and give their runs once. Very long texts are compared whole. No row for documents without
    repeats, none for an empty table. Further columns of ``docs`` are not looked at.
    """
    spans = repeated_spans(keyed(docs.select("doc_id", "text")))
    return spans.select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("first").alias("first_doc_id"))


def cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and the blanks that follow them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["start"]][0]])
        at = places[s["stop"]][0] if s["stop"] < len(places) else len(text)
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated words; a document of which no word is left goes.

    All columns stay; n_chars, where there is one, follows the text. Other texts aren't touched.
    """
    mine = keyed(docs)
    columns = docs.columns
    spans = repeated_spans(mine.select("__doc", "doc_id", "text")).groupBy(F.col("doc").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    marked = mine.join(spans, F.col("__doc") == F.col("__of"), "left")
    text, at = columns.index("text"), len(columns)
    # Whole rows pass through Arrow; only the text of documents with spans changes.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            texts = [t if s is None else cut(t.encode(), s).decode() for t, s in zip(texts, batch.column(at).to_pylist(), strict=True)]
            arrays = [pa.array(texts, pa.string()) if i == text else batch.column(i) for i in range(len(columns))]
            emptied = pa.array([s is not None and not t.strip(" \t\n\r\v\f") for t, s in zip(texts, batch.column(at).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*arrays, emptied], [*columns, "__emptied"])

    schema = docs.schema
    out = marked.select(*columns, "__spans").mapInArrow(run, type(schema)(schema.fields[:]).add("__emptied", "boolean"))
    out = out.filter("not __emptied").drop("__emptied")
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
