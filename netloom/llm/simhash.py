"""SimHash near-duplicates: fingerprints, and links by a grid over segment bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from netloom.llm.common import components, discard, in_slices, join_named, stored, written

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Every second bit of a 32-bit half: a half has 16 segments of two bits.
PAIRS = 0x55555555


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words of a UTF-8 text, with repeats.

    A-Z are lower-cased and words split at ASCII blanks; fewer words make one shingle, none make none.
    """
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(ws)
    k = min(size, len(ws))
    lengths = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed number.

    3-word shingles count with repeats (fewer words: the whole sequence; none: 0). A bit is 1 if
    over half the hashes have it.
    """
    hashes = shingle_hashes(text, SHINGLE_WORDS)
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` with ``__fp``, the fingerprint of ``text``."""
    schema = docs.select(*carry).schema.add("__fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carry)).cast(pa.binary()).to_pylist()
            columns = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([fingerprint(t) for t in texts], pa.int64())], [*carry, "__fp"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(in_slices(run), schema)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct longs ``__fp`` that differ in ``MAX_BITS`` bits or fewer.

    Of three differing bits, one 32-bit half has one at most. A half is embedded as the bit counts
    of its 16 two-bit segments; the Manhattan distance of two such vectors is never above the
    number of differing bits. So every link lies, for one half, within distance 1 in the grid of
    vectors: a range join over cells, in which points of odd bit count also ask the cells around
    theirs (neighbours at distance 1 have even counts). Found pairs are verified by all 64 bits.
    Equal fingerprints are one row here, so copies never meet each other.
    """
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("__fp", 32).alias("bits")), F.struct(F.lit(1).alias("half"), F.col("__fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits"))))
    points = prints.select("__fp", halves.alias("h")).select("__fp", "h.half", "h.bits")
    points = points.withColumn("cell", F.col("bits") - F.shiftright("bits", 1).bitwiseAND(F.lit(PAIRS)))

    def around(i: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * i)
        count = F.call_function("shiftright", F.col("cell"), 2 * i).bitwiseAND(F.lit(3))
        up = F.when(count < 2, F.col("cell") + step)
        down = F.when(count > 0, F.col("cell") - step)
        return F.array(up, down)

    odd = F.bit_count("bits") % 2 == 1
    asked = F.concat(F.array("cell"), F.when(odd, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), around)))).otherwise(F.array().cast("array<bigint>")))
    asks = points.select(F.col("__fp").alias("a"), "half", F.col("cell").alias("own"), F.explode(asked).alias("cell"))
    there = points.select(F.col("__fp").alias("b"), "half", "cell")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    once = (F.col("own") != F.col("cell")) | (F.col("a") < F.col("b"))
    found = asks.join(there, ["half", "cell"]).filter(close & once)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_components(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns (doc_id among them), ``__fp`` and ``__component``.

    Documents are connected by links of fingerprints at ``MAX_BITS`` or fewer bits, in chains too;
    a component is named by its smallest doc_id. Null ids count as none (a component of null ids
    has the name null). Null, empty and blank texts have fingerprint 0 and are linked like others.
    Equal rows stay separate rows of the same component.
    """
    slim = stored(fingerprints(docs, carry), "simhash")
    prints = stored(slim.groupBy("__fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    groups = components(near_links(prints.select("__fp")), "simhash-links")
    named = prints.join(groups, prints["__fp"] == groups["node"], "left").select("__fp", "least", "n", F.coalesce("component", "__fp").alias("__group"))
    named = stored(named, "simhash-groups")
    names = stored(named.groupBy("__group").agg(F.min("least").alias("__component"), F.count("*").alias("k")), "simhash-names")
    named = stored(join_named(named, names, "__group", "k").select("__fp", "__component", "__group", "n"), "simhash-named")
    return join_named(slim, named, "__fp").select(*carry, "__fp", "__component", "__group")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text)."""
    found = with_components(docs, ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


#: An odd number that mixes hashes.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of the similarity form: words of a shingle; texts are near copies from a Jaccard similarity of 4/5 on.
COPY_WORDS = 5
#: Shingles of a text for each segment that they are counted in, about; segments are a power of two.
A_SEGMENT, SEGMENTS_LEAST = 4, 16
#: Bytes of a shingle's hash that are compared at the last.
HASH_BYTES = 6
#: Rarest-first order of shingles: of every so many texts one is looked at; shingles that so many of these
#: hold come last, the commonest at the very end. Any order gives the same links, this one fewer candidates.
SAMPLED, COMMON, COMMON_KEPT = 16, 4, 200_000
#: Shingles of up to so many prefixes make pairs of texts; more are a crowd, compared in blocks of so many texts.
CROWD, BLOCK = 64, 128
#: Bits of the filter that tells which texts are wanted: so many a text, these at least and at most (16 MB).
FILTER, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 27


def shingle_set(text: bytes | None) -> np.ndarray:
    """Hashes of the different shingles of COPY_WORDS words, ascending; fewer words make one, none make none.

    A shingle's hash mixes the XXH64 of its words with their places, so each word is hashed once.
    """
    ws = text.lower().split() if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    k = min(COPY_WORDS, len(ws))
    out = np.full(len(ws) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(ws) - k + 1 + i]) * ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles, as a signed number: a bit is 1 if over half the hashes have it."""
    ones = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of ``docs`` (__c, text), ascending, and in how many of the texts looked at they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view("<i8"))], ["s"])

    some = docs.filter(F.pmod(F.xxhash64(F.lit(37), "__c"), F.lit(SAMPLED)) == 0).dropDuplicates(["__c"])
    seen = some.select("text").mapInArrow(in_slices(run), "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    rows = sorted((r[0] % (1 << 64), r[1]) for r in seen.orderBy(F.desc("n"), "s").limit(COMMON_KEPT).collect())
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 of n shingles in the order of all texts: near copies share one of them."""
    n = len(shingles)
    if not n:
        return shingles
    weight = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        weight = np.where(common[0][at] == shingles, common[1][at], 0)
    return shingles[np.lexsort((shingles, weight))[: n - (4 * n + 4) // 5 + 1]]


def similar(shared: Column, na: Column, nb: Column) -> Column:
    return 5 * shared >= 4 * (na + nb - shared)


def segment_counts(shingles: np.ndarray) -> bytes:
    """The bit counts of a text's fingerprint, which has one bit a shingle, by segment: how many hashes have each of so many leading bits."""
    bits = max(SEGMENTS_LEAST, 1 << (max(len(shingles) // A_SEGMENT, 1) - 1).bit_length()).bit_length() - 1
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def manhattan_allows(na: np.ndarray, nb: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whether two sets whose segment counts lie ``far`` apart may be near copies.

    The Manhattan distance of the counts is never above the number of shingles that only one text
    has, and near copies differ in a ninth of their shingles' sum at most.
    """
    return 9 * far <= na + nb


def folded(counts: np.ndarray, segments: int) -> np.ndarray:
    """Counts (a row a text) by fewer segments: neighbours are added."""
    return counts.reshape(len(counts), segments, -1).sum(axis=2)


def distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Manhattan distance of the segment counts of each two texts, by the coarser segments of both."""
    sizes = [np.array(list(map(len, x)), np.int64) for x in (left, right)]
    out = np.zeros(len(left), np.int64)
    for m in np.unique(np.minimum(*sizes)) if len(left) else ():
        for which in np.unique(np.maximum(*sizes)[np.minimum(*sizes) == m]):
            at = np.flatnonzero((np.minimum(*sizes) == m) & (np.maximum(*sizes) == which))
            for some in np.array_split(at, len(at) * int(which) // (1 << 22) + 1):
                a, b = ([x[i] for i in some] for x in (left, right))
                rows = [np.stack([folded(np.frombuffer(t, np.uint8).astype(np.int16)[None], int(m))[0] for t in x]) for x in (a, b)]
                out[some] = np.abs(rows[0] - rows[1]).sum(axis=1)
    return out


def by_segments(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes (__c, __n, __counts) that the Manhattan distance of their segment counts allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            fine = manhattan_allows(batch.column(2).to_numpy(), batch.column(3).to_numpy(), far)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine)) for c in batch.columns[:2]], ["a", "b"])

    of = [classes.select(F.col("__c").alias(x), F.col("__n").alias(f"n{x}"), F.col("__counts").alias(f"c{x}")) for x in "ab"]
    return pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def wanted_filter(some: DataFrame) -> np.ndarray:
    """A bitmap of hashes of the numbers in ``some`` (__c), of bounded size, to tell which texts may be among them."""
    bits = FILTER_LEAST
    n = some.count()
    while bits < min(FILTER * n, FILTER_MOST):
        bits *= 2
    at = F.pmod(F.col("__c"), F.lit(bits))
    words = some.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r[0]] = r[1]
    return out


def may_be_in(bitmap: np.ndarray, c: np.ndarray) -> np.ndarray:
    at = np.mod(c, len(bitmap) * 64)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def with_company(placed: DataFrame) -> DataFrame:
    """(s, __c, __n) of the rows (s, __c, __n) whose shingle another class has, each once, beside a few more at the edges of ranges.

    Rows are sorted over all of them in ranges and compared with their neighbours, so a shingle that
    a third of all classes have spreads over ranges, and one that a single class has goes no further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        before = True  # whether the held row stays on account of what came before it
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            again = np.concatenate(([False], (s[1:] == s[:-1]) & (c[1:] == c[:-1])))
            if again.any():
                rows = pa.array(np.flatnonzero(~again))
                batch = batch.take(rows)
                s = batch.column(0).to_numpy()
            same = s[1:] == s[:-1]
            stays = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            if len(same):
                before = bool(same[-1])
            held = batch.slice(batch.num_rows - 1)
            stays[-1] = False
            yield batch.take(pa.array(np.flatnonzero(stays)))
        if held is not None:
            yield held

    ordered = placed.repartitionByRange("s", "__c").sortWithinPartitions("s", "__c")
    return ordered.mapInArrow(run, "s long, __c long, __n long").distinct()


def overlaps(sets: list) -> np.ndarray:
    """How many numbers each two of the sets have in common; on the diagonal, only those that others have too."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate([np.array(x, np.int64) for x in sets]), return_inverse=True, return_counts=True)
    at, owner = (np.cumsum(times > 1) - 1)[at[times[at] > 1]], owner[times[at] > 1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), 8192):
        here = (at >= low) & (at < low + 8192)
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[here], at[here] - low] = 1
        shared += x @ x.T
    return shared


def hopeful(rows: pa.Table) -> pa.Table:
    """Texts of a pair of blocks with a text of another group that may be near, by segment counts, and that no crowd before has."""
    c, comp, n = (rows.column(x).to_numpy() for x in ("c", "comp", "__n"))
    some = np.zeros(len(c), bool)
    if len(np.unique(comp)) > 1:
        s = rows.column("s")[0].as_py()
        counts = rows.column("__counts").to_pylist()
        i, j = np.nonzero((comp[:, None] < comp[None, :]) & (5 * np.minimum(n[:, None], n[None, :]) >= 4 * np.maximum(n[:, None], n[None, :])))
        fine = manhattan_allows(n[i], n[j], distances([counts[k] for k in i], [counts[k] for k in j]))
        near = np.zeros((len(c), len(c)), bool)
        near[i[fine], j[fine]] = near[j[fine], i[fine]] = True
        if near.any():
            near &= overlaps([[x for x in q if x < s] for q in rows.column("open").to_pylist()]) == 0
        some = near.any(axis=1)
    return rows.select(["s", "i", "j", "c", "comp"]).filter(pa.array(some))


def packed_hashes(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_hashes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<i8").ravel()


def compare_block(rows: pa.Table) -> pa.Table:
    """Links (a, b) among texts ``c`` with their ``shingles`` that join different groups ``comp``: a forest, not all pairs."""
    c, comp = rows.column("c").to_numpy(), rows.column("comp").to_numpy()
    sets = list(map(unpacked_hashes, rows.column("shingles").to_pylist())) if len(np.unique(comp)) > 1 else []
    a, b = [], []
    if sets:
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        shared = overlaps(sets)
        close = 5 * shared >= 4 * (size[:, None] + size[None, :] - shared)
        root = {int(k): int(k) for k in comp}

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i, j in np.argwhere(np.triu(close & (comp[:, None] != comp[None, :]), 1)).tolist():
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(c[i]))
                b.append(int(c[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def copy_links(classes: DataFrame, placed: DataFrame, texts: DataFrame, made: list[str]) -> DataFrame:
    """Links (a, b) that connect all near copies: ``classes`` (__c, __n, __fp, __counts), ``placed`` (s, __c, __n) their prefixes' shingles, ``texts`` (__c, text).

    Two ways give pairs. SimHash: classes whose fingerprints lie within MAX_BITS, by the grid of
    ``near_links``; of classes with equal fingerprints each meets the first. Fingerprints of texts
    that are just similar enough differ in some ten bits, where no grid is selective, so an exact
    prefix-filter join finds the rest: near copies share a shingle of their prefixes. All pairs are
    then held against the Manhattan distance of their segment counts, a lower bound, and what is
    left is verified by whole shingle sets: pairs that hang together are compared in blocks, to
    which each text's set goes once.

    Shingles of few prefixes give pairs; pairs that share too few for what can follow go. A
    shingle of more is a crowd: its texts are first compared with three of it, the one in most
    crowds (as the original of many variants is) among them. Where that leaves more than one group
    in a crowd, the texts outside its largest group are compared with all others in pairs of bounded
    blocks, which return the links that join groups; only those with a possible partner by segment
    counts get there. So the groups of
    the links are those of all near copies.
    """

    def keep(table: DataFrame, name: str) -> DataFrame:
        path, out = written(table, name)
        made.append(path)
        return out

    prints = keep(classes.filter("__n > 0").groupBy("__fp").agg(F.min("__c").alias("first"), F.count("*").alias("k")), "copy-prints")
    close = near_links(prints.select("__fp"))
    ends = [prints.select(F.col("__fp").alias(x), F.col("first").alias(f"c{x}")) for x in "ab"]
    close = close.join(ends[0], "a").join(ends[1], "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    alike = join_named(classes.filter("__n > 0").select("__fp", "__c"), prints.select("__fp", "first", "k"), "__fp", "k").filter("first <> __c")
    close = close.unionByName(alike.select(F.col("first").alias("a"), F.col("__c").alias("b")))

    shared = keep(with_company(placed), "copy-company")
    often = shared.groupBy("s").agg(F.count("*").alias("m"), F.min("__c").alias("first"), F.max("__c").alias("last")).filter("m > 1")
    shared = keep(shared.join(often, "s"), "copy-shared")
    few, crowds = shared.filter(F.col("m") <= CROWD), shared.filter(F.col("m") > CROWD)

    sides = [few.select("s", F.col("__c").alias(x), F.col("__n").alias(f"n{x}")) for x in "ab"]
    sized = 5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")
    pairs = sides[0].join(sides[1], "s").filter((F.col("a") < F.col("b")) & sized).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    crowded = not crowds.isEmpty()
    if not crowded:  # else a pair may share a crowd's shingles too
        # Behind a prefix are ceil(4n/5) - 1 shingles.
        most = F.col("k") + F.greatest(F.ceil(4 * F.col("na") / 5), F.ceil(4 * F.col("nb") / 5)) - 1
        pairs = pairs.filter(similar(most, F.col("na"), F.col("nb")))
    pairs = pairs.select("a", "b").unionByName(close)
    if crowded:
        score = crowds.groupBy("__c").agg(F.count("*").alias("score"))
        hubs = crowds.join(score, "__c").groupBy("s").agg(F.max_by("__c", F.struct("score", "__c")).alias("hub"))
        to = crowds.join(hubs, "s").select("__c", F.explode(F.array("first", "last", "hub")).alias("other")).filter("__c <> other")
        pairs = pairs.unionByName(to.select(F.least("__c", "other").alias("a"), F.greatest("__c", "other").alias("b")))
    pairs = keep(by_segments(pairs.distinct(), classes), "copy-pairs")

    def shingles(bitmap: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(may_be_in(bitmap, batch.column(0).to_numpy())))
                sets = [packed_hashes(shingle_set(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["c", "shingles"])

        return run

    def compared(dealt: DataFrame) -> DataFrame:
        """Links among the texts of each block (s, i, j, c, comp). Texts aren't shuffled, their sets are: a bitmap tells which are wanted."""
        bitmap = wanted_filter(dealt.select(F.col("c").alias("__c")).distinct())
        sets = texts.mapInArrow(in_slices(shingles(bitmap)), "c long, shingles binary").groupBy("c").agg(F.first("shingles").alias("shingles"))
        return dealt.join(sets, "c").groupBy("s", "i", "j").applyInArrow(compare_block, "a long, b long")

    # Pairs that hang together: few texts each, mostly, so one block; a larger cluster is dealt in blocks that have pairs.
    clusters = keep(components(pairs, "copy-clusters"), "copy-clustered")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit(29), "node"), F.col("blocks"))).otherwise(0).cast("int")
    at = keep(clusters.join(sizes, "component").select("node", "component", block.alias("block")), "copy-blocks")
    of = [at.select(F.col("node").alias(x), F.col("component").alias(f"s{x}"), F.col("block").alias(f"b{x}")) for x in "ab"]
    met = pairs.join(of[0], "a").join(of[1].drop("sb"), "b").select(F.col("sa").alias("s"), F.least("ba", "bb").alias("i"), F.greatest("ba", "bb").alias("j"), F.explode(F.array("a", "b")).alias("c")).distinct()
    links = compared(keep(met.select("s", "i", "j", "c", F.col("c").alias("comp")), "copy-met"))
    if not crowded:
        return links

    links = keep(links, "copy-near")
    groups = components(links, "copy-crowds")
    left = crowds.join(groups, F.col("__c") == F.col("node"), "left").select("s", "__c", F.coalesce("component", "__c").alias("comp"))
    # Of each crowd with several groups: its largest group, which needs no comparison within, and the rest.
    by = left.groupBy("s", "comp").agg(F.count("*").alias("n"))
    shape = by.groupBy("s").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("kinds")).filter("kinds > 1")
    many = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("s", "main", many(F.col("n_main")).alias("main_blocks"), many(F.col("n_all") - F.col("n_main")).alias("rest_blocks"))
    left = keep(left.join(shape, "s"), "copy-open")
    if left.isEmpty():
        return links
    rest = F.col("comp") != F.col("main")
    own = F.pmod(F.xxhash64(F.lit(29), "__c"), F.when(rest, F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int")
    d = left.withColumn("block", own)
    # Blocks of the rest are 0, 1, ..., those of the largest group -1, -2, ...
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rest_blocks") - 1), lambda k: F.when(rest, F.struct(F.greatest(k, F.col("block")).alias("i"), F.least(k, F.col("block")).alias("j"))).otherwise(F.struct(k.alias("i"), (-1 - F.col("block")).alias("j"))))
    with_main = F.when(rest, F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda k: F.struct(F.col("block").alias("i"), (-1 - k).alias("j"))))
    dealt = d.select("s", F.col("__c").alias("c"), "comp", F.explode(F.concat(with_rest, F.coalesce(with_main, F.array().cast("array<struct<i:int,j:int>>")))).alias("at")).select("s", "c", "comp", "at.i", "at.j")
    told = classes.join(left.groupBy("__c").agg(F.collect_list("s").alias("open")), "__c").select(F.col("__c").alias("c"), "__n", "__counts", "open")
    few_left = dealt.join(told, "c").groupBy("s", "i", "j").applyInArrow(hopeful, "s long, i int, j int, c long, comp long")
    few_left = keep(few_left, "copy-hopeful")
    return links.unionByName(compared(few_left))


def copy_classes(docs: DataFrame, carry: list[str], made: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``carry`` columns with the class __c of the text; the classes (__c, __n, __fp, __counts, rows); their groups (__c, __group).

    Equal texts are one class. Rows of a class are added up before they are shuffled, so a text that
    a third of all rows have is one row of the second table. ``made`` gets the paths of the tables
    that are written; the results read them.
    """
    made = [] if made is None else made

    def keep(table: DataFrame, name: str) -> DataFrame:
        path, out = written(table, name)
        made.append(path)
        return out

    text_class = F.xxhash64(F.lit(31), F.coalesce("text", F.lit("")))
    texts = docs.select(text_class.alias("__c"), "text")
    common = common_shingles(texts)
    held = [f"c{i}" for i in range(len(carry))]
    named = [F.col(c).alias(h) for c, h in zip(carry, held, strict=True)]
    schema = docs.select(*named).schema.add("__c", "long").add("__n", "long").add("__fp", "long").add("__counts", "binary").add("__prefix", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(len(carry)).cast(pa.binary()).to_pylist()]
            n = pa.array([len(h) for h in sets], pa.int64())
            cls = pc.if_else(pc.greater(n, 0), batch.column(len(carry) + 1), 0)
            prints = pa.array([signature(h) if len(h) else 0 for h in sets], pa.int64())
            counts = pa.array(list(map(segment_counts, sets)), pa.binary())
            first = pa.array([prefix(h, common).view("<i8") for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(carry))], cls, n, prints, counts, first], schema.fieldNames())

    slim = keep(docs.select(*named, F.col("text").alias("__text"), text_class.alias("__class")).mapInArrow(in_slices(run), schema), "copies")
    classes = slim.groupBy("__c").agg(*[F.first(c).alias(c) for c in ("__n", "__fp", "__counts")], F.count("*").alias("rows"))
    classes = keep(classes, "copy-classes")
    groups = components(copy_links(classes, slim.select(F.explode("__prefix").alias("s"), "__c", "__n"), texts, made), "copy-links")
    groups = classes.join(groups, F.col("__c") == F.col("node"), "left").select("__c", F.coalesce("component", "__c").alias("__group"))
    return slim.select(*[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], "__c"), classes, groups


def with_copies(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) and ``__group``, alike for near copies.

    Texts are near copies if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more,
    and copies of copies belong to the group too; all such pairs count, whatever the number of texts.
    Equal texts are one from the start; null, empty and blank texts are near copies of each other.
    """
    slim, classes, groups = copy_classes(docs, carry)
    return join_named(slim, stored(groups.join(classes.select("__c", "rows"), "__c"), "copy-groups"), "__c", "rows").drop("__c")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near copies only; all columns stay.

    Null ids come last; among rows of one id the smallest hash of all columns (but maps) stays, and one of
    fully equal rows. Texts of any length are compared whole. An empty table stays empty.
    """
    named = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    cells = [*map(F.col, named), *[F.col(c).isNull() for c in named]]  # a hash passes over nulls
    keys = ["__key", "__other"]
    marked = docs.withColumns({k: F.xxhash64(F.lit(seed), *cells) for seed, k in enumerate(keys, 42)})
    made: list[str] = []  # tables that are read until the documents that stay are known
    slim, _, groups = copy_classes(marked, ["doc_id", *keys], made)
    one = slim.groupBy("__c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)).alias("k"))
    best = one.join(groups, "__c").groupBy("__group").agg(F.min("k").alias("k")).select("k.*").select(*keys)
    best = stored(best, "copy-best")
    discard(docs.sparkSession, *made)
    # Rows are dealt by the keys once: fully equal ones are dropped where the join has put them.
    return marked.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)
