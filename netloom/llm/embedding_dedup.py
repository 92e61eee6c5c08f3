"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, join_named, stored

COSINE = 0.98
#: Width of the confidence bound in standard errors of the estimate.
BOUND = 5.0
#: A link escapes all tables with this probability at most.
MISSED = 1e-6
#: Vectors of a block; a task compares the codes of two blocks at most.
BLOCK = 4096
#: Blocks of a label up to which all of them meet; with more, vectors meet in buckets of about a block.
FEW_BLOCKS = 16
#: Rows of a block whose estimates are made at once.
AT_ONCE = 512


def plan(vectors: int) -> tuple[int, int]:
    """Bits of a bucket's key and number of tables for so many vectors of one label.

    A code bit of two linked vectors agrees with probability 1 - angle / pi at least. Up to
    FEW_BLOCKS blocks make one bucket, in which all pairs meet: tables would be dearer.
    """
    if vectors <= FEW_BLOCKS * BLOCK:
        return 0, 1
    bits = math.ceil(math.log2(vectors / BLOCK))
    agree = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


@cache
def rotation(size: int, which: int) -> np.ndarray:
    """A random rotation of so many dimensions, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([size, which]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Of each unit vector, its bucket in each table: the next ``bits`` signs of rotated coordinates."""
    size = x.shape[1]
    need = bits * tables
    signs = np.hstack([x @ rotation(size, 1 + i) > 0 for i in range(math.ceil(need / size))] or [np.zeros((len(x), 0), bool)])[:, :need]
    return (signs.reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: packed sign codes, correction factors, rotated coordinates in bytes, and the error of these.

    A code is the signs of the rotated coordinates, which name the vertex of a cube nearest to the
    vector; its correction factor is the product with that vertex. The coordinates of the other
    side of a pair are held as bytes, with one scale, and the length of what that rounding lost.
    """
    turned = x @ rotation(x.shape[1], 0)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])
    scale = np.abs(turned).max(axis=1) / 127
    small = np.rint(turned / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(turned - small * scale[:, None], axis=1)
    return np.packbits(turned > 0, axis=1), factor, small, np.column_stack([scale, lost])


def vertices(codes: np.ndarray, size: int) -> np.ndarray:
    return (np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))


def hopeful(codes: np.ndarray, factor: np.ndarray, small: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Which pairs may have a cosine of COSINE or more, by codes on one side and bytes on the other (a boolean matrix).

    A vertex's product with the other rotated vector, divided by the factor, estimates the cosine
    without bias. The error is the sine of the pair's angle times a term with a confidence bound,
    so a linked pair's estimate stays above a known value; what the bytes lost widens the bound by
    its length at most. Pairs below it need no exact product.
    """
    size = small.shape[1]
    products = vertices(codes, size) @ (small * scales[:, :1].astype(np.float32)).astype(np.float32).T
    error = BOUND * np.sqrt(np.maximum(1 - factor**2, 0)) / math.sqrt(max(size - 1, 1))
    least = COSINE * factor - math.sqrt(1 - COSINE**2) * error - 1e-5
    return products + scales[None, :, 1].astype(np.float32) >= least[:, None].astype(np.float32)


def open_ones(rows: pa.Table) -> pa.Table:
    """Of a pair of blocks, the vectors with a partner that their codes don't rule out."""
    size = int(rows.column("size")[0].as_py())
    flat = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(rows.num_rows, -1)
    codes, small, scales = flat("code", np.uint8), flat("small", np.int8), flat("scales", np.float64)
    factor, side = rows.column("factor").to_numpy(), rows.column("side").to_numpy()
    one = len(np.unique(side)) == 1
    left, right = (np.arange(len(side)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    some = np.zeros(len(side), bool)
    for at in range(0, len(left), AT_ONCE):
        mine = left[at : at + AT_ONCE]
        hit = hopeful(codes[mine], factor[mine], small[right], scales[right])
        if one:
            hit &= mine[:, None] != right[None, :]
        some[mine] |= hit.any(axis=1)
        some[right] |= hit.any(axis=0)
    if size < 2:
        some[:] = True
    return rows.select(["cls", "label", "size", "table", "key", "i", "j", "side"]).filter(pa.array(some))


def compare(rows: pa.Table, bits: int, tables: int) -> pa.Table:
    """Of the open vectors of a pair of blocks, by exact products: members of linked classes that this table finds first, and the least class reached."""
    column = lambda c: rows.column(c).to_numpy()
    cls, weight, side = column("cls"), column("members"), column("side")
    x = units(np.array(rows.column("vector").to_pylist(), dtype=np.float64))
    one = len(np.unique(side)) == 1
    left, right = (np.arange(len(cls)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    table = int(rows.column("table")[0].as_py())
    mine = keys(x, bits, tables)
    n, found = np.zeros(len(cls), np.int64), []
    for at in range(0, len(left), AT_ONCE):
        some = left[at : at + AT_ONCE]
        a, b = np.nonzero(x[some] @ x[right].T >= COSINE - 1e-9)
        a, b = some[a], right[b]
        links = (a != b) & (np.concatenate([np.einsum("ij,ij->i", x[a[k : k + (1 << 16)]], x[b[k : k + (1 << 16)]]) for k in range(0, len(a), 1 << 16)] or [np.empty(0)]) >= COSINE)
        a, b = a[links], b[links]
        first = np.ones(len(a), bool)
        for t in range(table):  # a pair that an earlier table brings together is counted there
            first &= mine[a, t] != mine[b, t]
        n += np.bincount(a[first], weight[b[first]], minlength=len(cls)).astype(np.int64)
        if not one:
            n += np.bincount(b[first], weight[a[first]], minlength=len(cls)).astype(np.int64)
        found.append((a.astype(np.int32), b.astype(np.int32)))
    least = cls.copy()
    while True:
        old = least.copy()
        for a, b in found:
            np.minimum.at(least, a, old[b])
            np.minimum.at(least, b, old[a])
        if (old == least).all():
            break
    some = np.flatnonzero((n > 0) | (least != cls))
    return pa.table({"cls": cls[some], "n": n[some], "least": least[some]})


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared within a label and a length. Equal vectors of a label are one class with a
    number of members, so copies are linked without meeting, and a vector that a third of all rows
    have is one class. A class's code, correction factor and bytes are made and stored once; these,
    some 90 bytes for 64 dimensions, are what meets, in buckets of equal sign bits split into
    blocks of bounded size. Full vectors are fetched only for those that the confidence bound leaves
    open with a partner. A task returns rows for its vectors, never pairs. Each link is counted in
    the first table that has it. Up to FEW_BLOCKS blocks of a label all its vectors meet.

    Vectors without a label, null or zero ones and those with a null or non-finite component link
    with nothing: n_links 0 and a component of their own. A null vec_id counts as a vector; a
    component is named by its smallest id that is not null, and a null id is not kept. Equal rows
    link with each other. An empty table gives no rows; further columns are not looked at.
    """
    v = F.col("embedding")
    doubles = F.transform(v, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(fine, F.lit(False)), doubles).alias("vector"))
    rows = rows.withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    good = rows.filter("cls is not null")
    classes = stored(good.groupBy("cls", "label", "vector").agg(F.count("*").alias("members"), F.min("vec_id").alias("least_id")).withColumn("size", F.size("vector")), "vector-classes")
    most = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most)
    kind = classes.schema["label"].dataType.simpleString()

    def encode(batches):
        names = ["cls", "label", "size", "code", "factor", "small", "scales", "keys"]
        for batch in batches:
            length = batch.column("size").to_numpy()
            for size in np.unique(length):
                at = pa.array(np.flatnonzero(length == size))
                x = units(np.array(batch.column("vector").take(at).to_pylist(), dtype=np.float64))
                code, factor, small, scales = coded(x)
                made = [pa.array([r.tobytes() for r in code]), pa.array(factor), pa.array([r.tobytes() for r in small]), pa.array([r.tobytes() for r in scales]), pa.array(list(keys(x, bits, tables)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names[:3]], *made], names)

    codes = stored(classes.select("cls", "label", "size", "vector").mapInArrow(encode, f"cls long, label {kind}, size int, code binary, factor double, small binary, scales binary, keys array<long>"), "vector-codes")
    bucket = ["label", "size", "table", "key"]
    placed = codes.select("label", "size", F.posexplode("keys").alias("table", "key"))
    blocks = stored(placed.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vector-blocks")
    dealt = codes.select("*", F.posexplode("keys").alias("table", "key")).drop("keys").join(blocks, bucket).withColumn("block", F.pmod(F.xxhash64(F.lit(29), "cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    coded_columns = ["code", "factor", "small", "scales"]
    dealt = dealt.select("cls", *bucket, *coded_columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    met = dealt.groupBy(*bucket, "i", "j").applyInArrow(open_ones, f"cls long, label {kind}, size int, table int, key long, i int, j int, side int")
    left = stored(met, "vector-open").join(classes.select("cls", "vector", "members"), "cls")
    found = left.groupBy(*bucket, "i", "j").applyInArrow(lambda t: compare(t, bits, tables), "cls long, n long, least long")
    found = stored(found, "vector-links")

    counted = found.groupBy("cls").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")), "vector-groups")
    named = classes.select("cls", "members", "least_id").join(counted, "cls", "left").join(groups, F.col("cls") == F.col("node"), "left")
    named = stored(named.select("cls", "members", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least_id", F.coalesce("component", "cls").alias("group")), "vector-named")
    ids = stored(named.groupBy("group").agg(F.min("least_id").alias("component_id"), F.count("*").alias("k")), "vector-ids")
    named = stored(join_named(named, ids, "group", "k").select("cls", "members", "n_links", "component_id"), "vector-classed")
    linked = join_named(good.select("vec_id", "cls"), named, "cls", "members").select("vec_id", "n_links", "component_id")
    out = linked.unionByName(rows.filter("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
