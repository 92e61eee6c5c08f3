"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in blocks: a block's documents become places in the block's list of
distinct words, and are stored as such. The lists of all blocks are dealt by a hash of the word, so
that all mentions of a word meet, and each distinct word is encoded once. The ids go back to the
part of the table whose blocks asked, are joined to their pieces there, and put at the words'
positions. So neither texts nor places are shuffled, only distinct words and their ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from netloom.llm.common import give_back, stored

#: Bytes of text of a block (a longer text is one by itself), and of all texts for each share of the word table.
BLOCK, SHARE = 12 << 20, 16 << 20
#: Words that the tokenizer encodes in one call.
CALL = 20_000
#: Texts whose ids must be those of their words, and their decoded text that of their pieces.
PROBES = ("the cat", "It's 12 o'clock , really ?!", "Über\tété\nnaïve", "a  b\r\n c3po x", "日本 語 🙂 é ок", ". . , 7 7")


class Vocabulary:
    """A tokenizer that ends words at white space, with the piece of each id.

    Raises ValueError for a tokenizer whose ids of a text are not those of its words between blanks,
    one after the other, or that decodes other than by joining pieces with blanks.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        pieces = [""] * (max(names.values(), default=-1) + 1)
        for piece, i in names.items():
            pieces[i] = piece
        self.pieces = pa.array(pieces, pa.string())
        self.decimals = pa.array(list(map(str, range(len(pieces)))), pa.string())
        for text in PROBES:
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids
            apart = [i for e in self.encode(text.split()) for i in e]
            if whole != apart or self.tokenizer.decode(whole, skip_special_tokens=False) != " ".join(pieces[i] for i in whole):
                raise ValueError(f"{path}: not a vocabulary of words that end at blanks; it can't be encoded word by word")

    def encode(self, words: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), CALL):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(words[at : at + CALL], add_special_tokens=False)]
        return out


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary at ``path``."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte by byte: first all low bytes, then all next ones."""
    return squeezed(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, most frequent first, the place of each word in them, and the words of each text."""
    listed = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    owner, found = pc.list_parent_indices(listed).to_numpy(), listed.flatten().dictionary_encode()
    kinds, codes = found.dictionary, found.indices.to_numpy()
    empty = pc.index(kinds, pa.scalar("", kinds.type)).as_py()  # what stands before a leading blank
    if empty >= 0:
        owner, codes = owner[codes != empty], codes[codes != empty]
    seen = np.bincount(codes, minlength=len(kinds))
    order = np.argsort(-seen, kind="stable")[: int((seen > 0).sum())]
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(order))
    return kinds.take(pa.array(order)), rank[codes], np.bincount(owner, minlength=len(texts))


def encode(docs: DataFrame, path: str, carry: list[str], texts: bool = False) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) with n_tokens, ids_sha256 and decoded_sha256.

    With ``texts``, token_ids (an array) and decoded come too. A result whose name is also carried
    gets the ending ``_found``. Null, empty and blank texts have no ids. Each row is encoded by
    itself, so equal rows give equal rows and ties don't matter. Texts of any length are encoded
    whole; a text, and a block of some megabytes of texts, is in one task's memory. Special tokens
    written in a text are recognised and stay in the decoded text. An empty table gives no rows.

    Blocks and their lists of words are written to the shared folder once, and a part of them, what
    one task wrote, is read through Arrow's file systems where its ids arrive. A word goes to the
    table once for each block that has it, however often it stands there, so frequent words are no
    hot keys.
    """
    spark = docs.sparkSession
    held = [f"c{i}" for i in range(len(carry))]
    kept = StructType()
    for name, c in zip(held, carry, strict=True):
        kept.add(name, docs.schema[c].dataType)
    parts = StructType(kept.fields[:]).add("block", "long").add("share", "long").add("n", "long").add("data", "binary").add("ranks", "binary")
    # A row for each text with the number of its words; the first of a block holds the places of all words of the block.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = total // SHARE + 1
    cores = spark.sparkContext.defaultParallelism
    tasks = max(min(shares, int(spark.conf.get("spark.sql.shuffle.partitions"))), cores)
    shares = max(shares, 4 * tasks)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in blocks(batch, len(held)):
                kinds, codes, sizes = split(some.column(len(held)))
                n, none = some.num_rows, pa.nulls(some.num_rows, pa.binary())
                places = pa.array([packed(codes), *[None] * (n - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(len(held))], pa.repeat(pa.scalar(base, pa.int64()), n), pa.nulls(n, pa.int64()), pa.array(sizes, pa.int64()), places, none], parts.fieldNames())
                words = kinds.cast(pa.binary()).to_pylist()
                of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(shares)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.concatenate((np.ones(min(len(of), 1), bool), np.diff(of[order]) > 0)))
                asked = [order[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)] if len(cuts) else []
                n = len(asked)
                rows = [pa.array([base] * n, pa.int64()), pa.array([int(of[x[0]]) for x in asked], pa.int64()), pa.array([len(x) for x in asked], pa.int64())]
                rows += [pa.array([squeezed(b"\n".join([words[i] for i in x.tolist()])) for x in asked], pa.binary()), pa.array([packed(np.diff(x, prepend=0)) for x in asked], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, some.column(i).type) for i in range(len(held))], *rows], parts.fieldNames())
                base += 1
        give_back()

    def look_up(asked: pa.Table) -> pa.Table:
        """Encode the distinct words of a share of the table; answer each block's question with ids, word after word."""
        words = [w for data in asked.column("data").to_pylist() for w in unsqueezed(data).decode().split("\n")]
        found = pa.array(words, pa.large_string()).dictionary_encode()
        ids = vocabulary(path).encode(found.dictionary.to_pylist())
        answers, at = [], 0
        codes = found.indices.to_pylist()
        for n in asked.column("n").to_pylist():
            mine = [ids[c] for c in codes[at : at + n]]
            answers.append((packed(np.array([i for x in mine for i in x], np.int64)), packed(np.fromiter(map(len, mine), np.int64, n))))
            at += n
        del words, found, ids, codes
        give_back()
        return pa.table({"block": asked.column("block"), "ranks": asked.column("ranks"), "ids": pa.array([a[0] for a in answers], pa.binary()), "sizes": pa.array([a[1] for a in answers], pa.binary())})

    out = StructType()
    for name in held:
        out.add(name, kept[name].dataType)
    out.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if texts:
        out.add("token_ids", ArrayType(IntegerType())).add("decoded", "string")

    kinds = to_arrow_schema(out)

    def joined(mine: pa.Table, answers: pa.Table) -> pa.Table:
        """Put the ids of a block's words at their positions, and the ids' pieces beside them."""
        none = np.empty(0, np.int64)
        ranks = np.concatenate([*[np.cumsum(unpacked(x)) for x in answers.column("ranks").to_pylist()], none])
        sizes, ids = (np.concatenate([*[unpacked(x) for x in answers.column(c).to_pylist()], none]) for c in ("sizes", "ids"))
        size, start = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        size[ranks], start[ranks] = sizes, np.cumsum(sizes) - sizes
        codes, n_words = unpacked(mine.column("data")[0].as_py()), mine.column("n").to_numpy()
        took = size[codes]
        before = np.concatenate(([0], np.cumsum(took)))
        ids = pa.array(ids.astype(np.int32)[np.arange(before[-1]) + np.repeat(start[codes] - before[:-1], took)])
        ends = before[np.concatenate(([0], np.cumsum(n_words)))]
        digests, known = [], vocabulary(path)
        for names in (known.decimals, known.pieces):
            in_text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(ids)), " ")
            digests.append([hashlib.sha256(x.as_buffer()).hexdigest() for x in in_text])
        made = [pa.array(np.diff(ends)), pa.array(digests[0], pa.string()), pa.array(digests[1], pa.string())]
        if texts:
            made += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), in_text]
        columns = [*[mine.column(name) for name in held], *made]
        return pa.Table.from_arrays([c.cast(kinds.field(i).type, safe=False) for i, c in enumerate(columns)], out.fieldNames())

    def of_part(files: pa.Table, answers: pa.Table) -> pa.Table:
        """A part of the blocks, read where it was written, with the answers to it."""
        by = answers.column("block").to_numpy()
        tables, read = [], []
        for name in sorted(files.column("file").to_pylist()):
            system, at = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", unquote(name)))
            with system.open_input_file(at) as file:
                read.append(pq.read_table(file, columns=[*held, "block", "share", "n", "data"]))
        rows = pa.concat_tables(read)
        rows = rows.filter(pc.is_null(rows.column("share")))
        block = rows.column("block").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            tables.append(joined(rows.slice(a, b - a).combine_chunks(), answers.filter(pa.array(by == block[a]))))
        del rows, read
        give_back()
        return pa.concat_tables(tables) if tables else kinds.empty_table()

    named = [F.col(c).alias(name) for name, c in zip(held, carry, strict=True)]
    made = stored(docs.select(*named, F.col("text").alias("text")).mapInArrow(divide, parts), "bpe-blocks")
    part = F.shiftright("block", 32)
    asked = made.filter("share is not null").select("block", "share", "n", "data", "ranks").repartition(tasks, "share")
    table = asked.groupBy("share").applyInArrow(look_up, "block long, ranks binary, ids binary, sizes binary").withColumn("part", part)
    files = made.select(part.alias("part"), F.input_file_name().alias("file")).distinct().repartition(tasks, "part")
    found = files.groupBy("part").cogroup(table.repartition(tasks, "part").groupBy("part")).applyInArrow(of_part, out)
    names = {name: c for name, c in zip(held, carry, strict=True)}
    return found.select(*[F.col(c).alias(names.get(c, c if c not in carry else f"{c}_found")) for c in out.fieldNames()])
