"""WARC archives: a writer of one gzip member a record, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of so many bytes or more are stored once; equal ones revisit them.
LEAST_BYTES = 1000
#: Bytes of a range that one task scans, and that it reads at once beyond it.
RANGE, AHEAD = 16 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Members behind a range that have to be good too, before what starts in it is taken for records.
SURE = 8
RECORD = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


#: Stands between records in a file: a member of no bytes, which every gzip reader passes over.
EMPTY = member(b"")


def urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    """The page of a record's name; none where there is no name or no page in it."""
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(digits[1]) if digits else None


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of ``refers`` that has the HTTP head but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers)}"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a head, names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def parsed(data: bytes) -> dict:
    """A record's columns; the digest of a response is computed from what was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    out = {"page_id": page_of(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": page_of(warc.get("warc-refers-to"))}
    if out["url"] is not None:
        out["url"] = re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), out["url"])
    if warc["warc-type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(fields(http)["content-length"]), "payload_digest": said}
    sha1 = hashlib.sha1(payload).hexdigest()
    if sha1 != said:
        raise ValueError(f"record {warc.get('warc-record-id')}: its payload has another digest than its head says")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": sha1}


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to files in ``folder``.

    Payloads are the html in UTF-8, null being empty. Of equal payloads of LEAST_BYTES or more, that
    with the largest page_id is a response and the others revisit it; rows that share that id are
    responses each, and so are rows without an id among themselves (one with an id comes before
    them). Html of any length is one record, in one task's memory; equal rows are records each; an empty
    table writes no record; further columns are not looked at. Spark's text writer stores the members
    as they are, so task output is committed by Spark.
    """
    slim = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    held = slim.filter(F.col("bytes") >= LEAST_BYTES).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha1"))
    p = p.join(held.select("sha1", "last"), "sha1", "left").withColumn("refers", F.when(~F.coalesce(F.col("page_id") == F.col("last"), F.lit(False)), F.col("last")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:2]] + [batch.column(2).cast(pa.binary()).to_pylist(), *[c.to_pylist() for c in batch.columns[3:]]]
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*row)) for row in zip(*columns, strict=True)], pa.binary())], ["value"])

    made = p.select("page_id", "url", "html", "sha1", "refers").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin1")).text(folder)


HEAD = re.compile(rb"WARC/1\.\d+\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")


def is_record(data: bytes) -> bool:
    """Whether a member is one whole record: a head that can be decoded, with a type, an id and the length that follows."""
    head = HEAD.match(data)
    if head is None:
        return False
    named = fields(head[0])
    length = named.get("content-length", "")
    return "warc-type" in named and "warc-record-id" in named and length.isdigit() and len(data) == head.end() + int(length) + 4 and data.endswith(b"\r\n\r\n")


class Members:
    """The bytes of a file from ``start`` on, read as far as they are asked for."""

    def __init__(self, file, length: int, start: int, stop: int) -> None:
        file.seek(start)
        self.file, self.base = file, start
        self.data = file.read(min(stop + AHEAD, length) - start)

    def more(self) -> bool:
        got = self.file.read(AHEAD)
        self.data += got
        return bool(got)

    def inflated(self, at: int) -> tuple[bytes, int] | None:
        """What the member at ``at`` inflates to and where it ends; None if there is no whole member of a record (or of no bytes)."""
        inflate, parts, fed, size = zlib.decompressobj(31), [], at, 0
        while not inflate.eof:
            if fed >= len(self.data) and not self.more():
                return None
            piece = self.data[fed : fed + AHEAD]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error:
                return None
            fed += len(piece)
            size += len(parts[-1])
            if size and not b"".join(parts[:2])[: len(RECORD)].startswith(RECORD[:size]):
                return None
        out = b"".join(parts)
        return (out, fed - len(inflate.unused_data)) if not out or is_record(out) else None


def chain(members: Members, at: int, stop: int, beyond: int = 0) -> Iterator[bytes | None]:
    """The records from ``at`` on that start before ``stop``; None, as the last, if a member isn't good or has no other behind it.

    That is looked at for ``beyond`` more members behind ``stop`` too.
    """
    while members.base + at < stop or beyond > 0:
        inside = members.base + at < stop
        got = members.inflated(at)
        if got is None:
            yield None
            return
        if inside and got[0]:
            yield got[0]
        beyond -= not inside
        at = got[1]
        while len(members.data) < at + len(MAGIC) and members.more():
            pass
        behind = members.data[at : at + len(MAGIC)]
        if not behind:
            return
        if behind != MAGIC:
            yield None
            return


def records_in(file, length: int, start: int, stop: int) -> Iterator[bytes]:
    """The records of a gzip file that start in bytes [start, stop), wherever they end.

    Each place with gzip's magic is a candidate. It starts a record if what it inflates to is one
    whole record and the members behind it are good up to the end of the range and SURE more, or up
    to the file's end: so archives that lie inside a payload aren't taken for records. Members of no bytes are passed
    over. In the first range the file has to start with a good member, and a bad one is an error.
    """
    members, at = Members(file, length, start, stop), 0
    if start == 0:
        for data in chain(members, 0, stop):
            if data is None:
                raise ValueError("a damaged archive")
            yield data
        return
    while True:
        at = members.data.find(MAGIC, at)
        if at < 0 or members.base + at >= stop:
            return
        if members.inflated(at) is not None:
            if all(data is not None for data in chain(members, at, stop, SURE)):  # a first pass that holds one record at a time
                yield from chain(members, at, stop)
                return
        at += 1


def read_archives(spark: SparkSession, folder: str, payload: bool = False, size: int = RANGE) -> DataFrame:
    """The records of all files in ``folder``: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    Files are split in ranges of ``size`` bytes; a task owns the records that start in its range. A
    damaged record raises an error. Files are opened through Arrow's file systems, in the executors.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length").filter("length > 0")
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    # Rows are few and tiny, the work behind each is not: a number of partitions that isn't merged again.
    many = ranges.count()
    ranges = ranges.repartition(max(1, min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payload]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path, length, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, name = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for data in records_in(file, length, start, min(start + size, length)):
                        rows.append(parsed(data))
                        held += len(data)
                        if held > RANGE:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return ranges.select("path", "length", "start").mapInArrow(run, schema)
