import glob
import gzip
import hashlib
import io
import os
import random
import zlib

import pytest

from netloom.llm import warc

SCHEMA = "page_id long, url string, html string, value string"
LONG = "x" * 999 + "é"


def plain(rows):
    by = {}
    for page, _, html, _ in rows:
        by.setdefault(html or "", []).append(page)
    out = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        same = by[html or ""]
        last = max((p for p in same if p is not None), default=None)
        refers = last if len(data) >= 1000 and len(same) > 1 and page != last else None
        out.append((page, url, "response" if refers is None else "revisit", refers, len(data), hashlib.sha1(data).hexdigest(), data if refers is None else None))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("size", [1, 97, 1 << 24])
def test_round_trip(spark, tmp_path, size):
    rng = random.Random(1)
    rows = [(1, "http://a/ b%\r\nX: 1", LONG, "c"), (5, None, LONG, "c"), (5, "u", LONG, "c"), (None, "n", LONG, "c"), (2, "é", "short", None), (3, "é", "short", None), (4, "", None, None), (6, "e", "", None),
            (7, "c", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08", None), (None, "q", "z" * 5000, None), (None, "q", "z" * 5000, None), (-8, "m", "big " * 300000, None)]
    rows += [(100 + i, f"u{i}", "".join(rng.choice("abcé\n") for _ in range(rng.randrange(3000))), None) for i in range(20)]
    folder = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder)
    if size == 1:  # each byte a range: over few records
        few = str(tmp_path / "few")
        warc.write_archives(spark.createDataFrame(rows[4:8], SCHEMA).coalesce(1), few)
        rows, folder = rows[4:8], few
    got = [tuple(r)[:6] + (None if r.payload is None else bytes(r.payload),) for r in warc.read_archives(spark, folder, payload=True, size=size).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_files_are_plain_gzip(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(i, "u", f"text {i}", None) for i in range(9)], SCHEMA), f"{tmp_path}/w")
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/part*") if os.path.getsize(f))
    assert data.count(b"WARC/1.1\r\n") == 9 and data.count(b"text ") == 9


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


@pytest.mark.parametrize("size", [13, 1000, 50000])
def test_ranges_own_what_starts_in_them(size):
    rng = random.Random(2)
    # Incompressible payloads with magics, and a gzip member that is no record, stand in the stream as they are.
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    records = [warc.record(i, "u", noise(rng.randrange(3000)) + warc.MAGIC + noise(40) + warc.member(b"WARC/0 no") + noise(9), "00" * 20, None) for i in range(40)]
    data = b"".join(warc.member(r) + warc.EMPTY * rng.randrange(2) for r in records)
    got = []
    for start in range(0, len(data), size):
        got += warc.records_in(io.BytesIO(data), len(data), start, min(start + size, len(data)))
    assert got == records


def test_damage_is_an_error(spark, tmp_path):
    bad = warc.member(warc.record(1, "u", b"text", hashlib.sha1(b"other").hexdigest(), None))
    (tmp_path / "a.warc.gz").write_bytes(bad)
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, f"{tmp_path}/a.warc.gz").collect()


@pytest.mark.parametrize("size", [7, 300, 4000])
def test_an_archive_in_a_payload_is_no_record(size):
    rng = random.Random(4)
    inner = b"".join(warc.member(warc.record(900 + i, "in", b"inside", "00" * 20, None)) for i in range(2))
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    squeeze = lambda r: (lambda z: z.compress(r) + z.flush())(zlib.compressobj(0, zlib.DEFLATED, 31))  # noqa: E731  stored as it is
    records = [warc.record(i, "u", noise(50) + inner + noise(60 + i), "00" * 20, None) for i in range(12)]
    data = b"".join(map(squeeze, records))
    assert data.count(inner) == 12
    got = []
    for start in range(0, len(data), size):
        got += warc.records_in(io.BytesIO(data), len(data), start, min(start + size, len(data)))
    assert got == records


def test_ranges_are_partitions_of_their_own(spark, tmp_path):
    rows = [(i, "u", f"text {i} " * 50, None) for i in range(300)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/w")
    from pyspark.sql import functions as F

    got = warc.read_archives(spark, f"{tmp_path}/w", size=2000).select("page_id", F.spark_partition_id().alias("p"))
    assert got.count() == 300 and got.select("p").distinct().count() > 4


def test_a_cut_archive_is_an_error(spark, tmp_path):
    data = b"".join(warc.member(warc.record(i, "u", b"text", hashlib.sha1(b"text").hexdigest(), None)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(data[:-9])
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, f"{tmp_path}/a.warc.gz").collect()
