"""Readers of sensor logs: header-driven TSV, JSON lines, tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column order of a connection log without a header.
DEFAULT_CONN = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents"]
ACCESS = "ts double, status int, request struct<method:string, uri:string, remote_ip:string, client_ip:string, host:string>"
SESSION = "campaign_id string, run_id int, attempt_id string, seed long, session_id string, browser string, tier string, site string, url string, start double, end double, pages int, ok boolean, detail string"


LINE = "struct<file:string,block:bigint,row:bigint>"


def absent(spark: SparkSession, path: str) -> bool:
    """Whether no file or folder is at a path (which may be a glob)."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(name)
    return found is None or len(found) == 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): lines of a text source. Line numbers sort by file, block of the file and place in the block.

    Spark deals files and blocks to tasks by size, so the place within a task alone is no order.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", at.alias("line_no"))


def header(raw: DataFrame) -> tuple[list[str], str]:
    """Field names and separator of a TSV log from its # lines."""
    heads = [r.value for r in raw.filter("value like '#separator%' or value like '#fields%'").select("value").distinct().collect()]
    sep = next((h.split(None, 1)[1] for h in heads if h.startswith("#separator")), "\\x09")
    sep = sep.encode().decode("unicode_escape")
    fields = [h for h in heads if h.startswith("#fields")]
    if len(fields) != 1:
        raise ValueError(f"the log has {len(fields)} different #fields lines")
    return fields[0].split(sep)[1:], sep


def read_zeek(spark: SparkSession, path: str, strict: bool = True, columns: tuple[str, ...] = ("uid",)) -> DataFrame:
    """A TSV log with a # header: its fields as text, ``-`` and ``(empty)`` null, and line_no.

    Strict: a row with another number of cells is an error. Else such rows are left out, and a log
    without header has the default connection columns. An absent log has no rows, and ``columns``.
    """
    if absent(spark, path):
        return spark.createDataFrame([], ", ".join([*[f"`{c}` string" for c in columns], f"line_no {LINE}"]))
    raw = lines(spark, path)
    try:
        names, sep = header(raw)
    except ValueError:
        if strict:
            raise
        names, sep = DEFAULT_CONN, "\t"
    rows = raw.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    import re

    rows = rows.withColumn("__c", F.split("value", re.escape(sep)))
    fits = F.size("__c") == len(names)
    if strict:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit(f"{path}: a row has not {len(names)} cells: "), F.substring("value", 1, 80))).cast("boolean"))
    cell = lambda i: F.nullif(F.nullif(F.get("__c", F.lit(i)), F.lit("-")), F.lit("(empty)"))
    return rows.filter(fits).select(*[cell(i).alias(n) for i, n in enumerate(names)], "line_no")


def profile(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One row on a TSV log: present, records, empty, fields, missing_fields, sha256 (of each file, in path order).

    An absent log has no records, fields or digests.
    """
    if absent(spark, path):
        return spark.createDataFrame([(False, 0, True, [], list(required), [])], "present boolean, records long, empty boolean, fields array<string>, missing_fields array<string>, sha256 array<string>")
    text = spark.read.text(path)
    try:
        fields = header(text)[0]
    except ValueError:
        fields = []
    data = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).agg(F.count("*").alias("records"))
    digests = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).groupBy().agg(F.sort_array(F.collect_list(F.struct("path", "d"))).alias("f"))
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return data.join(digests).select(
        F.lit(True).alias("present"), "records", (F.col("records") == 0).alias("empty"), array(fields).alias("fields"), array([c for c in required if c not in fields]).alias("missing_fields"), F.col("f.d").alias("sha256"),
    )


def read_access_log(raw: DataFrame) -> DataFrame:
    """(ts, status, method, uri, client, host) from JSON lines (value); malformed lines are left out."""
    d = raw.select(F.from_json("value", ACCESS).alias("j")).filter("j is not null and j.ts is not null")
    client = F.coalesce(F.nullif(F.col("j.request.remote_ip"), F.lit("")), F.nullif(F.col("j.request.client_ip"), F.lit("")))
    colons = F.length(client) - F.length(F.replace(client, F.lit(":"), F.lit("")))
    client = F.when(colons == 1, F.substring_index(client, ":", 1)).otherwise(client)
    return d.select(F.col("j.ts").alias("ts"), F.col("j.status").alias("status"), F.col("j.request.method").alias("method"), F.col("j.request.uri").alias("uri"), client.alias("client"), F.col("j.request.host").alias("host"))


def read_sessions(raw: DataFrame) -> DataFrame:
    """Benign sessions from JSON lines (value); a malformed line is an error."""
    return raw.select(F.from_json("value", SESSION, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def read_monitor(spark: SparkSession, path: str) -> DataFrame:
    """Probes (ts, url, ok, http_code, latency_ms, error); times without zone are UTC, unreadable ones are left out."""
    from netloom.functions.parse import epoch, number, whole

    d = spark.read.csv(path, header=True, schema="utc string, url string, ok string, http_code string, latency_ms string, error string, cpu_busy string, mem_used_frac string")
    d = d.select(epoch("utc", "utc").alias("ts"), "url", F.coalesce(whole("ok"), F.lit(0)).alias("ok"), whole("http_code").alias("http_code"), number("latency_ms").alias("latency_ms"), "error")
    return d.filter("ts is not null")


def effect_windows(annotations: DataFrame, labels: list[str] | None = None, only_success: bool = True) -> DataFrame:
    """(start, end) of annotations; unreadable or empty intervals are left out."""
    from netloom.functions.parse import epoch

    d = annotations.filter(F.col("status") == "success") if only_success else annotations
    if labels:
        d = d.filter(F.col("label").isin(*labels))
    d = d.select(epoch("start_utc", "utc").alias("start"), epoch("end_utc", "utc").alias("end"))
    return d.filter("start < end")


def parse_drop_statistics(text: Column) -> dict[str, Column]:
    """captured, received, dropped and drop_rate from a capture tool's closing lines."""
    n = lambda what: F.nullif(F.regexp_extract(text, rf"(\d+) packets? {what}", 1), F.lit("")).try_cast("long")
    received, dropped = n("received by filter"), n("dropped by kernel")
    return {"captured": n("captured"), "received": received, "dropped": dropped, "drop_rate": F.when(received > 0, dropped / received)}


def parse_key_lines(text: Column) -> Column:
    """``key : value`` lines as a map, keys and values trimmed, the first of a key winning."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


def clock_offset_ms(text: Column) -> Column:
    """The offset in ms that a time daemon's status names (``System time : 0.00012 seconds slow``)."""
    found = F.regexp_extract(text, r"System time\s*:\s*([0-9.]+) seconds (fast|slow)", 1).try_cast("double")
    return found * 1000
