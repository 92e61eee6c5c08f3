"""Split-ready CSV, annotations, file inventories, hash manifests, packet captures; writers."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import features as ft
from netloom.functions.parse import epoch, ipv4, number, port_high, port_low, port_span
from netloom.operators.contracts import Rule
from netloom.operators.splits import run_of_path, union_runs
from netloom.sources import logs

# Columns of the annotation file.
ANNOTATION = ["event_id", "run_id", "label", "attacker_ip", "target_ip", "target_hostname", "protocol", "target_port", "start_utc", "end_utc", "tool", "command", "command_argv", "parameters", "return_code", "status", "error_type", "campaign_id", "campaign_sha256", "config_id", "split", "scenario_version", "orchestrator_version"]


def split_ready_schema(columns: list[str], text: tuple[str, ...] = ()) -> T.StructType:
    """Types by name: run ids whole, categories and labels text, all else doubles. Nothing is inferred."""
    kinds = {"run_id": T.IntegerType(), **dict.fromkeys([*ft.CATEGORICAL, "label", *text], T.StringType())}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).first()[0].split(",")


def read_split_ready(spark: SparkSession, path: str, text: tuple[str, ...] = ()) -> DataFrame:
    """A split-ready, ML or audit CSV by explicit types; empty cells are null, and so is NaN."""
    columns = csv_header(spark, path)
    d = spark.read.csv(path, header=True, schema=split_ready_schema(columns, text))
    return d.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if kind == "double" else F.col(c) for c, kind in d.dtypes])


def load_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several runs as one frame; a run id that a file lacks comes from its name, or its place in the list."""
    frames = []
    for i, path in enumerate(paths):
        d = read_split_ready(spark, path)
        if "run_id" not in d.columns:
            d = d.withColumn("run_id", run_of_path(F.lit(path), F.lit(i)))
        frames.append(d)
    return union_runs(frames)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the row number ``ord``."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return d.withColumn("ord", F.monotonically_increasing_id())  # a file that may hold line breaks in cells is read by one task


# The protocol and the tool that each attack is made with.
ATTACK_PROTOCOL = {"PortScan": "tcp", "BruteForce": "tcp", "DoS": "udp"}
ATTACK_TOOL = {"PortScan": "nmap", "BruteForce": "hydra", "DoS": "python3"}
# Annotation columns that tell a campaign.
CAMPAIGN_CELLS = ["campaign_id", "campaign_sha256", "config_id", "split"]


def annotation_rules(columns: list[str] | None = None) -> list[Rule]:
    """What each annotation row must fulfil; rules on columns that a file lacks are left out."""
    c = F.col
    start, end = epoch("start_utc"), epoch("end_utc")
    lo, hi = port_low("target_port"), port_high("target_port")
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    code, kind = F.trim("return_code").try_cast("int"), F.coalesce(F.trim("error_type"), F.lit(""))
    of_class = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.trim("label"))
    tool = F.lower(F.regexp_extract(F.trim("tool"), r"([^/]*)$", 1))
    rules = [
        (("event_id",), Rule("event_id: blank", blank("event_id"))), (("run_id",), Rule("run_id: not whole", ~F.coalesce(F.trim("run_id").rlike(r"^\d+$"), F.lit(False)))),
        (("label",), Rule("label: unknown", ~F.coalesce(F.trim("label").isin(*[x for x in ft.LABELS if x != "BENIGN"]), F.lit(False)))),
        (("attacker_ip",), Rule("attacker_ip: invalid", ~ipv4("attacker_ip"))), (("target_ip",), Rule("target_ip: invalid", ~ipv4("target_ip"))), (("attacker_ip", "target_ip"), Rule("endpoints: equal", c("attacker_ip") == c("target_ip"))),
        (("protocol",), Rule("protocol: unknown", ~F.coalesce(F.lower("protocol").isin("tcp", "udp"), F.lit(False)))),
        (("protocol", "label"), Rule("protocol: not of the attack", F.lower("protocol").isin("tcp", "udp") & (F.lower("protocol") != of_class(ATTACK_PROTOCOL)))),
        (("tool",), Rule("tool: blank", blank("tool"))), (("tool", "label"), Rule("tool: not of the attack", ~blank("tool") & (tool != of_class(ATTACK_TOOL)))), (("command",), Rule("command: blank", blank("command"))),
        (("target_port",), Rule("target_port: invalid", lo.isNull() | hi.isNull() | (lo < 1) | (hi > 65535) | (lo > hi))),
        (("start_utc",), Rule("start_utc: unreadable", start.isNull())), (("end_utc",), Rule("end_utc: unreadable", end.isNull())), (("start_utc", "end_utc"), Rule("interval: empty", end <= start)),
        (("status",), Rule("status: unknown", ~F.coalesce(c("status").isin("success", "failed"), F.lit(False)))),
        (("return_code",), Rule("return_code: not whole", code.isNull())), (("status", "return_code"), Rule("return_code: not 0 on success", (c("status") == "success") & (code != 0))),
        (("status", "error_type"), Rule("error_type: on success", (c("status") == "success") & (kind != ""))), (("status", "return_code", "error_type"), Rule("status: failed without a reason", (c("status") == "failed") & (code == 0) & (kind == ""))),
    ]
    return [r for needs, r in rules if columns is None or set(needs) <= set(columns)]


def annotation_file_rules(annotations: DataFrame) -> DataFrame:
    """(rule, violations) that concern rows together: event ids that come twice, and runs beyond the first."""
    twice = annotations.filter(F.trim("event_id") != "").groupBy(F.trim("event_id").alias("e")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    runs = annotations.select(F.trim("run_id").try_cast("int").alias("r")).filter("r is not null").agg(F.greatest(F.count_distinct("r") - 1, F.lit(0)).alias("violations"))
    return twice.select(F.lit("event_id: repeated").alias("rule"), "violations").unionByName(runs.select(F.lit("run_id: several runs").alias("rule"), "violations"))


def campaign_aware(annotations: DataFrame) -> bool:
    """Whether any row tells a campaign, in one of the columns that may."""
    here = [c for c in CAMPAIGN_CELLS if c in annotations.columns]
    if not here:
        return False
    told = F.lit(False)
    for c in here:
        told = told | (F.coalesce(F.trim(c), F.lit("")) != "")
    return not annotations.filter(told).isEmpty()


def attack_windows(annotations: DataFrame, use_failed: bool = False, padding_ms: float = 0.0) -> DataFrame:
    """Windows for the interval joins, from successful annotations unless failed ones are asked for."""
    d = annotations if use_failed else annotations.filter(F.col("status") == "success")
    pad = padding_ms / 1000
    return d.select(
        "event_id", F.col("label").alias("w_label"), F.col("attacker_ip").alias("attacker"), F.col("target_ip").alias("target"), F.lower("protocol").alias("w_proto"),
        port_low("target_port").alias("port_lo"), port_high("target_port").alias("port_hi"), port_span("target_port").alias("span"),
        (epoch("start_utc") - pad).alias("start"), (epoch("end_utc") + pad).alias("end"), "ord",
    )


def single_version(annotations: DataFrame, column: str, known: list[str], every_row: bool = False) -> str | None:
    """The one version that rows name, or None if the column is absent or empty.

    Several or an unknown one is an error, and so is, with ``every_row``, a row without one.
    """
    if column not in annotations.columns:
        if every_row:
            raise ValueError(f"{column}: no such column")
        return None
    cell = F.coalesce(F.trim(column), F.lit(""))
    if every_row and not annotations.filter(cell == "").isEmpty():
        raise ValueError(f"{column}: rows without one")
    found = [r[0] for r in annotations.select(cell.alias("v")).filter("v <> ''").distinct().limit(3).collect()]
    if len(found) > 1 or any(v not in known for v in found):
        raise ValueError(f"{column}: {sorted(found)}")
    return found[0] if found else None


def read_json(text: str) -> tuple[dict, str]:
    """An object from strict JSON (no NaN, no repeated keys) and the SHA-256 of its text."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key comes twice")
        return out

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    found = json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    if not isinstance(found, dict):
        raise ValueError("no JSON object")
    return found, hashlib.sha256(text.encode()).hexdigest()


def write_json(spark: SparkSession, path: str, value: dict) -> str:
    """Write strict JSON under a temporary name and rename it; returns the SHA-256 of its text."""
    text = strict_json(value)
    jvm = spark.sparkContext._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(here)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(there, False)
    if not fs.rename(here, there):
        raise OSError(f"{path} could not be renamed")
    return hashlib.sha256(text.encode()).hexdigest()


def write_status(spark: SparkSession, path: str, state: str, fields: dict) -> str:
    """The status of a run, as ``running``, ``failed`` (with an error) or ``success``; returns its digest."""
    if state not in ("running", "failed", "success"):
        raise ValueError(f"no state {state}")
    if state == "failed" and not fields.get("error"):
        raise ValueError("a failed run needs an error")
    return write_json(spark, path, {**fields, "status": state})


# How the files of a run are named.
SPLIT_READY, RUN_STATUS = "_split_ready.csv", "_run_status.json"


def statuses_beside(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, status_path, present, text, sha256): each split-ready file with the status file that belongs beside it."""
    rows = []
    for path in paths:
        if not path.endswith(SPLIT_READY):
            raise ValueError(f"{path} is not named *{SPLIT_READY}")
        rows.append((path, path[: -len(SPLIT_READY)] + RUN_STATUS))
    wanted = spark.createDataFrame(rows, "path string, status_path string")
    there = [s for _, s in rows if not logs.absent(spark, s)]
    name = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    kind = "__at string, text string, sha256 string"
    found = spark.read.format("binaryFile").load(there).select(name(F.col("path")).alias("__at"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256")) if there else spark.createDataFrame([], kind)
    out = wanted.join(found, name(F.col("status_path")) == F.col("__at"), "left")
    return out.select("path", "status_path", F.col("text").isNotNull().alias("present"), "text", "sha256")


def read_cells(spark: SparkSession, path: str, label: str = "label", binary: bool = False, look_at: int = 500, benign: str = "BENIGN") -> tuple[DataFrame, list[str], list[str]]:
    """A CSV for the shortcut audit: cells, its numeric columns and its text columns.

    A column is numeric if of its first ``look_at`` cells that are not empty all are numbers (that
    look is the feature, the cells themselves are all read). Numeric cells that are no number are
    null. Labels may be folded to attack or benign.
    """
    d = spark.read.csv(path, header=True, inferSchema=False)
    columns = [c for c in d.columns if c != label]
    empty = lambda c: F.coalesce(F.trim(ft.quoted(c)), F.lit("")).isin("", "nan", "None")
    numeric = []
    for c in columns:
        seen = d.filter(~empty(c)).select(F.trim(ft.quoted(c)).try_cast("double").alias("v")).limit(look_at).agg(F.count("*").alias("n"), F.count("v").alias("k")).first()
        if seen["n"] and seen["n"] == seen["k"]:
            numeric.append(c)
    out = d.select(*[(number(ft.quoted(c)) if c in numeric else F.when(~empty(c), F.trim(ft.quoted(c)))).alias(c) for c in columns], (ft.binary_label(ft.quoted(label), benign) if binary else ft.quoted(label)).alias(label))
    return out, numeric, [c for c in columns if c not in numeric]


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of files under a folder, in path order."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = path.rstrip("/").split("/")[-1]
    return d.select(F.regexp_replace(F.substring_index("path", f"/{root}/", -1), r"\\", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def parse_manifest(raw: DataFrame) -> DataFrame:
    """(sha256, path) from lines (value) ``<64 hex>  [*]<path>``; comments and blanks are passed over, others an error."""
    line = r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$"
    some = raw.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    good = F.when(F.col("value").rlike(line), True).otherwise(F.raise_error(F.concat(F.lit("malformed manifest line: "), F.col("value"))).cast("boolean"))
    return some.filter(good).select(F.lower(F.regexp_extract("value", line, 1)).alias("sha256"), F.replace(F.regexp_extract("value", line, 2), F.lit("\\"), F.lit("/")).alias("path"))


def pcap_info(content: bytes) -> dict:
    """ok, reason, packets, first_ts, last_ts of a classic capture file."""
    out = {"ok": False, "reason": "", "packets": 0, "first_ts": None, "last_ts": None}
    orders = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
    order = orders.get(content[:4])
    if order is None or len(content) < 24:
        return out | {"reason": "no capture header"}
    major, _, _, _, snaplen = struct.unpack(order[0] + "HHiII", content[4:20])
    if major != 2 or snaplen == 0:
        return out | {"reason": "unknown version or no snap length"}
    at = 24
    while at < len(content):
        if at + 16 > len(content):
            return out | {"reason": "a record header is cut off"}
        sec, sub, kept, _ = struct.unpack(order[0] + "IIII", content[at : at + 16])
        if kept > max(snaplen, 65535) or at + 16 + kept > len(content):
            return out | {"reason": "a record is cut off"}
        ts = sec + sub / order[1]
        out["first_ts"] = ts if out["first_ts"] is None else out["first_ts"]
        out["last_ts"], out["packets"], at = ts, out["packets"] + 1, at + 16 + kept
    return out | {"ok": out["packets"] > 0, "reason": "" if out["packets"] else "no packets"}


def walk_captures(files: DataFrame) -> DataFrame:
    """(path, ok, reason, packets, first_ts, last_ts) of capture files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"path": p} | pcap_info(bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "ok", "reason", "packets", "first_ts", "last_ts"])

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, reason string, packets long, first_ts double, last_ts double")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """``walk_captures`` of the files at a path; a file is in one task's memory."""
    return walk_captures(spark.read.format("binaryFile").load(path))


def unambiguous(audit: DataFrame) -> DataFrame:
    """Audit rows that are not marked ambiguous; a mark that is no number is none."""
    return audit.filter(F.coalesce(F.trim(F.col("ambiguous").cast("string")).try_cast("double"), F.lit(0.0)) == 0)


def publish(frames: dict[str, DataFrame], folder: str, status: dict, fmt: str = "parquet") -> None:
    """Write several outputs as one set: to a staging folder, then renamed, the status file last.

    Existing outputs are an error. If a rename fails, those made so far are undone. Readers trust a
    set only with its status file.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [n for n in [*frames, "status.json"] if fs.exists(path(f"{folder}/{n}"))]
    if taken:
        raise FileExistsError(f"{folder} has {taken}")
    staging = f"{folder}/_staging"
    for name, d in frames.items():
        writer = d.write.mode("overwrite")
        (writer.option("header", "true").csv if fmt == "csv" else writer.parquet)(f"{staging}/{name}")
    done = []
    try:
        for name in frames:
            if not fs.rename(path(f"{staging}/{name}"), path(f"{folder}/{name}")):
                raise OSError(f"{name} could not be renamed")
            done.append(name)
        out = fs.create(path(f"{staging}/status.json"))
        out.write(bytearray(strict_json(status).encode()))
        out.close()
        if not fs.rename(path(f"{staging}/status.json"), path(f"{folder}/status.json")):
            raise OSError("the status could not be renamed")
    except Exception:
        for name in done:
            fs.delete(path(f"{folder}/{name}"), True)
        raise
    finally:
        fs.delete(path(staging), True)


def strict_json(value: dict) -> str:
    """JSON with sorted keys and without NaN."""
    return json.dumps(value, sort_keys=True, allow_nan=False, indent=2)
