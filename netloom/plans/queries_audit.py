"""More registered queries: realism, evidence, governance and the smaller operators, with SQL where it can say the same."""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions import parse, policy
from netloom.operators import contracts, effects, intervals, joins, realism, splits, statistics
from netloom.plans import campaign, evidence
from netloom.plans.queries import FLOWS, IN_TIME, REQUESTS, RESOLVED, connections, events, flows, query, shared, table, windows
from netloom.sources import logs, tables

# --- realism ---------------------------------------------------------------------------------------

SIDES = """WITH d AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side, l_returnflag AS label, l_linenumber AS i, l_extendedprice * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 1.25 END AS price,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS quantity, l_linestatus AS status, CASE WHEN l_orderkey % 4 < 2 THEN (l_shipdate::DATE::VARCHAR)[:4] END AS year FROM lineitem),
n AS (SELECT 'price' AS feature, side, label, price AS v FROM d UNION ALL SELECT 'quantity', side, label, quantity FROM d), t AS (SELECT 'status' AS feature, side, label, status AS v FROM d UNION ALL SELECT 'year', side, label, year FROM d)
"""
DISTANCES = """, nr AS (SELECT {g}, min(v) AS lo, max(v) AS hi FROM n WHERE v IS NOT NULL GROUP BY {g}),
nc AS (SELECT {g}, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 60), 59) ELSE 0 END AS cell, count(*) FILTER (side = 'real') AS x, count(*) FILTER (side = 'synthetic') AS y FROM n JOIN nr USING ({g}) WHERE v IS NOT NULL GROUP BY {g}, cell),
tc AS (SELECT {g}, v AS cell, count(*) FILTER (side = 'real') AS x, count(*) FILTER (side = 'synthetic') AS y FROM t WHERE v IS NOT NULL GROUP BY {g}, v),
s AS (SELECT {g}, 'numeric' AS kind, x::DOUBLE / sum(x) OVER w AS p, y::DOUBLE / sum(y) OVER w AS q FROM nc WINDOW w AS (PARTITION BY {g}) UNION ALL SELECT {g}, 'categorical', x::DOUBLE / sum(x) OVER w, y::DOUBLE / sum(y) OVER w FROM tc WINDOW w AS (PARTITION BY {g})),
j AS (SELECT {g}, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS js FROM s GROUP BY {g}, kind)
"""
KS = """, kc AS (SELECT feature, v, count(*) FILTER (side = 'real') AS x, count(*) FILTER (side = 'synthetic') AS y FROM n WHERE v IS NOT NULL GROUP BY feature, v),
kd AS (SELECT feature, abs(sum(x) OVER w::DOUBLE / sum(x) OVER a - sum(y) OVER w::DOUBLE / sum(y) OVER a) AS g FROM kc WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature)),
k AS (SELECT feature, max(g) AS ks FROM kd GROUP BY feature),
m AS (SELECT feature, avg((v IS NULL)::INT) FILTER (side = 'real') AS missing_real, avg((v IS NULL)::INT) FILTER (side = 'synthetic') AS missing_synthetic FROM (SELECT feature, side, v::VARCHAR AS v FROM n UNION ALL SELECT feature, side, v FROM t) GROUP BY feature)
"""


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    even = F.col("l_orderkey") % 2 == 0
    d = table(spark, sf_dir, "lineitem").select(
        even.alias("__even"), F.col("l_returnflag").alias("label"), (F.col("l_extendedprice") * F.when(even, 1.0).otherwise(1.25)).alias("price"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity")).alias("quantity"),
        F.col("l_linestatus").alias("status"), F.when(F.col("l_orderkey") % 4 < 2, F.year("l_shipdate").cast("string")).alias("year"),
    )
    return [d.filter(c).drop("__even") for c in ("__even", "not __even")]


@query("m5_compare", SIDES + DISTANCES.replace("{g}", "feature") + KS + "SELECT feature, kind, round(ks, 9) AS ks, round(js, 9) AS js, round(missing_real, 9) AS missing_real, round(missing_synthetic, 9) AS missing_synthetic FROM j JOIN m USING (feature) LEFT JOIN k USING (feature)")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _sides(spark, sf_dir)
    d = realism.compare(real, synthetic, ["price", "quantity"], ["status", "year"])
    return d.select("feature", "kind", *[F.round(c, 9).alias(c) for c in ("ks", "js", "missing_real", "missing_synthetic")])


BY_CLASS = SIDES + DISTANCES.replace("{g}", "label, feature") + ", c AS (SELECT label, avg(js) FILTER (kind = 'numeric') AS mean_js, avg(js) FILTER (kind = 'categorical') AS mean_cat_js FROM j GROUP BY label) "


@query("m6_by_class", BY_CLASS + "SELECT label, round(mean_js, 9) AS mean_js, round(mean_cat_js, 9) AS mean_cat_js FROM c")
def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _sides(spark, sf_dir)
    d = realism.by_class(real, synthetic, ["price", "quantity"], ["status", "year"])
    return d.select("label", F.round("mean_js", 9).alias("mean_js"), F.round("mean_cat_js", 9).alias("mean_cat_js"))


@query("m6_worst_class", BY_CLASS + "SELECT label AS worst_class, round(mean_js, 9) AS worst_js, round(mean_cat_js, 9) AS worst_cat_js FROM c ORDER BY greatest(mean_js, mean_cat_js) DESC, label DESC LIMIT 1")
def worst_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _sides(spark, sf_dir)
    d = realism.worst_class(real, synthetic, ["price", "quantity"], ["status", "year"])
    return d.select("worst_class", F.round("worst_js", 9).alias("worst_js"), F.round("worst_cat_js", 9).alias("worst_cat_js"))


def _flat(spark: SparkSession, found: dict) -> DataFrame:
    """(field, value): a report's entries as JSON text."""
    key = lambda k: "/".join(map(str, k)) if isinstance(k, tuple) else str(k)
    plain = lambda v: {key(k): plain(x) for k, x in sorted(v.items(), key=lambda kv: key(kv[0]))} if isinstance(v, dict) else v
    return spark.createDataFrame([(k, json.dumps(plain(v))) for k, v in sorted(found.items())], "field string, value string")


@query("m7_transfer")
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _sides(spark, sf_dir)
    row = F.pmod(F.xxhash64(*real.columns), F.lit(10))
    real = real.withColumn("split", F.when(row < 3, "test").otherwise("train"))
    return _flat(spark, realism.transfer(real, synthetic, ["price", "quantity"], ["status", "year"], balance=True, seeds=(0,), trees=20))


@query("m8_domain_report")
def domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, synthetic = _sides(spark, sf_dir)
    return _flat(spark, realism.domain_report(real, synthetic, ["price", "quantity"], ["status", "year"], run=None, trees=20))


# --- ground truth and events -----------------------------------------------------------------------


@query("m25_ground_truth", REQUESTS + """
SELECT v.event_id, v.label, (v.event_id % 4)::BIGINT AS usable_flows, requests_attacker, requests_other, 'tool_executed' || CASE WHEN v.event_id % 4 > 0 THEN ',traffic_observed' ELSE '' END || CASE WHEN requests_attacker > 0 THEN ',application_observed' ELSE '' END AS evidence,
  CASE WHEN v.label = 'BruteForce' AND requests_attacker = 0 AND requests_other > 0 THEN requests_other || ' request(s) of others, none of the attacker: not to be credited' WHEN v.label = 'DoS' THEN 'effect not measured here' ELSE '' END AS note
FROM v JOIN q USING (event_id)""")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    # Methods in lower case: they are compared whatever their case.
    r = e.filter("event_type <> 'error'").select(F.col("t").alias("ts"), F.col("user_id").cast("string").alias("client"), F.when(F.col("event_type") == "purchase", "post").otherwise("get").alias("method"), F.concat(F.lit("/"), "event_type", F.lit("/"), "k").alias("uri"), F.lit("srv:443").alias("host"))
    v = e.filter("event_type = 'error'").select("event_id", F.when(even, "BruteForce").otherwise("DoS").alias("label"), F.col("user_id").cast("string").alias("attacker"), F.lit("srv").alias("target"), F.col("t").alias("start"), (F.col("t") + 86400).alias("end"), F.when(even, "purchase").otherwise("/view").alias("path"))
    seen = v.select("event_id", (F.col("event_id") % 4).alias("usable_flows"), F.lit(None).cast("double").alias("port_coverage"), F.lit(1).alias("span"))
    return effects.ground_truth(v, seen, r).withColumn("evidence", F.array_join("evidence", ","))


@query("j8_audit_events", RESOLVED.replace("{time}", IN_TIME[0.5]) + """
SELECT w.event_id::VARCHAR AS event_id, count(r.flow_id) FILTER (r.ambiguous = 0) AS usable, count(r.flow_id) FILTER (r.ambiguous = 1) AS ambiguous, count(r.flow_id) FILTER (r.label <> CASE WHEN w.event_id % 5 = 0 THEN 'other' ELSE w.w_label END) AS wrong_label, 0::BIGINT AS off_window, 0::BIGINT AS unknown
FROM w LEFT JOIN r ON r.matched_event_id = w.event_id::VARCHAR GROUP BY w.event_id""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified flows against the windows that they name; every fifth window claims another label."""
    audit = intervals.classify(flows(spark, sf_dir), windows(spark, sf_dir), 0.5)
    w = windows(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("w_label")).alias("label"), "start", "end")
    return joins.audit_events(audit, w)


@query("j10_event_bijection", FLOWS + """
SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 7 = 0 THEN 'not claimed' WHEN event_id % 11 = 0 THEN 'not declared' WHEN event_id % 5 = 0 THEN 'other label' ELSE 'other window' END AS problem
FROM w WHERE (event_id % 7 = 0 AND event_id % 11 <> 0) OR (event_id % 7 <> 0 AND (event_id % 11 = 0 OR event_id % 5 = 0 OR event_id % 13 = 0))""")
def event_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    w = windows(spark, sf_dir).select("event_id", F.col("w_label").alias("label"), "start", "end")
    claimed = w.filter("event_id % 7 <> 0").select("event_id", F.when(i % 5 == 0, "x").otherwise(F.col("label")).alias("label"), (F.col("start") + F.when(i % 13 == 0, 1.5).otherwise(0.5)).alias("start"), "end")
    return joins.event_bijection(claimed, w.filter("event_id % 11 <> 0"))


@query("j21_absent_digests", "SELECT p_partkey FROM part WHERE p_partkey % 6 = 0")
def absent_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    return joins.absent_digests(p, p.filter("p_partkey % 6 <> 0").select(F.upper("sha256").alias("sha256"))).select("p_partkey")


@query("u7_label_sides", "SELECT o_orderpriority AS label, CASE WHEN o_orderpriority = '1-URGENT' THEN 'a' WHEN o_orderpriority = '5-LOW' THEN 'b' ELSE 'both' END AS side FROM orders GROUP BY 1")
def label_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return joins.label_sides(o.filter("o_orderpriority <> '5-LOW'"), o.filter("o_orderpriority <> '1-URGENT'"), "o_orderpriority")


@query("u8_index_difference", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) < 2000")
def index_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return joins.without(o, o.filter(F.year("o_orderdate") >= 2000), "o_orderkey").select("o_orderkey")


@query("f5_audit_ambiguous", "SELECT event_id FROM events WHERE event_id % 4 <> 1")
def audit_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit("0"), F.lit("1"), F.lit("yes"), F.lit(None).cast("string"))
    d = table(spark, sf_dir, "events").select("event_id", F.get(cells, (F.col("event_id") % 4).cast("int")).alias("ambiguous"))
    return tables.unambiguous(d).select("event_id")


@query("u5_schema_difference", "SELECT 'missing' AS side, c AS name FROM (VALUES ('tot_bwd_pkts'), ('label')) v(c) UNION ALL SELECT 'extra', 'uid'")
def schema_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connections(spark, sf_dir)
    d = c.select("uid", *[x.alias(n) for n, x in ft.common_features(c).items() if n != "tot_bwd_pkts"])
    missing, extra = splits.schema_difference(d, [*ft.COMMON, "label"])
    return spark.createDataFrame([("missing", x) for x in missing] + [("extra", x) for x in extra], "side string, name string")


@query("a6_class_balance", "SELECT o_orderstatus AS label, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share, (SELECT avg((o_orderstatus <> 'F')::INT) FROM orders) AS attack_share FROM orders GROUP BY 1")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.balance(table(spark, sf_dir, "orders"), "o_orderstatus", "F").withColumnRenamed("o_orderstatus", "label")


@query("a15_counters", RESOLVED.replace("{time}", IN_TIME[0.5]) + "SELECT count(*) AS flows, count(*) FILTER (label <> 'BENIGN') AS attacks, sum(ambiguous)::BIGINT AS ambiguous, count(*) FILTER (coalesce(d, 0) <= 0) AS without_duration FROM r JOIN f USING (flow_id)")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.counters(intervals.classify(flows(spark, sf_dir), windows(spark, sf_dir), 0.5))


@query("p16_label_codes", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority)::INT - 1 AS y FROM orders")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators import models

    o = table(spark, sf_dir, "orders")
    _, coded = models.encode_labels(o.filter("o_orderkey % 3 > 0"), [o.filter("o_orderkey % 3 = 0")], "o_orderpriority")
    return coded[0].unionByName(coded[1]).select("o_orderkey", "y")


GROUPS = {"sii": ["dst_port_class"], "sni": ["sni_present"], "protocol": ["transport"], "fingerprints": ["ja3", "ja3s"], "temporal_artifacts": ["fwd_init_window_size", "bwd_init_window_size", "fwd_last_window_size", "bwd_last_window_size"], "bookkeeping": ["run_id", "timestamp", "label"]}


@query("p17_column_policy", " UNION ALL ".join(f"SELECT '{g}' AS column_group, '{c}' AS name" for g, cs in GROUPS.items() for c in cs))
def column_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, c) for g, cs in policy.groups(["run_id", "timestamp", *ft.EXTENDED, "label"]).items() for c in cs if g != policy.OTHER]
    return spark.createDataFrame(rows, "column_group string, name string")


@query("p18_regimes", "SELECT * FROM (VALUES ('A1', 89), ('D1', 88), ('D2', 87), ('P', 86), ('F', 85), ('CTD', 83)) v(regime, features)")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = policy.regimes(["run_id", "timestamp", *ft.EXTENDED, "label"])
    return spark.createDataFrame([(k, len(v)) for k, v in found.items()], "regime string, features int")


@query("p2_audit_features", "SELECT l_orderkey || '-' || l_linenumber AS uid, l_linenumber::DOUBLE AS tot_fwd_pkts, CASE WHEN l_linenumber = 1 THEN 'x' ELSE 'none' END AS ja3, CASE WHEN l_linenumber = 2 THEN '1.3' WHEN l_linenumber = 1 THEN '1.2' ELSE 'none' END AS tls_version, CASE WHEN l_linestatus = 'O' THEN 'tcp' ELSE 'udp' END AS label FROM lineitem")
def audit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit frame: the log's own column names, TLS columns without a prefix."""
    i = F.col("orig_pkts").cast("int")
    c = connections(spark, sf_dir).withColumns({"version": F.when(i == 1, "TLSv12"), "ja3": F.when(i == 1, "x"), "quic_version": F.when(i == 2, "1"), "label": F.col("proto")})
    d = ft.audit_features(c)
    return ft.audit_features(d).select("uid", "tot_fwd_pkts", "ja3", "tls_version", "label")


# --- sources and governance ------------------------------------------------------------------------


@query("s1_file_order", "SELECT p_partkey::VARCHAR AS uid, 'new' AS service FROM part")
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a key wins by file name and place, however large the files are."""
    path = shared(spark, "order")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"))
    line = lambda service, copies: p.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(copies)))).orderBy("uid", "n").coalesce(1).select(F.concat_ws("\t", "uid", F.when(F.col("n") == copies, service).otherwise("early")).alias("value"))
    for name, d in (("a", spark.createDataFrame([("#separator \\x09",), ("#fields\tuid\tservice",)], "value string").coalesce(1)), ("b", line("old", 3)), ("c", line("new", 2))):
        d.write.text(f"{path}/{name}")
    return joins.last_by_key(logs.read_zeek(spark, f"{path}/*"), ["uid"], "line_no").select("uid", "service")


@query("s1_absent_log", "SELECT event_id::VARCHAR AS uid, false AS joined FROM events")
def absent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without a QUIC log still joins."""
    path = shared(spark, "conn")
    spark.createDataFrame([("#fields\tuid\tk",)], "value string").coalesce(1).write.text(path)
    events(spark, sf_dir).select(F.concat_ws("\t", F.col("event_id").cast("string"), F.lit("-")).alias("value")).write.mode("append").text(path)
    conn = logs.read_zeek(spark, path)
    return joins.attach(conn, logs.read_zeek(spark, shared(spark, "nowhere")), "uid", "line_no", "quic_").select("uid", F.col("quic_joined").alias("joined"))


@query("s10_versions", "SELECT 'scenario_version' AS name, '2' AS version UNION ALL SELECT 'orchestrator_version', NULL")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 > 0, "2").otherwise(" ").alias("scenario_version"), F.lit("").alias("orchestrator_version"))
    return spark.createDataFrame([(c, tables.single_version(a, c, ["1", "2"])) for c in a.columns], "name string, version string")


@query("s11_campaign_aware", "SELECT 'blank' AS name, false AS aware UNION ALL SELECT 'told', true UNION ALL SELECT 'absent', false")
def campaign_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0]
    frames = {"blank": e.select(F.lit(" ").alias("campaign_id"), F.lit(None).cast("string").alias("split")), "told": e.select(F.when(F.col("event_id") == last, "train").alias("split")), "absent": e.select("event_id")}
    return spark.createDataFrame([(k, tables.campaign_aware(d)) for k, d in frames.items()], "name string, aware boolean")


@query("s17_shortcut_cells", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linestatus END AS status, CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE 'ATTACK' END AS label, 'l_linenumber,l_orderkey,tax' AS numeric FROM lineitem")
def shortcut_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "cells")
    i = F.col("l_linenumber")
    table(spark, sf_dir, "lineitem").select("l_orderkey", i, F.when(i != 3, F.col("l_tax")).alias("tax"), F.when(i == 4, " ").otherwise(F.col("l_linestatus")).alias("status"), F.when(F.col("l_returnflag") == "N", "benign ").otherwise(F.col("l_returnflag")).alias("label")).write.option("header", "true").csv(path)
    d, numeric, _ = tables.read_cells(spark, path, binary=True)
    return d.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "tax", "status", "label", F.lit(",".join(sorted(numeric))).alias("numeric"))


@query("s20_captures", "SELECT r_regionkey::INT AS region, true AS ok, (r_regionkey + 1)::BIGINT AS packets, 100.5::DOUBLE AS first_ts, (100.5 + r_regionkey)::DOUBLE AS last_ts FROM region")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture of r + 1 packets for each region r, a second apart."""
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    rows = [(r[0], bytearray(head + b"".join(struct.pack("<IIII", 100 + k, 500000, 3, 3) + b"abc" for k in range(r[0] + 1)))) for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]
    d = spark.createDataFrame(rows, "region int, content binary")
    return tables.walk_captures(d.select(F.col("region").cast("string").alias("path"), "content")).select(F.col("path").cast("int").alias("region"), "ok", "packets", "first_ts", "last_ts")


@query("s21_clock_texts", "SELECT c_custkey, 'NTP' || c_custkey AS source, (c_custkey % 100) / 1000.0::DOUBLE * 1000 AS offset_ms FROM customer")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Reference ID : NTP"), "c_custkey", F.lit("\nSystem time  : "), F.format_string("%.6f", (F.col("c_custkey") % 100) / 1000.0), F.lit(" seconds slow of NTP time\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", logs.parse_key_lines(text)["Reference ID"].alias("source"), logs.clock_offset_ms(text).alias("offset_ms"))


RUNS = [(y, "train" if y <= 1999 else "validation" if y == 2000 else "test") for y in range(1992, 2002)]


@query("s15_manifest_runs", " UNION ALL ".join(f"SELECT {y} AS run_id, {y - 1992} AS config_id, '{s}' AS split, '{y}-01-01' AS day, 'DoS,PortScan' AS attacks" for y, s in RUNS))
def manifest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = {str(y): {"config_id": y - 1992, "split": s, "seed": 1, "day": f"{y}-01-01", "attacks": ["DoS", "PortScan"], "target_ip": "10.0.0.1", "attacker_ip": "10.0.0.2", "target_host": "srv.lab", "timeout": 5, "dos_seconds": 9} for y, s in RUNS}
    m = campaign.load_manifest(json.dumps({"campaign_id": "c", "expected_labels": ["BENIGN", "DoS", "PortScan"], "runs": runs, "required_policy_profile": "strict"}), reproducible=True)
    return campaign.manifest_runs(spark, m).select("run_id", "config_id", "split", "day", F.array_join("attacks", ",").alias("attacks"))


PLANNED = {"run_id": "i % 31 = 0", "campaign_id": "i % 7 = 0", "campaign_sha256": "i % 11 = 0", "config_id": "i % 31 <> 0 AND i % 13 = 0", "split": "i % 31 <> 0 AND i % 17 = 0", "target_ip": "i % 31 <> 0 AND i % 19 = 0", "protocol": "i % 31 <> 0 AND i % 23 = 0",
           "tool": "i % 31 <> 0 AND i % 29 = 0", "command_argv": "i % 31 <> 0 AND (i % 37 = 0 OR i % 41 = 0)", "command": "i % 31 <> 0 AND i % 37 <> 0 AND i % 41 <> 0 AND i % 43 = 0", "command_argv value": "i % 31 <> 0 AND i % 37 <> 0 AND (i % 41 = 0 OR i % 47 = 0)", "parameters": "i % 31 <> 0 AND i % 53 = 0"}


@query("c10_campaign_gaps", "WITH e AS (SELECT event_id AS i FROM events) " + " UNION ALL ".join(f"SELECT i::VARCHAR AS event_id, '{f}' AS field FROM e WHERE {x}" for f, x in PLANNED.items()))
def campaign_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of one run against its plan, with errors put in by event."""
    i = F.col("event_id")
    by = lambda n, bad, good: F.when(i % n == 0, F.lit(bad)).otherwise(good if not isinstance(good, str) else F.lit(good))
    argv = F.when(i % 41 == 0, F.array(F.lit("nc"), F.lit("-L"), F.lit("/w l"), F.lit("srv"))).otherwise(F.array(F.lit("/usr/bin/tool"), F.lit("-L"), F.lit("/w l"), by(47, "evil", "srv")))
    a = table(spark, sf_dir, "events").select(
        i.cast("string").alias("event_id"), by(31, "9", "1").alias("run_id"), F.lit("DoS").alias("label"), by(7, "d", "c").alias("campaign_id"), by(11, "00", "ab").alias("campaign_sha256"), by(13, "5", "0").alias("config_id"), by(17, "test", "train").alias("split"),
        by(19, "10.0.0.9", "10.0.0.1").alias("target_ip"), F.lit("srv.lab").alias("target_hostname"), F.lit("10.0.0.2").alias("attacker_ip"), by(23, "tcp", "UDP").alias("protocol"), by(29, "other", "Tool").alias("tool"), F.lit("443").alias("target_port"),
        F.when(i % 37 == 0, "").otherwise(F.to_json(argv)).alias("command_argv"), F.when((i % 37 == 0) | (i % 41 == 0), "").otherwise(by(43, "echo", F.concat(F.lit("/usr/bin/tool -L '/w l' "), by(47, "evil", "srv")))).alias("command"), by(53, "rate=2", "rate=1; dur=3").alias("parameters"),
    )
    runs = spark.createDataFrame([(1, 0, "train", "10.0.0.1", "srv.lab", "10.0.0.2")], "run_id int, config_id int, split string, target_ip string, target_host string, attacker_ip string")
    plan = spark.createDataFrame([(1, "DoS", "udp", "tool", "443", ["tool", "-L", None, "srv"], {"rate": "1", "dur": "3"})], "run_id int, label string, protocol string, tool string, target_port string, argv array<string>, parameters map<string,string>")
    # The planned tool is written with its folder in the arguments; only its name is compared there.
    found = campaign.annotation_campaign_gaps(a, runs, plan.withColumn("argv", F.array(F.lit("/usr/bin/tool"), F.lit("-L"), F.lit(None).cast("string"), F.lit("srv"))), "c", "ab")
    return found


@query("c8_meter_domains", " UNION ALL ".join(f"SELECT '{n}' AS rule, 'error' AS severity, count(*) FILTER ({x}) AS violations FROM lineitem" for n, x in {"fwd_pkts_tot: inf": "false", "fwd_pkts_tot: negative": "l_linenumber = 1", "fwd_pkts_tot: fractional": "l_linenumber <> 1 AND l_extendedprice <> floor(l_extendedprice)", "fwd_iat_avg: inf": "l_linenumber = 2", "fwd_iat_avg: negative": "false"}.items()))
def meter_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber")
    d = table(spark, sf_dir, "lineitem").select(F.when(i == 1, -3.0).otherwise(F.col("l_extendedprice")).alias("fwd_pkts_tot"), F.when(i == 2, float("inf")).otherwise(F.col("l_tax")).alias("fwd_iat_avg"))
    return contracts.evaluate(d, contracts.meter_rules(d.columns))


@query("c18_benign_sessions", "SELECT 'FAIL' AS state, 'line: no object (' || count(*) FILTER (o_orderkey % 97 = 0) || ')' AS first_problem FROM orders")
def benign_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = parse.seconds("o_orderdate")
    cells = F.struct(F.lit("c").alias("campaign_id"), F.lit(1).alias("run_id"), F.lit(2).alias("seed"), F.lit("a").alias("attempt_id"), F.col("o_orderkey").alias("session_id"), F.lit("b").alias("browser"), F.lit("s").alias("site"), t.alias("start"), (t + 5).alias("end"), F.lit(True).alias("ok"), F.lit(3).alias("pages"))
    raw = o.select(F.when(F.col("o_orderkey") % 97 == 0, "[broken").otherwise(F.to_json(cells)).alias("value"))
    found = evidence.benign(evidence.sessions(raw), {"require_benign_jsonl": True}, {"campaign_id": "c", "run_id": 1, "seed": 2, "attempt_id": "a"})
    return spark.createDataFrame([(found.state, found.problems[0] if found.problems else "")], "state string, first_problem string")


@query("w5_ranks", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return splits.ranks(d, ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("w10_medians", "SELECT l_returnflag, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "mid")
