"""The registered queries: every operator applied to the driver's tables, with SQL that DuckDB can run.

The tables hold no sensor logs, so each query sets up the same situation from what there is: flows
are events with a duration of ``value`` seconds, windows the two hours after an error event of the
same user, ports the key ``k`` of the properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions import parse
from netloom.operators import contracts, duplicates, effects, intervals, joins, shortcuts, splits, statistics
from netloom.sources import logs, tables
from netloom.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_path(spark, name)


# --- events as flows and windows -------------------------------------------------------------------

EVENTS = "WITH ev AS (SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::INT AS k, epoch_us(ts) / 1e6 AS t FROM events)"
FLOWS = EVENTS + """, w AS (
  SELECT event_id, 'error' || (event_id % 3) AS w_label, user_id, CASE WHEN event_id % 2 = 0 THEN k ELSE 0 END AS port_lo,
         CASE WHEN event_id % 2 = 0 THEN k ELSE 99 END AS port_hi, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 100 END AS span, t AS s, t + 7200 AS e
  FROM ev WHERE event_type = 'error'
), f AS (SELECT event_id AS flow_id, user_id, k, t, value AS d FROM ev WHERE event_type <> 'error')
"""
IN_TIME = {None: "f.t BETWEEN w.s AND w.e", 0.5: "CASE WHEN coalesce(f.d, 0) > 0 THEN least(f.t + f.d, w.e) - greatest(f.t, w.s) > 0 AND (least(f.t + f.d, w.e) - greatest(f.t, w.s)) / f.d >= 0.5 ELSE f.t BETWEEN w.s AND w.e END"}
PAIRS = FLOWS + ", c AS (SELECT f.flow_id, f.k, f.t, f.d, w.*, f.k BETWEEN w.port_lo AND w.port_hi AS m FROM f JOIN w ON f.user_id = w.user_id AND {time})"
RESOLVED = PAIRS + """, n AS (
  SELECT flow_id, min(span) FILTER (m) AS narrow, count(*) FILTER (m) AS n_matches, count(DISTINCT w_label) FILTER (m) AS n_labels FROM c GROUP BY flow_id
), b AS (
  SELECT n.flow_id, arg_min(w_label, event_id) FILTER (m AND span = narrow) AS w_label, min(event_id) FILTER (m AND span = narrow) AS best,
         count(DISTINCT w_label) FILTER (m AND span = narrow) AS kinds, any_value(n_matches) AS n_matches, any_value(n_labels) AS n_labels
  FROM c JOIN n USING (flow_id) GROUP BY n.flow_id
), r AS (
  SELECT f.flow_id, coalesce(b.w_label, 'BENIGN') AS label, coalesce(b.best::VARCHAR, '') AS matched_event_id,
         CASE WHEN b.flow_id IS NOT NULL AND (b.best IS NULL OR b.kinds > 1) THEN 1 ELSE 0 END AS ambiguous, coalesce(b.n_matches, 0)::BIGINT AS n_matches, coalesce(b.n_labels, 0) AS n_labels
  FROM f LEFT JOIN b USING (flow_id)
)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"), parse.seconds("ts").alias("t"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type <> 'error'")
    return e.select(F.col("event_id").alias("flow_id"), F.col("user_id").cast("string").alias("src"), F.lit("srv").alias("dst"), F.lit("TCP").alias("proto"), F.col("k").alias("port"), F.col("t").alias("ts"), F.col("value").alias("duration"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type = 'error'")
    narrow = F.col("event_id") % 2 == 0
    return e.select(
        "event_id", F.concat(F.lit("error"), F.col("event_id") % 3).alias("w_label"), F.col("user_id").cast("string").alias("attacker"), F.lit("srv").alias("target"), F.lit("tcp").alias("w_proto"),
        F.when(narrow, F.col("k")).otherwise(0).alias("port_lo"), F.when(narrow, F.col("k")).otherwise(99).alias("port_hi"), F.when(narrow, 1).otherwise(100).alias("span"),
        F.col("t").alias("start"), (F.col("t") + 7200).alias("end"), F.col("event_id").alias("ord"),
    )


def _classify(min_overlap: float | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = intervals.classify(flows(spark, sf_dir), windows(spark, sf_dir), min_overlap)
        return d.select("flow_id", "label", "matched_event_id", "ambiguous", "n_matches")

    return run


for _name, _share in (("j2_classify_legacy", None), ("j2_classify_overlap", 0.5)):
    query(_name, RESOLVED.replace("{time}", IN_TIME[_share]) + "SELECT flow_id, label, matched_event_id, ambiguous, n_matches FROM r")(_classify(_share))


@query("j3_matching_windows", PAIRS.replace("{time}", IN_TIME[0.5]) + "SELECT flow_id, event_id FROM c WHERE m")
def matching_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.candidates(flows(spark, sf_dir), windows(spark, sf_dir), 0.5).filter("is_match").select("flow_id", "event_id")


@query("j4_overlapping_windows", FLOWS + "SELECT a.event_id AS first_event, b.event_id AS second_event FROM w a JOIN w b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e AND a.port_lo <= b.port_hi AND b.port_lo <= a.port_hi")
def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping_windows(windows(spark, sf_dir))


@query("a1_event_evidence", RESOLVED.replace("{time}", IN_TIME[0.5]) + """
SELECT w.event_id, count(c.flow_id) AS matched_flows, count(c.flow_id) FILTER (r.ambiguous = 0 AND r.matched_event_id = w.event_id::VARCHAR) AS usable_flows,
       count(c.flow_id) FILTER (r.n_labels > 1) AS ambiguous_flows, count(DISTINCT c.k) AS unique_dst_ports,
       min(CASE WHEN coalesce(c.d, 0) > 0 THEN greatest(c.t, c.s) ELSE least(greatest(c.t, c.s), c.e) END) AS first_match,
       max(CASE WHEN coalesce(c.d, 0) > 0 THEN least(c.t + c.d, c.e) ELSE least(greatest(c.t, c.s), c.e) END) AS last_match,
       round(count(DISTINCT c.k)::DOUBLE / w.span, 4) AS port_coverage
FROM w LEFT JOIN (SELECT * FROM c WHERE m) c ON c.event_id = w.event_id LEFT JOIN r ON r.flow_id = c.flow_id GROUP BY w.event_id, w.span""")
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = intervals.event_evidence(flows(spark, sf_dir), windows(spark, sf_dir), 0.5)
    return d.select("event_id", "matched_flows", "usable_flows", "ambiguous_flows", "unique_dst_ports", "first_match", "last_match", "port_coverage")


@query("a2_overlap_accounting", PAIRS.replace("{time}", IN_TIME[0.5]) + "SELECT count(*) AS matched_flows, count(*) FILTER (coalesce(d, 0) <= 0) AS duration_fallback_flows FROM (SELECT DISTINCT flow_id, d FROM c WHERE m)")
def overlap_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_accounting(flows(spark, sf_dir), windows(spark, sf_dir), 0.5)


@query("j13_off_window", FLOWS + "SELECT flow_id FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.w_label = 'error' || (f.flow_id % 3) AND f.t BETWEEN w.s AND w.e)")
def off_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir).withColumn("label", F.concat(F.lit("error"), F.col("flow_id") % 3))
    return intervals.off_window(rows, windows(spark, sf_dir)).select("flow_id")


@query("j14_point_in_window", EVENTS + """
SELECT e.event_type, count(*) AS total, count(*) FILTER (n > 0) AS in_window FROM (
  SELECT event_id, event_type, (SELECT count(*) FROM ev w WHERE w.event_type = 'error' AND ev.t BETWEEN w.t AND w.t + 1800) AS n FROM ev WHERE event_type <> 'error') e
GROUP BY e.event_type""")
def point_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    w = e.filter("event_type = 'error'").select(F.col("t").alias("start"), (F.col("t") + 1800).alias("end"))
    d = intervals.in_any_window(e.filter("event_type <> 'error'").withColumnRenamed("t", "ts"), w)
    return d.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if("inside").alias("in_window"))


FLAGSHIP = EVENTS + """
SELECT e.event_type, count(*) AS total, count(*) FILTER (n > 0) AS in_window, sum(n)::BIGINT AS hits FROM (
  SELECT event_type, (SELECT count(*) FROM ev w WHERE w.event_type = 'error' AND w.user_id = ev.user_id AND ev.t BETWEEN w.t AND w.t + 1800) AS n FROM ev WHERE event_type <> 'error') e
GROUP BY e.event_type"""


@query("flagship_label_events", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events labelled by whether they fall in the half hour after an error of the same user."""
    f = flows(spark, sf_dir)
    w = windows(spark, sf_dir).withColumn("end", F.col("start") + 1800)
    hits = intervals.window_join(f, w, intervals.ENDPOINTS, None).groupBy("flow_id").agg(F.count("*").alias("n"))
    kinds = events(spark, sf_dir).filter("event_type <> 'error'").select(F.col("event_id").alias("flow_id"), "event_type")
    d = kinds.join(hits, "flow_id", "left").fillna({"n": 0})
    return d.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("in_window"), F.sum("n").alias("hits"))


# --- key joins and evidence ------------------------------------------------------------------------


@query("j1_attach_last", "SELECT a.conv_id, a.turn, b.role AS last_role, b.turn AS last_turn FROM conversations a LEFT JOIN (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id) b USING (conv_id)")
def attach_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    build = c.select("conv_id", "role", "turn", F.col("turn").alias("line_no"))
    return joins.attach(c.select("conv_id", "turn"), build, "conv_id", "line_no", "last_").select("conv_id", "turn", "last_role", "last_turn")


@query("j6_join_accounting", "SELECT count(*) AS records, count(*) FILTER (hit) AS matching, count(*) FILTER (NOT hit) AS orphan, 0::BIGINT AS missing_key, round(count(*) FILTER (hit)::DOUBLE / count(*), 4) AS join_rate FROM (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS hit FROM orders)")
def join_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.join_accounting(table(spark, sf_dir, "orders"), known, "o_orderkey")


@query("j7_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("j8_row_identity", "SELECT count(*) AS rows, count(*) FILTER (event_id % 13 = 0) AS missing, count(*) FILTER (event_id % 13 <> 0 AND (event_id % 10 = 0 OR value IS NULL)) AS mismatched FROM events")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    source = e.filter("event_id % 13 <> 0").select("event_id", F.upper("event_type").alias("event_type"), F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return joins.row_identity(e, source, "event_id", ["event_type"], {"value": 1e-3})


@query("j9_manifest_diff", """
SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'mismatched' END AS status FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0
UNION ALL SELECT s_suppkey + 100000000, 'extra' FROM supplier""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.sha2("p_name", 256).alias("sha256"))
    changed = p.filter("path % 7 <> 0").select("path", F.when(F.col("path") % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    extra = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100000000).alias("path"), F.sha2("s_name", 256).alias("sha256"))
    return joins.manifest_diff(p, changed.unionByName(extra))


@query("j11_bijection", "SELECT coalesce(a.k, b.k) AS doc_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT doc_id AS k, count(*) AS n_left FROM documents GROUP BY 1) a FULL JOIN (SELECT doc_id AS k, count(*) AS n_right FROM labels GROUP BY 1) b USING (k) WHERE coalesce(n_left, 0) <> 1 OR coalesce(n_right, 0) <> 1")
def bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bijection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("j12_same_projection", "SELECT count(*) AS only_a, count(*) AS only_b FROM customer WHERE c_custkey % 17 = 0")
def same_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    other = c.withColumn("c_name", F.when(F.col("c_custkey") % 17 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return joins.same_projection(c, other, ["c_custkey", "c_name", "c_mktsegment"])


@query("j17_unknown_values", "SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey")
    known = table(spark, sf_dir, "part").filter("p_size > 10")
    return joins.unknown_values(li, "l_partkey", known, "p_partkey", ignore=(-1,))


REQUESTS = EVENTS + """, r AS (SELECT t, user_id, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type || '/' || k AS uri FROM ev WHERE event_type <> 'error'),
v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'BruteForce' ELSE 'DoS' END AS label, user_id, t AS s, t + 86400 AS e, CASE WHEN event_id % 2 = 0 THEN 'purchase' ELSE '/view' END AS path FROM ev WHERE event_type = 'error'),
q AS (
  SELECT v.event_id, count(r.t) FILTER (r.user_id = v.user_id) AS requests_attacker, count(r.t) FILTER (r.user_id <> v.user_id) AS requests_other
  FROM v LEFT JOIN r ON r.t BETWEEN v.s AND v.e AND CASE WHEN label = 'BruteForce' THEN method = 'POST' AND contains(uri, path) ELSE method = 'GET' AND starts_with(uri, path) END GROUP BY v.event_id)
"""


def _requests(spark: SparkSession, sf_dir: str, others: bool = True) -> DataFrame:
    e = events(spark, sf_dir)
    r = e.filter("event_type <> 'error'").select(F.col("t").alias("ts"), F.col("user_id").cast("string").alias("client"), F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"), F.concat(F.lit("/"), "event_type", F.lit("/"), "k").alias("uri"), F.lit(None).cast("string").alias("host"))
    even = F.col("event_id") % 2 == 0
    v = e.filter("event_type = 'error'").select("event_id", F.when(even, "BruteForce").otherwise("DoS").alias("label"), F.col("user_id").cast("string").alias("attacker"), F.lit("srv").alias("target"), F.col("t").alias("start"), (F.col("t") + 86400).alias("end"), F.when(even, "purchase").otherwise("/view").alias("path"))
    return effects.attributed_requests(v, r, others=others)


@query("j15_attributed_requests", REQUESTS + "SELECT * FROM q")
def attributed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir)


@query("a14_evidence_levels", REQUESTS + "SELECT event_id, 'tool_executed' || CASE WHEN event_id % 4 > 0 THEN ',traffic_observed' ELSE '' END || CASE WHEN requests_attacker > 0 THEN ',application_observed' ELSE '' END AS evidence FROM q")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _requests(spark, sf_dir, others=False).withColumn("usable_flows", F.col("event_id") % 4)
    return effects.evidence_levels(d).select("event_id", F.array_join("evidence", ",").alias("evidence"))


@query("a18_session_gates", """
WITH s AS (SELECT o_orderkey // 2 AS id, o_orderstatus <> 'F' AS ok, epoch_us(o_orderdate) / 1e6 AS t FROM orders)
SELECT count(*) AS sessions, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT (t >= 820454400 AND t + 3600 <= 978307200)) AS not_inside, count(*) FILTER (t < 978307200 AND t + 3600 > 820454400) AS overlapping,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM s GROUP BY id) WHERE n > 1) AS repeated, count(*) FILTER (ok)::DOUBLE / count(*) AS success_rate, false AS passed FROM s""")
def session_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parse.seconds("o_orderdate")
    s = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("session_id"), (F.col("o_orderstatus") != "F").alias("ok"), t.alias("start"), (t + 3600).alias("end"))
    return effects.session_gates(s, 820454400.0, 978307200.0, 50, 0.9)


@query("j20_mirrored", """
WITH f AS (SELECT l_suppkey = 1 AS forth, l_suppkey = 2 AS back, l_linestatus = 'O' AS tcp, l_linenumber AS port, l_tax > 0.07 AS answered FROM lineitem),
s AS (SELECT coalesce(bool_or(forth), false) AS client_to_victim, coalesce(bool_or(forth AND answered), false) AS victim_responded, coalesce(bool_or(back), false) AS victim_to_client,
             coalesce(bool_or(forth AND answered AND tcp AND port = 3), false) AS tcp_answered, coalesce(bool_or(forth AND answered AND NOT tcp AND port = 9), false) AS udp_answered FROM f)
SELECT *, array_to_string(list_filter([CASE WHEN NOT client_to_victim THEN 'no flow from client to victim' WHEN NOT victim_responded THEN 'no response was mirrored' END,
  CASE WHEN NOT tcp_answered THEN 'no answered tcp flow on port 3' END, CASE WHEN NOT udp_answered THEN 'no answered udp flow on port 9' END], lambda x: x IS NOT NULL), ',') AS problems,
  client_to_victim AND victim_responded AND tcp_answered AND udp_answered AS confirmed FROM s""")
def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") == 2, "v").otherwise(F.col("l_suppkey").cast("string")).alias("src"), F.when(F.col("l_suppkey") == 2, "1").otherwise("v").alias("dst"),
        F.when(F.col("l_linestatus") == "O", "TCP").otherwise("UDP").alias("proto"), F.col("l_linenumber").alias("port"), F.when(F.col("l_tax") > 0.07, 3).otherwise(0).alias("resp_pkts"),
    )
    return joins.mirrored(d, "1", "v", 3, 9).withColumn("problems", F.array_join("problems", ","))


# --- duplicates and leakage ------------------------------------------------------------------------

DUPES = "WITH g AS (SELECT text, count(*) AS n, count(DISTINCT source) AS runs, count(DISTINCT doc_id % 10) AS splits, count(DISTINCT lang) AS labels FROM documents GROUP BY text HAVING count(*) > 1)"


def _split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", F.col("doc_id") % 10)


@query("a4_duplicate_statistics", DUPES + "SELECT count(*) AS exact_duplicate_groups, count(*) FILTER (runs > 1) AS cross_run_duplicate_groups, count(*) FILTER (splits > 1) AS cross_split_duplicate_groups, coalesce(sum(n) FILTER (splits > 1), 0)::BIGINT AS cross_split_duplicate_rows, count(*) FILTER (labels > 1) AS conflicting_label_groups, coalesce(sum(n) FILTER (splits > 1), 0)::DOUBLE / (SELECT count(*) FROM documents) AS cross_split_duplicate_rate_raw FROM g")
def duplicate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.statistics(_split_docs(spark, sf_dir), ["text"], "source", "split", "lang")


@query("w1_cross_split_rows", "SELECT doc_id, (SELECT count(DISTINCT b.doc_id % 10) FROM documents b WHERE b.text IS NOT DISTINCT FROM documents.text) AS n_splits FROM documents")
def cross_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.mark_cross_split(_split_docs(spark, sf_dir), ["text"], "split").select("doc_id", "n_splits")


@query("j18_row_overlap", "WITH a AS (SELECT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT text FROM documents WHERE doc_id % 2 = 1) SELECT count(*) AS n_rows, count(*) FILTER (hit) AS n_shared, count(*) FILTER (hit)::DOUBLE / count(*) AS share FROM (SELECT text IN (SELECT text FROM a) AS hit FROM b)")
def row_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return duplicates.row_overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["text"])


@query("k11_same_content", "SELECT n FROM (SELECT count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.same_content(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"))).select("n")


@query("w4_repeated_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("w3_overlaps_predecessor", EVENTS + "SELECT event_id FROM (SELECT event_id, t, lag(t + value * 60) OVER (PARTITION BY user_id ORDER BY t, t + value * 60) AS p FROM ev WHERE value IS NOT NULL) WHERE t < p - 1e-6")
def overlaps_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("value is not null").withColumn("end", F.col("t") + F.col("value") * 60)
    return joins.overlaps_predecessor(e, ["user_id"], "t", "end").select("event_id")


# --- splits ----------------------------------------------------------------------------------------

PLAN = {1995: "train", 1996: "train", 1997: "train", 1998: "train", 1999: "train", 2000: "val", 2001: "test"}
SPLIT = "WITH o AS (SELECT *, year(o_orderdate)::INT AS run_id, epoch_us(o_orderdate) / 1e6 AS t, CASE WHEN year(o_orderdate) <= 1999 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'val' WHEN year(o_orderdate) = 2001 THEN 'test' END AS split FROM orders)"


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"run_id": F.year("o_orderdate"), "t": parse.seconds("o_orderdate")})
    return splits.by_plan(o, PLAN)


@query("m1_campaign_split", SPLIT + "SELECT split, count(*) AS n FROM o GROUP BY split")
def campaign_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("m2_hold_out_runs", SPLIT + "SELECT o_orderkey, CASE WHEN run_id = (SELECT max(run_id) FROM o) THEN 'test' WHEN run_id = 1999 THEN 'val' ELSE 'train' END AS split FROM o")
def hold_out_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hold_out_runs(_planned(spark, sf_dir).drop("split"), val=1999).select("o_orderkey", "split")


@query("w5_time_split", SPLIT + "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY t, o_orderkey) <= floor(0.7 * (SELECT count(*) FROM o)) THEN 'train' ELSE 'test' END AS split FROM o")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_time(_planned(spark, sf_dir).drop("split"), "t", "o_orderkey", 0.3).select("o_orderkey", "split")


@query("a16_chronology", SPLIT + """, p AS (SELECT 'three' AS plan, split, t FROM o UNION ALL SELECT 'two', CASE WHEN split = 'val' THEN 'test' ELSE split END, t FROM o UNION ALL SELECT 'mixed', CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END, t FROM o),
b AS (SELECT plan, max(t) FILTER (split = 'train') AS train_max, min(t) FILTER (split = 'val') AS val_min, max(t) FILTER (split = 'val') AS val_max, min(t) FILTER (split = 'test') AS test_min, count(*) FILTER (split = 'val') AS n FROM p GROUP BY plan)
SELECT plan, train_max, val_min, val_max, test_min, CASE WHEN n = 0 THEN train_max < test_min ELSE train_max < val_min AND val_max < test_min END AS ordered FROM b""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = _planned(spark, sf_dir)
    two = three.withColumn("split", F.when(F.col("split") == "val", "test").otherwise(F.col("split")))
    mixed = three.withColumn("split", F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("test"))
    found = [splits.chronology(d, "t").select(F.lit(name).alias("plan"), "*") for name, d in (("three", three), ("two", two), ("mixed", mixed))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("k4_split_manifest", SPLIT + "SELECT split, run_id, count(*) AS rows, floor(min(t))::BIGINT AS ts_min, floor(max(t))::BIGINT AS ts_max FROM o GROUP BY split, run_id")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.manifest(_planned(spark, sf_dir), "t")


@query("u2_missing_labels", SPLIT + "SELECT s AS split, x AS label FROM (VALUES ('train'), ('val'), ('test'), ('extra')) a(s), (VALUES ('O'), ('F'), ('Z')) b(x) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.split = s AND o_orderstatus = x)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.missing_labels(_planned(spark, sf_dir), ["O", "F", "Z"], ["train", "val", "test", "extra"], "o_orderstatus")


@query("u3_unexpected_labels", "SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unexpected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.unexpected_labels(table(spark, sf_dir, "orders"), ["1-URGENT", "2-HIGH"], "o_orderpriority")


@query("u4_run_coverage", "SELECT v AS value, 'missing' AS side FROM (VALUES (0), (1), (99), (99)) a(v) WHERE v NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT r_regionkey::INT, 'extra' FROM region WHERE r_regionkey NOT IN (0, 1)")
def run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.coverage(spark, [0, 1, 99, 99], table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r")), "r")


@query("u1_union_runs", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return splits.union_runs([n.filter("n_regionkey < 2"), n.filter("n_regionkey >= 2").select(*reversed(n.columns))]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


# --- aggregates and statistics ---------------------------------------------------------------------


@query("a3_class_counts", "SELECT o_orderstatus AS label, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.prevalence(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "label"), "label")


@query("a8_support", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def class_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.support(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])


@query("a5_missing_rates", "SELECT * FROM (SELECT 'value' AS feature, count(*) FILTER (value IS NULL) AS missing, count(*) AS rows, count(*) FILTER (value IS NULL)::DOUBLE / count(*) AS rate FROM events UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*), count(*) FILTER (event_type IS NULL)::DOUBLE / count(*) FROM events)")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.missing_rates(table(spark, sf_dir, "events"), ["value", "event_type"])


@query("a5_missing_rate_gap", "SELECT 'b' AS feature, 0.0::DOUBLE + abs((SELECT count(*) FILTER (event_id % 4 = 0)::DOUBLE / count(*) FROM events WHERE event_id < 500) - (SELECT count(*) FILTER (event_id % 3 = 0)::DOUBLE / count(*) FROM events WHERE event_id >= 500)) AS gap")
def missing_rate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("a"))
    x = e.filter("event_id < 500").withColumn("b", F.when(F.col("event_id") % 4 != 0, 1))
    y = e.filter("event_id >= 500").withColumn("b", F.when(F.col("event_id") % 3 != 0, 1))
    return statistics.missing_rate_gap(x, y, ["a", "b"])


@query("a12_nearest_rank", "SELECT event_type, list_sort(list(value))[least(count(value) - 1, round_even(0.95 * (count(value) - 1), 0))::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, "p95")


PROBES = EVENTS + """, p AS (SELECT t, 'u' || (user_id % 5) AS url, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS ok, value AS latency_ms, CASE WHEN event_type = 'view' THEN 'down' ELSE '' END AS error, CASE WHEN k > 50 THEN 500 + k ELSE 0 END AS http_code, event_id FROM ev WHERE event_type <> 'error'),
z AS (SELECT *, EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'error' AND p.t BETWEEN w.t AND w.t + 60) AS inside FROM p)
"""
RANK = "list_sort(list({0}){1})[least(count({0}){1} - 1, round_even({2} * (count({0}){1} - 1), 0))::INT + 1]"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = F.col("event_type") == "view"
    e = events(spark, sf_dir).filter("event_type <> 'error'")
    return e.select(F.col("t").alias("ts"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("url"), F.when(down, 0).otherwise(1).alias("ok"), F.col("value").alias("latency_ms"), F.when(down, "down").otherwise("").alias("error"), F.when(F.col("k") > 50, 500 + F.col("k")).otherwise(0).alias("http_code"))


@query("a13_monitor_summary", PROBES + "SELECT url, count(*) AS probes, avg(ok) AS availability, count(*) FILTER (error <> '') AS errors, max(nullif(http_code, 0)) AS worst_code, " + RANK.format("latency_ms", "", "0.5") + " AS p50_ms, " + RANK.format("latency_ms", "", "0.95") + " AS p95_ms FROM p GROUP BY url")
def monitor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.monitor_summary(probes(spark, sf_dir))


@query("a11_effects", PROBES + """, a AS (
  SELECT url, count(*) FILTER (inside) AS probes_attack, count(*) FILTER (NOT inside) AS probes_baseline, avg(ok) FILTER (inside) AS av_a, avg(ok) FILTER (NOT inside) AS av_b,
         count(*) FILTER (inside AND error <> '')::DOUBLE / nullif(count(*) FILTER (inside), 0) AS er_a, count(*) FILTER (NOT inside AND error <> '')::DOUBLE / nullif(count(*) FILTER (NOT inside), 0) AS er_b,
         """ + RANK.format("latency_ms", " FILTER (inside)", "0.95") + " AS l_a, " + RANK.format("latency_ms", " FILTER (NOT inside)", "0.95") + """ AS l_b FROM z GROUP BY url)
SELECT url, probes_attack, probes_baseline, av_a AS availability_attack, av_b AS availability_baseline, l_a AS p95_attack, l_b AS p95_baseline, er_a AS error_rate_attack, er_b AS error_rate_baseline,
       coalesce(av_b - av_a >= 0.2, false) OR coalesce(l_a > 0 AND l_b > 0 AND l_a / l_b >= 2, false) OR coalesce(er_a - er_b >= 0.2, false) AS effect_confirmed FROM a""")
def effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).filter("event_type = 'error'").select(F.col("t").alias("start"), (F.col("t") + 60).alias("end"))
    return effects.effects(probes(spark, sf_dir), w).select("url", "probes_attack", "probes_baseline", "availability_attack", "availability_baseline", "p95_attack", "p95_baseline", "error_rate_attack", "error_rate_baseline", "effect_confirmed")


@query("a17_seed_summary", "SELECT p_brand, count(*) AS seeds, round(avg(p_size), 9) AS p_size_mean, round(stddev_pop(p_size), 9) AS p_size_std, min(p_size) AS p_size_min, max(p_size) AS p_size_max FROM part GROUP BY p_brand")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.seed_summary(table(spark, sf_dir, "part"), ["p_brand"], ["p_size"]).withColumns({c: F.round(c, 9) for c in ("p_size_mean", "p_size_std")})


@query("a19_reconcile", "SELECT o_orderpriority, count(*) AS observed, count(*) + 1 AS claimed FROM orders WHERE o_orderpriority < '3' GROUP BY 1 UNION ALL SELECT 'none', 0, 5")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    claim = n.withColumn("n", F.col("n") + F.when(F.col("o_orderpriority") < "3", 1).otherwise(0)).unionByName(spark.createDataFrame([("none", 5)], "o_orderpriority string, n long"))
    return contracts.reconcile(n, claim, "o_orderpriority")


@query("a20_drop_rate", "SELECT sum(l_tax > 0.05)::BIGINT AS dropped, count(*) AS received, sum(l_tax > 0.05)::DOUBLE / count(*) AS drop_rate FROM lineitem")
def drop_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_tax") > 0.05).alias("dropped"), F.count("*").alias("received"))
    text = F.concat("received", F.lit(" packets captured\n"), "received", F.lit(" packets received by filter\n"), "dropped", F.lit(" packets dropped by kernel"))
    return d.select(*[c.alias(n) for n, c in logs.parse_drop_statistics(text).items() if n != "captured"])


AB = "WITH p AS (SELECT l_returnflag AS side, l_extendedprice AS v, l_quantity AS q, l_linestatus AS s FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


@query("w9_ks", AB + """, c AS (SELECT v, count(*) FILTER (side = 'A') AS x, count(*) FILTER (side = 'R') AS y FROM p GROUP BY v),
d AS (SELECT abs(sum(x) OVER w::DOUBLE / sum(x) OVER () - sum(y) OVER w::DOUBLE / sum(y) OVER ()) AS g, sum(x) OVER () AS n, sum(y) OVER () AS m FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT max(g) AS ks, max(n)::BIGINT AS n_a, max(m)::BIGINT AS n_b, max(g) * sqrt(max(n)::DOUBLE * max(m) / (max(n) + max(m))) AS z FROM d)
SELECT round(ks, 9) AS ks, n_a, n_b, round(CASE WHEN z < 0.2 THEN 1 ELSE least(1, greatest(0, (SELECT sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * i * i * z * z)) FROM range(1, 101) r(i)))) END, 9)::DOUBLE AS p_value FROM k""")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')").withColumn("one", F.lit(1))
    return statistics.ks(d, ["one"], "l_extendedprice", "l_returnflag", "A", "R").select(F.round("ks", 9).alias("ks"), "n_a", "n_b", F.round("p_value", 9).alias("p_value"))


LABELLED = "WITH d AS (SELECT n_chars AS v, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    return d.withColumn("one", F.lit(1))


@query("w10_auc", LABELLED + ", r AS (SELECT quality, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM d) SELECT round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1)), 9) AS auc FROM r")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.auc(_labelled(spark, sf_dir), ["one"], "n_chars", F.col("quality") == 1).select(F.round("auc", 9).alias("auc"))


@query("w11_average_precision", LABELLED + ", c AS (SELECT v, count(*) FILTER (quality = 1) AS p, count(*) AS c FROM d GROUP BY v), s AS (SELECT p, sum(p) OVER w AS tp, sum(c) OVER w AS n FROM c WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(p::DOUBLE * tp / n) / sum(p), 9) AS average_precision FROM s")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.average_precision(_labelled(spark, sf_dir), ["one"], "n_chars", F.col("quality") == 1).select(F.round("average_precision", 9).alias("average_precision"))


JS = "round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 9) AS js"


@query("m3_js_numeric", AB + ", m AS (SELECT min(v) AS lo, max(v) AS hi FROM p), c AS (SELECT least(floor((v - lo) / (hi - lo) * 60), 59) AS b, count(*) FILTER (side = 'A') AS x, count(*) FILTER (side = 'R') AS y FROM p, m GROUP BY 1), s AS (SELECT x::DOUBLE / sum(x) OVER () AS p, y::DOUBLE / sum(y) OVER () AS q FROM c) SELECT " + JS + " FROM s")
def js_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return statistics.js_numeric(d, ["one"], "l_extendedprice", "l_returnflag", "A", "R").select(F.round("js", 9).alias("js"))


@query("m4_js_categorical", AB + ", c AS (SELECT q AS b, count(*) FILTER (side = 'A') AS x, count(*) FILTER (side = 'R') AS y FROM p GROUP BY 1), s AS (SELECT x::DOUBLE / sum(x) OVER () AS p, y::DOUBLE / sum(y) OVER () AS q FROM c) SELECT " + JS + " FROM s")
def js_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return statistics.js_categorical(d, ["one"], "l_quantity", "l_returnflag", "A", "R").select(F.round("js", 9).alias("js"))


@query("m6_conditional_js", AB + ", m AS (SELECT s, min(v) AS lo, max(v) AS hi FROM p GROUP BY s), c AS (SELECT p.s, least(floor((v - lo) / (hi - lo) * 60), 59) AS b, count(*) FILTER (side = 'A') AS x, count(*) FILTER (side = 'R') AS y FROM p JOIN m USING (s) GROUP BY 1, 2), t AS (SELECT s, x::DOUBLE / nullif(sum(x) OVER (PARTITION BY s), 0) AS p, y::DOUBLE / nullif(sum(y) OVER (PARTITION BY s), 0) AS q FROM c) SELECT s AS l_linestatus, " + JS + " FROM t GROUP BY s")
def conditional_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return statistics.js_numeric(d, ["l_linestatus"], "l_extendedprice", "l_returnflag", "A", "R").select("l_linestatus", F.round("js", 9).alias("js"))


METRICS = {
    "accuracy": "(tp + tn)::DOUBLE / (tp + fp + fn + tn)", "precision": "tp::DOUBLE / (tp + fp)", "recall": "tp::DOUBLE / (tp + fn)", "f1": "2.0 * tp / (2 * tp + fp + fn)", "specificity": "tn::DOUBLE / (tn + fp)",
    "balanced_accuracy": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2", "mcc": "(tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))", "prevalence": "(tp + fn)::DOUBLE / (tp + fp + fn + tn)",
    "false_positive_rate": "fp::DOUBLE / (fp + tn)", "false_negative_rate": "fn::DOUBLE / (fn + tp)",
}


@query("m21_binary_metrics", LABELLED + ", c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT quality = 1 AS y, v > 1500 AS p FROM d)) SELECT tp, fp, fn, tn, " + ", ".join(f"round({x}, 9) AS {n}" for n, x in METRICS.items()) + " FROM c")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).select(F.when(F.col("quality") == 1, "y").otherwise("n").alias("truth"), F.when(F.col("n_chars") > 1500, "y").otherwise("n").alias("guess"))
    m = statistics.binary_metrics(d, "truth", "guess", "y")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in METRICS])


# --- shortcuts -------------------------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_discount", "l_tax"]


@query("a9_categorical_shortcut", """
WITH c AS (SELECT l_linestatus AS v, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY n DESC, y) AS r, count(*) OVER (PARTITION BY v) AS kinds FROM c),
s AS (SELECT y, coalesce(sum(n) FILTER (r = 1), 0)::DOUBLE / sum(n) AS recall FROM k GROUP BY y)
SELECT 'l_linestatus' AS feature, round((SELECT avg(recall) FROM s), 9) AS balanced_accuracy, count(DISTINCT v) AS n_values, coalesce(sum(n) FILTER (kinds = 1), 0)::DOUBLE / sum(n) AS pure_share FROM k""")
def categorical_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shortcuts.categorical(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag")
    return d.select("feature", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "n_values", "pure_share")


@query("a10_constants", "SELECT 'one' AS feature, 1::BIGINT AS distinct_values")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortcuts.constants(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1)), ["one", "l_tax", "l_linestatus"])


EDGES = "WITH s AS (SELECT '{0}' AS feature, {0} AS v, row_number() OVER (ORDER BY {0}) - 1 AS i, count(*) OVER () // 32 AS step FROM lineitem WHERE {0} IS NOT NULL), e AS (SELECT DISTINCT feature, v FROM s WHERE i > 0 AND i % step = 0), k AS (SELECT *, row_number() OVER (ORDER BY v) AS r FROM e) SELECT feature, v AS edge FROM k WHERE r <= 31"


@query("w6_quantile_edges", "(" + ") UNION ALL (".join(EDGES.format(c) for c in NUMBERS) + ")")
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortcuts.quantile_edges(table(spark, sf_dir, "lineitem"), NUMBERS).select("feature", F.explode("edges").alias("edge"))


SPLITS_SQL = """
WITH l AS (UNPIVOT (SELECT l_returnflag AS y, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME f VALUE v),
s AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY f) // 32 AS step FROM l), e AS (SELECT DISTINCT f, v FROM s WHERE i > 0 AND i % step = 0),
k AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS r FROM e), g AS (SELECT f, v FROM k WHERE r <= 31),
u AS (SELECT f, y, v, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT u.f, y, (SELECT count(*) FROM g WHERE g.f = u.f AND g.v < u.v) AS bin, n FROM u),
c AS (SELECT f, bin, y, sum(n) AS n FROM b GROUP BY ALL), t AS (SELECT f, y, sum(n) AS total FROM c GROUP BY ALL),
h AS (SELECT x.f, x.bin, t.y, t.total, coalesce((SELECT sum(n) FROM c WHERE c.f = x.f AND c.y = t.y AND c.bin <= x.bin), 0) AS low FROM (SELECT DISTINCT f, bin FROM c) x JOIN t USING (f)),
p AS (SELECT *, total - low AS high FROM h),
q AS (SELECT f, bin, arg_min(y, (-low, y)) AS gl, arg_min(y, (-high, y)) AS gh, sum(high) AS rest FROM p GROUP BY ALL),
z AS (SELECT p.f, p.bin, avg((CASE WHEN y = gl THEN low ELSE 0 END + CASE WHEN y = gh THEN high ELSE 0 END)::DOUBLE / total) AS s FROM p JOIN q USING (f, bin) WHERE gl <> gh AND rest > 0 GROUP BY ALL)
SELECT f AS feature, round(max(s), 6) AS balanced_accuracy FROM z GROUP BY f"""


@query("m15_numeric_shortcut", SPLITS_SQL)
def numeric_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortcuts.numeric(table(spark, sf_dir, "lineitem"), NUMBERS, "l_returnflag").select("feature", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query("m11_numeric_auc", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(greatest(a, 1 - a), 9) AS auc FROM (SELECT (sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0)::DOUBLE / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS a FROM (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k FROM lineitem))" for c in NUMBERS))
def numeric_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortcuts.numeric_auc(table(spark, sf_dir, "lineitem"), NUMBERS, F.col("l_returnflag") == "R").select("feature", F.round("auc", 9).alias("auc"))


@query("m12_categorical_lift", """
WITH a AS (SELECT l_linestatus AS v, l_returnflag AS y FROM lineitem WHERE l_orderkey % 3 > 0), b AS (SELECT l_linestatus AS v, l_returnflag AS y FROM lineitem WHERE l_orderkey % 3 = 0),
top AS (SELECT y FROM a GROUP BY y ORDER BY count(*) DESC, y LIMIT 1), r AS (SELECT v, y AS g FROM (SELECT v, y, row_number() OVER (PARTITION BY v ORDER BY count(*) DESC, y) AS k FROM a GROUP BY v, y) WHERE k = 1),
j AS (SELECT b.y, coalesce(r.g, (SELECT y FROM top)) AS g FROM b LEFT JOIN r USING (v))
SELECT round(avg((y = g)::INT), 9) AS accuracy, round(avg((y = (SELECT y FROM top))::INT), 9) AS majority_accuracy FROM j""")
def categorical_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    out = shortcuts.categorical_lift(d.filter("l_orderkey % 3 > 0"), d.filter("l_orderkey % 3 = 0"), "l_linestatus", "l_returnflag")
    return out.select(F.round("accuracy", 9).alias("accuracy"), F.round("majority_accuracy", 9).alias("majority_accuracy"))


@query("m14_balanced_accuracy", "SELECT round(avg(r), 9) AS balanced_accuracy FROM (SELECT avg((CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END = l_returnflag)::INT) AS r FROM lineitem GROUP BY l_returnflag)")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "N").otherwise("A").alias("guess"))
    return statistics.balanced_accuracy(d, "l_returnflag", "guess").select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


@query("m16_gini_tree")
def gini_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shortcuts.tree(table(spark, sf_dir, "lineitem"), [*NUMBERS, "l_linestatus"], "l_returnflag", depth=2)
    rows = [(n["id"], n["label"], sum(n["counts"].values()), n["split"][0] if "split" in n else None) for n in nodes]
    return spark.createDataFrame(rows, "node int, label string, rows long, split string")


# --- contracts -------------------------------------------------------------------------------------

CONN = "WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS duration, l_partkey AS fp, l_suppkey AS bp, l_extendedprice AS fb, l_tax AS bb, l_linestatus FROM lineitem)"


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as connection rows of a log: all cells text."""
    d = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    port = ((F.col("l_partkey") * 37) % 65535 + 1).cast("string")
    return d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("uid"), parse.seconds("l_shipdate").cast("string").alias("ts"), s("l_suppkey").alias("id.orig_h"), F.lit("40000").alias("id.orig_p"), F.lit("srv").alias("id.resp_h"), port.alias("id.resp_p"),
        F.when(F.col("l_linestatus") == "O", "tcp").otherwise("udp").alias("proto"), F.when(F.col("l_linenumber") < 6, s("l_quantity")).otherwise("-").alias("duration"),
        F.floor("l_extendedprice").cast("string").alias("orig_bytes"), s("l_partkey").alias("resp_bytes"), F.when(F.col("l_linenumber") % 2 == 0, F.floor(F.col("l_extendedprice") + 40).cast("string")).otherwise("-").alias("orig_ip_bytes"), F.lit(None).cast("string").alias("resp_ip_bytes"),
        s("l_linenumber").alias("orig_pkts"), F.floor("l_quantity").cast("string").alias("resp_pkts"), F.monotonically_increasing_id().alias("line_no"),
    )


FEATURES = """WITH c AS (
  SELECT l_orderkey || '-' || l_linenumber AS uid, CASE WHEN l_linenumber < 6 THEN l_quantity END AS d, l_linenumber::DOUBLE AS fp, floor(l_quantity)::DOUBLE AS bp,
         CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice + 40) ELSE floor(l_extendedprice) END::DOUBLE AS fb, l_partkey::DOUBLE AS bb, (l_partkey * 37) % 65535 + 1 AS port, l_linestatus, l_linenumber AS i FROM lineitem)
"""
#: A double rounded as its shortest decimal text is.
ROUNDED = "round({0}::VARCHAR::DECIMAL(30, 12), {1})::DOUBLE"


@query("p1_common_features", FEATURES + f"""
SELECT uid, d AS flow_duration, fp AS tot_fwd_pkts, bp AS tot_bwd_pkts, fb AS totlen_fwd_bytes, bb AS totlen_bwd_bytes, {ROUNDED.format("(bp / greatest(fp, 1.0))", 4)} AS down_up_ratio,
  {ROUNDED.format("(CASE WHEN d > 0 THEN (fb + bb) / d END)", 2)} AS flow_bytes_s, {ROUNDED.format("(CASE WHEN d > 0 THEN (fp + bp) / d END)", 2)} AS flow_pkts_s,
  (i IN (1, 2, 5))::INT AS sni_present, CASE WHEN l_linestatus = 'O' THEN 'TCP' ELSE 'UDP' END AS transport, CASE WHEN port < 1024 THEN 'well_known' WHEN port < 49152 THEN 'registered' ELSE 'ephemeral' END AS dst_port_class,
  CASE WHEN i = 1 THEN '1.2' WHEN i = 3 THEN 'SSLv3' WHEN i IN (2, 4, 5) THEN '1.3' ELSE 'none' END AS tls_version, CASE WHEN i = 1 THEN 'h2' WHEN i IN (4, 5) THEN 'h3' ELSE 'none' END AS alpn,
  CASE WHEN i = 1 THEN 'abc' ELSE 'none' END AS ja3, 'none' AS ja3s FROM c""")
def common_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with TLS rows on lines 1 to 3 and QUIC rows on lines 4 and 5 (and 2, where TLS has no version)."""
    i = F.col("orig_pkts").cast("int")
    at = lambda *pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])[i]
    c = connections(spark, sf_dir).withColumns({
        "ssl_version": at((1, "TLSv12"), (2, ""), (3, "SSLv3")), "ssl_server_name": at((1, "a.lab"), (3, "")), "ssl_next_protocol": at((1, "h2"), (3, "")), "ssl_ja3": at((1, "abc"), (2, "")), "ssl_ja3s": F.lit(None).cast("string"),
        "quic_server_name": at((2, "q.lab"), (4, ""), (5, "q.lab")), "quic_client_protocol": at((2, ""), (4, "h3"), (5, "h3")),
    })
    f = ft.common_features(c, i.isin(2, 4, 5))
    return c.select("uid", *[f[n].alias(n) for n in ft.COMMON])


RELATIONS = {
    "flow_bytes_s: finite without duration": "d = 0 AND bs IS NOT NULL", "flow_pkts_s: finite without duration": "d = 0 AND ps IS NOT NULL",
    "down_up_ratio: inconsistent": "abs(r - bp / greatest(fp, 1)) > 0.02 + 0.02 * abs(bp / greatest(fp, 1))",
    "flow_bytes_s: inconsistent": "d > 0 AND abs(bs - (fb + bb) / d) > 0.02 + 0.02 * abs((fb + bb) / d)", "flow_pkts_s: inconsistent": "d > 0 AND abs(ps - (fp + bp) / d) > 0.02 + 0.02 * abs((fp + bp) / d)",
}


@query("c5_contract", FEATURES + """, r AS (SELECT fp, bp, fb, bb, coalesce(d, 0) AS d, CASE WHEN d > 0 THEN (fp + bp) / d WHEN port % 7 = 0 THEN 1 END + CASE WHEN port % 10 = 0 THEN 9 ELSE 0 END AS ps,
  CASE WHEN d > 0 THEN (fb + bb) / d WHEN port % 5 = 0 THEN 2 END * CASE WHEN port % 9 = 0 THEN 2 ELSE 1 END AS bs, bp / greatest(fp, 1) + CASE WHEN port % 8 = 0 THEN 50 ELSE 0 END AS r FROM c)
""" + " UNION ALL ".join(f"SELECT '{n}' AS rule, 'error' AS severity, count(*) FILTER ({x}) AS violations FROM r" for n, x in RELATIONS.items()))
def relational_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as derived, with errors put in by port."""
    c = connections(spark, sf_dir)
    f = ft.common_features(c)
    port = parse.whole(ft.quoted("id.resp_p"))
    idle = f["flow_duration"].isNull()
    f["flow_pkts_s"] = F.when(idle & (port % 7 == 0), 1.0).otherwise(f["flow_pkts_s"]) + F.when(port % 10 == 0, 9).otherwise(0)
    f["flow_bytes_s"] = F.when(idle & (port % 5 == 0), 2.0).otherwise(f["flow_bytes_s"]) * F.when(port % 9 == 0, 2).otherwise(1)
    f["down_up_ratio"] = f["down_up_ratio"] + F.when(port % 8 == 0, 50).otherwise(0)
    f["flow_duration"] = F.coalesce(f["flow_duration"], F.lit(0.0))
    return contracts.evaluate(c.select(*[x.alias(n) for n, x in f.items()]), contracts.relational_rules())


BROKEN = {
    "duration: not a number": "k % 11 = 0", "duration: negative": "k % 11 <> 0 AND k % 13 = 0", "duration: inf": "k % 11 <> 0 AND k % 13 <> 0 AND k % 17 = 0", "orig_pkts: fractional": "k % 7 = 0", "resp_pkts: negative": "k % 5 = 0", "orig_bytes: not a number": "k % 37 = 0",
    "resp_bytes: inf": "k % 41 = 0", "id.resp_p: not a port": "k % 19 = 0", "id.orig_p: not a port": "k % 43 = 0", "id.resp_p: blank": "k % 19 <> 0 AND k % 23 = 0", "uid: blank": "k % 29 = 0", "id.orig_h: blank": "k % 47 = 0", "proto: blank": "k % 53 = 0", "ts: not finite": "k % 31 = 0",
}
CONN_RULES = [
    *[f"{c}: not a number" for c in contracts.CONN_NUMBERS], *[f"{c}: {x}" for c in contracts.CONN_NUMBERS for x in ("inf", "negative")], *[f"{c}: fractional" for c in contracts.CONN_COUNTS],
    "id.orig_p: not a port", "id.resp_p: not a port", *[f"{c}: blank" for c in contracts.CONN_ESSENTIALS], "ts: not finite",
]


@query("c1_raw_contract", "WITH r AS (SELECT l_orderkey AS k FROM lineitem) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, 'error' AS severity, count(*) FILTER ({BROKEN.get(n, 'false')}) AS violations FROM r" for n in CONN_RULES))
def raw_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over connection rows with errors put in by order key."""
    c = connections(spark, sf_dir).withColumn("__k", F.split_part("uid", F.lit("-"), F.lit(1)).cast("long"))
    when = lambda *pairs: lambda old: F.when(F.col("__k") % pairs[0][0] == 0, pairs[0][1]).otherwise(old) if len(pairs) == 1 else F.when(F.col("__k") % pairs[0][0] == 0, pairs[0][1]).otherwise(when(*pairs[1:])(old))
    bad = {"duration": when((11, "x1"), (13, "-2"), (17, "inf")), "orig_pkts": when((7, "2.5")), "resp_pkts": when((5, "-4")), "orig_bytes": when((37, "7O")), "resp_bytes": when((41, "Infinity")), "id.resp_p": when((19, "70000"), (23, "-")), "id.orig_p": when((43, "0")), "uid": when((29, " ")), "id.orig_h": when((47, "")), "proto": when((53, "-")), "ts": when((31, "nan"))}
    d = c.select(*[(bad[n](ft.quoted(n)) if n in bad else ft.quoted(n)).alias(n) for n in c.columns if n != "__k"])
    return contracts.evaluate(d, contracts.conn_rules(d.columns))


@query("c7_unknown_labels", "SELECT DISTINCT event_type AS label FROM events WHERE event_type NOT IN ('view', 'click')")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.unknown_labels(table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query("c15_temporal_coherence", "SELECT count(*) AS rows, 0::BIGINT AS unreadable, count(*) FILTER (epoch_us(o_orderdate) / 1e6 NOT BETWEEN 820454400 - 5 AND 978307200 + 5) AS outside FROM orders")
def temporal_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.temporal_coherence(table(spark, sf_dir, "orders").select(parse.seconds("o_orderdate").alias("t")), "t", 820454400.0, 978307200.0)


# --- sources: written to the shared folder and read back ------------------------------------------


@query("s1_zeek_scan", EVENTS + "SELECT event_id::VARCHAR AS uid, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS service, CASE WHEN k % 5 = 0 THEN NULL ELSE k::VARCHAR END AS port FROM ev")
def zeek_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    row = F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")), F.when(F.col("k") % 5 == 0, "(empty)").otherwise(F.col("k").cast("string")))
    path = shared(spark, "zeek")
    head = spark.createDataFrame([("#separator \\x09",), ("#fields\tuid\tservice\tport",)], "value string")
    head.coalesce(1).write.text(path)
    e.select(row.alias("value")).write.mode("append").text(path)
    return logs.read_zeek(spark, path).select("uid", "service", "port")


@query("s5_split_ready_csv", "SELECT l_orderkey::INT AS run_id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS flow_duration, '1.' || (l_linenumber % 4) AS tls_version, l_returnflag AS label FROM lineitem")
def split_ready_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("flow_duration"), F.concat(F.lit("1."), F.col("l_linenumber") % 4).alias("tls_version"), F.col("l_returnflag").alias("label"))
    path = shared(spark, "csv")
    d.write.option("header", "true").csv(path)
    return tables.read_split_ready(spark, path)


@query("s12_access_log", EVENTS + "SELECT t AS ts, k AS status, 'GET' AS method, '/' || event_type AS uri, '10.0.0.' || (user_id % 200) AS client FROM ev WHERE event_id % 9 <> 0")
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    request = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("uri"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200, F.lit(":443")).alias("remote_ip"))
    raw = e.select(F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("t").alias("ts"), F.col("k").alias("status"), request.alias("request")))).alias("value"))
    return logs.read_access_log(raw).select("ts", "status", "method", "uri", "client")


@query("s18_manifest_text", "SELECT sha256(p_name) AS sha256, 'd/' || p_partkey AS path FROM part")
def manifest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.upper(F.sha2("p_name", 256)), F.lit("  *d\\"), "p_partkey").alias("value"))
    return tables.parse_manifest(p.unionByName(spark.createDataFrame([("# comment",), ("",)], "value string")))


@query("p21_epoch_parse", "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS t FROM orders")
def epoch_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse.epoch(text).alias("t"))


@query("s210_key_values", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a=1;a=2;brand="), "p_brand")).otherwise(F.concat(F.lit("size = 3; brand ="), "p_brand", F.lit(";")))
    return table(spark, sf_dir, "part").select("p_partkey", parse.key_values(text)["brand"].alias("brand"))


@query("p15_binary_label", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE 'ATTACK' END AS label FROM events")
def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ft.binary_label(F.concat(F.lit(" "), F.upper("event_type")), "view").alias("label"))


@query("f1_port_matches", EVENTS + "SELECT event_id, k BETWEEN 10 AND 40 AS inside, k = 7 AS exact FROM ev")
def port_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", parse.port_matches("k", F.lit("10-40")).alias("inside"), parse.port_matches("k", F.lit("7")).alias("exact"))


@query("f7_fallback_rows", "SELECT n AS attack_rows, k AS fallback_rows, k::DOUBLE / n AS fallback_rate FROM (SELECT count(*) FILTER (event_type <> 'view') AS n, count(*) FILTER (event_type <> 'view' AND coalesce(value, 0) <= 0) AS k FROM events)")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fallback_rows(table(spark, sf_dir, "events"), "event_type", "value", "view")


@query("o2_top_shortcuts", "SELECT * FROM (SELECT l_suppkey, count(*)::DOUBLE AS score, count(*) >= 600 AS flagged FROM lineitem GROUP BY 1 ORDER BY score DESC, l_suppkey DESC LIMIT 6)")
def top_shortcuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("score"))
    return shortcuts.top(d, "score", "l_suppkey", 6, 600)


# --- more sources, scalar tests and derivations ----------------------------------------------------


def _event_log(spark: SparkSession, sf_dir: str) -> str:
    """Events as a headed TSV log in the shared folder, with a comment at its end."""
    path = shared(spark, "log")
    spark.createDataFrame([("#separator \\x09",), ("#fields\tuid\tk",)], "value string").coalesce(1).write.text(path)
    e = events(spark, sf_dir).select(F.concat_ws("\t", F.col("event_id").cast("string"), F.col("k").cast("string")).alias("value"))
    e.unionByName(spark.createDataFrame([("#close",), ("  ",)], "value string")).write.mode("append").text(path)
    return path


@query("s2_log_profile", "SELECT true AS present, count(*) AS records, count(*) = 0 AS empty, 'uid,k' AS fields, 'service' AS missing_fields FROM events")
def log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = logs.profile(spark, _event_log(spark, sf_dir), ("uid", "service"))
    return d.select("present", "records", "empty", F.array_join("fields", ",").alias("fields"), F.array_join("missing_fields", ",").alias("missing_fields"))


@query("s4_tolerant_scan", EVENTS + "SELECT (1.5 + event_id)::DOUBLE AS ts, 'u' || event_id AS uid, CASE WHEN k % 2 = 0 THEN k END AS port FROM ev WHERE event_id % 5 <> 0")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = {"ts": F.col("event_id") + 1.5, "uid": F.concat(F.lit("u"), "event_id"), "id.resp_p": F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("junk")}
    row = F.concat_ws("\t", *[cell.get(c, F.lit("-")).cast("string") for c in logs.DEFAULT_CONN])
    path = shared(spark, "bare")
    events(spark, sf_dir).select(F.when(F.col("event_id") % 5 == 0, "cut\toff").otherwise(row).alias("value")).write.text(path)
    d = logs.read_zeek(spark, path, strict=False)
    return d.select(parse.number("ts").alias("ts"), "uid", parse.whole(ft.quoted("id.resp_p")).alias("port"))


@query("s6_load_runs", "SELECT l_linenumber::INT AS run_id, l_returnflag AS label, count(*) AS n, round(sum(l_tax), 6) AS seconds FROM lineitem GROUP BY ALL")
def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line number is a run with a file of its own."""
    folder = shared(spark, "runs")
    d = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_tax").alias("flow_duration"), F.col("l_returnflag").alias("label"))
    runs = [r[0] for r in d.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    for run in runs:
        d.filter(F.col("l_linenumber") == run).drop("l_linenumber").write.option("header", "true").csv(f"{folder}/run_{run}")
    found = tables.load_runs(spark, [f"{folder}/run_{r}" for r in runs])
    return found.groupBy("run_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("flow_duration"), 6).alias("seconds"))


ANNOTATED = {
    "event_id: blank": "i % 29 = 0", "run_id: not whole": "i % 31 = 0", "label: unknown": "i % 37 = 0", "attacker_ip: invalid": "i % 7 = 0", "target_ip: invalid": "false", "endpoints: equal": "i % 7 <> 0 AND i % 41 = 0", "protocol: unknown": "i % 43 = 0",
    "protocol: not of the attack": "i % 37 <> 0 AND i % 43 <> 0 AND i % 5 = 0", "tool: blank": "i % 47 = 0", "tool: not of the attack": "i % 37 <> 0 AND i % 47 <> 0 AND i % 3 = 0", "command: blank": "i % 53 = 0", "target_port: invalid": "i % 4 = 0",
    "start_utc: unreadable": "i % 9 = 0", "end_utc: unreadable": "i % 59 = 0", "interval: empty": "i % 9 <> 0 AND i % 59 <> 0 AND i % 6 = 0", "status: unknown": "i % 61 = 0",
    "return_code: not whole": "i % 67 = 0", "return_code: not 0 on success": "i % 61 <> 0 AND i % 67 <> 0 AND i % 2 = 0 AND i % 11 = 0", "error_type: on success": "i % 61 <> 0 AND i % 2 = 0 AND i % 13 = 0",
    "status: failed without a reason": "i % 61 <> 0 AND i % 67 <> 0 AND i % 2 = 1 AND i % 11 <> 0 AND i % 13 <> 0",
}


@query("s9_annotation_rules", "WITH e AS (SELECT event_id AS i FROM events) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, 'error' AS severity, count(*) FILTER ({x}) AS violations FROM e" for n, x in ANNOTATED.items()))
def annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation row for each event, with errors put in by its id."""
    i = F.col("event_id")
    at = lambda shift: F.concat(F.date_format(F.col("ts") + F.expr(f"INTERVAL {shift} SECONDS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    by = lambda n, bad, good: F.when(i % n == 0, F.lit(bad) if isinstance(bad, str) else bad).otherwise(F.lit(good) if isinstance(good, str) else good)
    a = table(spark, sf_dir, "events").select(
        by(29, " ", i.cast("string")).alias("event_id"), by(31, "-1", "1").alias("run_id"), by(37, "Worm", "DoS").alias("label"), by(7, "10.0.0.300", by(41, "10.0.0.1", "10.0.0.30")).alias("attacker_ip"), F.lit("10.0.0.1").alias("target_ip"),
        by(43, "icmp", by(5, "TCP", "udp")).alias("protocol"), by(47, "", by(3, "/usr/bin/nmap", "/usr/bin/Python3")).alias("tool"), by(53, " ", "python3 x.py").alias("command"), by(4, "9-3", "443").alias("target_port"),
        by(9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), at(0)).alias("start_utc"), by(59, "soon", by(6, at(-5), at(5))).alias("end_utc"), by(61, "maybe", by(2, "success", "failed")).alias("status"),
        by(67, "x", by(11, "3", "0")).alias("return_code"), by(13, "timeout", "").alias("error_type"),
    )
    return contracts.evaluate(a, tables.annotation_rules())


@query("s13_sessions", "SELECT o_orderkey::VARCHAR AS session_id, o_orderkey % 3 > 0 AS ok, o_totalprice AS start FROM orders")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("session_id"), (F.col("o_orderkey") % 3 > 0).alias("ok"), F.col("o_totalprice").alias("start"))
    return logs.read_sessions(o.select(F.to_json(F.struct("session_id", "ok", "start")).alias("value"))).select("session_id", "ok", "start")


@query("s14_effect_windows", "SELECT epoch_us(date_trunc('second', ts)) / 1e6 AS start, epoch_us(date_trunc('second', ts)) / 1e6 + 60 AS \"end\" FROM events WHERE event_type = 'error' AND event_id % 2 = 0")
def effect_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("event_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    a = table(spark, sf_dir, "events").select(F.when(i % 2 == 0, "success").otherwise("failed").alias("status"), F.col("event_type").alias("label"), text(F.col("ts")).alias("start_utc"), F.concat(text(F.col("ts") + F.expr("INTERVAL 60 SECONDS")), F.lit("Z")).alias("end_utc"))
    return logs.effect_windows(a, ["error"])


@query("s19_inventory", "SELECT r_regionkey::INT AS region, strlen(r_name) + 1 AS size, sha256(r_name || chr(10)) AS sha256 FROM region")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared(spark, "files")
    table(spark, sf_dir, "region").repartitionByRange(5, "r_regionkey").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").csv(path)
    return tables.inventory(spark, path, "*.csv").select(F.regexp_extract("path", r"r_regionkey=(\d+)/", 1).cast("int").alias("region"), "size", "sha256")


@query("f8_blank_label", "SELECT event_id, event_id % 4 < 3 AS blank FROM events")
def blank_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("nan"), F.lit("DoS"))
    return table(spark, sf_dir, "events").select("event_id", parse.blank(F.get(cells, (F.col("event_id") % 4).cast("int"))).alias("blank"))


@query("f9_finite", "SELECT event_id, event_id % 4 = 3 AS finite FROM events")
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit("-"), F.lit("inf"), F.lit("x1"), F.lit(" 2.5 "))
    return table(spark, sf_dir, "events").select("event_id", parse.finite(F.get(cells, (F.col("event_id") % 4).cast("int"))).alias("finite"))


@query("f11_safe_names", "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS safe, c_custkey % 2 = 0 AS host FROM customer")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h"), "c_custkey", F.lit(".lab"))).otherwise(F.concat(F.lit("-h"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", parse.safe_id("c_name").alias("safe"), parse.hostname(host).alias("host"))


@query("f6_run_membership", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1996, 1998)")
def run_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame([(1996,), (1998,)], "run_id int")
    return joins.members(table(spark, sf_dir, "orders").withColumn("run_id", F.year("o_orderdate")), runs).select("o_orderkey")


@query("p4_port_class", "SELECT l_orderkey, l_linenumber, CASE WHEN p < 1024 THEN 'well_known' WHEN p < 49152 THEN 'registered' ELSE 'ephemeral' END AS port_class FROM (SELECT *, (l_partkey * 37) % 65535 + 1 AS p FROM lineitem)")
def port_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = ((F.col("l_partkey") * 37) % 65535 + 1).cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ft.port_class(port).alias("port_class"))


@query("p5_tls_version", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1.3' WHEN 1 THEN '1.2' WHEN 4 THEN 'SSLv3' ELSE 'none' END AS tls FROM events")
def tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit("TLSv13"), F.lit("TLSv1.2"), F.lit(None).cast("string"), F.lit("-"), F.lit("SSLv3"))
    return table(spark, sf_dir, "events").select("event_id", ft.tls_version(F.get(cells, (F.col("event_id") % 5).cast("int"))).alias("tls"))


@query("p7_meter_features", EVENTS + "SELECT event_id::VARCHAR AS uid, k::DOUBLE AS fwd_pkts_tot, value AS fwd_iat_avg, CASE WHEN event_type = 'view' THEN k::DOUBLE END AS flow_SYN_flag_count FROM ev")
def meter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("uid"), F.when(F.col("event_type") == "view", "TCP").otherwise("UDP").alias("transport"), F.col("k").cast("string").alias("k"), F.col("value").cast("string").alias("value"))
    meter = c.select("uid", F.col("k").alias("fwd_pkts_tot"), F.col("value").alias("fwd_iat.avg"), F.col("k").alias("flow_SYN_flag_count"), F.lit(0).alias("line_no"))
    d = joins.attach(c.select("uid", "transport"), meter, "uid", "line_no", "fm_")
    f = ft.meter_features(d.columns, F.col("transport"))
    return d.select("uid", *[f[n].alias(n) for n in ("fwd_pkts_tot", "fwd_iat_avg", "flow_SYN_flag_count")])


@query("p19_row_keys", "SELECT count(*) AS rows, count(DISTINCT (l_quantity, l_tax, l_returnflag)) AS vectors FROM lineitem")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    return d.select(ft.row_key(d, ["l_quantity", "l_tax"], ["l_returnflag"]).alias("k")).agg(F.count("*").alias("rows"), F.count_distinct("k").alias("vectors"))


@query("p3_select_common", "SELECT l_tax AS flow_duration, NULL::VARCHAR AS ja3, l_returnflag AS label FROM lineitem")
def select_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_tax").alias("flow_duration"), F.col("l_returnflag").alias("label"))
    return ft.select_common(d, ["label"]).select("flow_duration", "ja3", "label")


DOMAIN_RULES = {
    "flow_duration: inf": "false", "flow_duration: negative": "l_linenumber = 1", "tot_fwd_pkts: inf": "l_linenumber = 2", "tot_fwd_pkts: negative": "false", "tot_fwd_pkts: fractional": "l_linenumber <> 2 AND l_extendedprice <> floor(l_extendedprice)",
    "sni_present: inf": "false", "sni_present: negative": "false", "sni_present: not 0 or 1": "l_linenumber > 1", "transport: out of domain": "l_linestatus = 'F'", "tls_version: out of domain": "l_linenumber = 4",
}


@query("c4_value_domains", " UNION ALL ".join(f"SELECT '{n}' AS rule, 'error' AS severity, count(*) FILTER ({x}) AS violations FROM lineitem" for n, x in DOMAIN_RULES.items()) + " UNION ALL SELECT 'alpn: out of domain', 'warning', count(*) FROM lineitem")
def value_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber")
    d = table(spark, sf_dir, "lineitem").select(
        F.when(i == 1, -1.0).otherwise(1.0).alias("flow_duration"), F.when(i == 2, float("inf")).otherwise(F.col("l_extendedprice")).alias("tot_fwd_pkts"), i.alias("sni_present"),
        F.when(F.col("l_linestatus") == "F", "ICMP").otherwise("TCP").alias("transport"), F.when(i == 4, "1.4").otherwise("1.3").alias("tls_version"), F.lit("spdy").alias("alpn"),
    )
    return contracts.evaluate(d, contracts.common_rules(d.columns))


@query("c6_junk_cells", "SELECT 'x: not a number' AS rule, 'error' AS severity, count(*) FILTER (event_id % 3 = 0) AS violations FROM events")
def junk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, "BAD").when(F.col("event_id") % 3 == 1, "").otherwise("1.5").alias("x"))
    return contracts.evaluate(d, contracts.junk_rules(["x"]))


@query("c20_coverage_gates", RESOLVED.replace("{time}", IN_TIME[0.5]) + "SELECT w.event_id FROM w WHERE (SELECT count(*) FROM r WHERE r.ambiguous = 0 AND r.matched_event_id = w.event_id::VARCHAR) < 1")
def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.plans.labeling import coverage_gates as gate

    return gate(intervals.event_evidence(flows(spark, sf_dir), windows(spark, sf_dir), 0.5)).select("event_id")


@query("a4_label_conflicts", "SELECT list_sort(list(DISTINCT source)) AS label_set FROM documents GROUP BY text HAVING count(DISTINCT source) > 1 ORDER BY label_set LIMIT 5")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.conflicts(table(spark, sf_dir, "documents"), ["text"], "source")


@query("m23_generated_flows")
def generated_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators import generator

    rows = table(spark, sf_dir, "events").count()
    return generator.summary(generator.generate(spark, rows, {"BENIGN": 0.75, "PortScan": 0.1, "BruteForce": 0.05, "DoS": 0.1}))


@query("m13_forest_baseline")
def forest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators import models

    d = table(spark, sf_dir, "lineitem").select(*NUMBERS, "l_linestatus", F.col("l_returnflag").alias("label"), "l_orderkey")
    model = models.forest(d.filter("l_orderkey % 5 > 0"), NUMBERS, ["l_linestatus"])
    return models.by_class(model, d.filter("l_orderkey % 5 = 0"), NUMBERS, ["l_linestatus"])


from netloom.plans import queries_audit  # noqa: E402, F401  registers its queries
