"""Requests are counted for events without pairing them, with the results of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import effects, splits
from netloom.plans.queries import QUERIES

EVENT = "event_id string, label string, attacker string, target string, start double, end double, path string"
REQUEST = "ts double, client string, method string, uri string, host string"


def plain(events, requests):
    out = {}
    for i, label, attacker, target, start, end, path in events:
        a, o = out.get(i, (0, 0))
        for ts, client, method, uri, host in requests:
            host, wants = (host or "").split(":")[0] or None, (target or "").strip(" ") or None
            fits = None not in (path, ts, start, end, method) and {"BruteForce": "POST", "DoS": "GET"}.get(label) == method.upper() and start <= ts <= end
            fits = fits and (path in (uri or "") if label == "BruteForce" else (uri or "").startswith(path)) and (host is None or wants is None or host == wants)
            a, o = a + (fits and client == attacker), o + (fits and client != attacker)
        out[i] = (a, o)
    return out


def rows_of_joins(df):
    """The most rows that a join of the executed plan of ``df`` made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_counts_are_those_of_all_pairs(spark):
    r = random.Random(5)
    clients, hosts, times = ["a", "b", "c", None], ["x", "x:80", "y", "", None], [0.0, 10.0, 10.5, 3599.0, 3600.0, 7200.0, 9000.0, None]
    requests = [(r.choice(times), r.choice(clients), r.choice(["post", "POST", "GET", "get", "PUT", None]), r.choice(["/in/login", "/login", "/", "", None]), r.choice(hosts)) for _ in range(600)]
    events = [(f"e{i % 150}", r.choice(["BruteForce", "DoS", "DoS", "PortScan", None]), r.choice(clients), r.choice(["x", " y ", "", None]), r.choice(times), r.choice(times), r.choice(["/login", "/", "in", "", None])) for i in range(160)]
    events += [("none", "DoS", "a", None, 20000.0, 30000.0, "/"), ("turned", "DoS", "a", None, 9000.0, 0.0, "/"), ("all", "DoS", "b", None, 0.0, 9000.0, "")]
    got = effects.attributed_requests(spark.createDataFrame(events, EVENT), spark.createDataFrame(requests, REQUEST)).collect()
    assert {x.event_id: (x.requests_attacker, x.requests_other) for x in got} == plain(events, requests)
    assert len(got) == len(events) and sum(x.requests_other for x in got) > 0 and sum(x.requests_attacker for x in got) > 0


def test_events_and_requests_of_one_minute_are_not_paired(spark):
    n = 2000
    i = F.col("id").cast("double")
    e = spark.range(n).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("DoS").alias("label"), F.lit("a").alias("attacker"), F.lit("srv").alias("target"), F.lit(0.0).alias("start"), (i / n * 60).alias("end"), F.lit("/").alias("path"))
    r = spark.range(n).select((i / n * 60).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("client"), F.lit("GET").alias("method"), F.lit("/x").alias("uri"), F.lit("srv").alias("host"))
    found = effects.attributed_requests(e, r)
    assert rows_of_joins(found) <= 6 * n  # each event has a start and an end, among all requests and among those of its client
    assert found.agg(F.sum("requests_attacker"), F.sum("requests_other")).first() == (sum(k // 2 + 1 for k in range(n)), sum((k + 1) // 2 for k in range(n)))


@pytest.mark.parametrize("name", ["a14_evidence_levels", "m25_ground_truth"])
def test_layered_queries_pair_no_requests(spark, name, tmp_path):
    n = 2000
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 60)
    d = spark.range(2 * n).select(F.col("id").alias("event_id"), t.alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") < n, "error").when(F.col("id") % 2 == 0, "view").otherwise("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    d.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert rows_of_joins(found) <= 8 * n
    assert found.filter(F.col("evidence").contains("application_observed")).count() > 0


@pytest.mark.parametrize("name, sides", [("a14_evidence_levels", 2), ("m25_ground_truth", 4)])
def test_layered_queries_write_no_requests_in_order(spark, name, sides, tmp_path, monkeypatch):
    n, written, plain_stored = 500, {}, splits.stored

    def counted(df, what):
        out = plain_stored(df, what)
        written[what] = out.count()
        return out

    monkeypatch.setattr(splits, "stored", counted)
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    d = spark.range(2 * n).select(F.col("id").alias("event_id"), t.alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") < n, "error").when(F.col("id") % 2 == 0, "view").otherwise("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"))
    d.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).filter(F.col("evidence").contains("application_observed")).count() == n
    # The two sides of each event, among its own client's requests and (m25) among all, and a sum for each range.
    assert sides * n < written["ranges"] <= sides * n + 4


def test_running_sums_of_ranges(spark):
    d = spark.range(3000, numPartitions=7).select((F.col("id") * 7919 % 3000).alias("at"), F.lit(2).cast("long").alias("n"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("k"), "id")).alias("key"))
    got = splits.running_ranges(d, ["at"], "n", "key", ["at"]).collect()
    assert len(got) == 1000 and all(x.n_upto == 2 * (x.at + 1) and int(x.key[1:]) * 7919 % 3000 == x["at"] for x in got)
    assert splits.running_ranges(d.limit(0), ["at"], "n", "key", ["at"]).count() == 0


def test_report_has_a_row_for_each_event(spark):
    e = spark.createDataFrame([("x", "DoS", "a", None, 0.0, 9.0, "/"), ("x", "DoS", "a", None, 5.0, 9.0, "/"), (None, "DoS", "a", None, 0.0, 9.0, "/")], EVENT)
    r = spark.createDataFrame([(4.0, "a", "GET", "/", None), (6.0, "b", "GET", "/", None)], REQUEST)
    found = effects.ground_truth(e, spark.createDataFrame([("x", 1, None, 1)], "event_id string, usable_flows int, port_coverage double, span int"), r).collect()
    assert [(x.event_id, x.requests_attacker, x.requests_other) for x in found] == [("x", 1, 2)] * 2
