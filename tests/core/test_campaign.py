import copy
import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions import policy
from netloom.operators import effects, generator, joins, models, realism, shortcuts, splits, statistics
from netloom.plans import campaign
from netloom.sources import logs, tables
from netloom.streaming import monitor

MANIFEST = {
    "campaign_id": "demo-1", "expected_labels": ["BENIGN", "DoS"], "required_labeling_policy": dict(campaign.STRICT),
    "runs": {"0": {"config_id": 0, "split": "train", "seed": 1, "day": "2026-01-01", "attacks": ["DoS"], "target_ip": "10.0.0.1", "attacker_ip": "10.0.0.9", "target_host": "srv.lab", "timeout": 9, "dos_seconds": 5}, "1": {"config_id": 5, "split": "test", "seed": 2, "day": "2026-01-02", "attacks": ["DoS"], "target_ip": "10.0.0.1", "attacker_ip": "10.0.0.9", "target_host": "srv.lab", "timeout": 9, "dos_seconds": 5}},
}


def named(rows):
    return rows.withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))


def changed(path, value):
    m = copy.deepcopy(MANIFEST)
    at = m
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return json.dumps(m)


@pytest.mark.parametrize("path,value,said", [
    (["campaign_id"], "a b", "safe name"), (["expected_labels"], ["DoS", "DoS"], "repeats"), (["expected_labels"], ["Worm"], "unknown"), (["runs"], {}, "empty"),
    (["runs", "0", "split"], "other", "split"), (["runs", "0", "config_id"], True, "config"), (["runs", "0", "config_id"], 5, "in test and elsewhere"), (["runs", "0", "seed"], -1, "seed"),
    (["runs", "0", "day"], "soon", "ISO"), (["runs", "0", "day"], "2026-02-01", "lie after"), (["runs", "1", "split"], "train", "no run"), (["required_labeling_policy", "use_failed"], 0, "boolean"),
    (["required_labeling_policy", "min_port_coverage"], 1.5, "share"), (["runs", "0", "attacks"], [], "empty plan"), (["runs", "0", "attacks"], ["DoS", "DoS"], "twice"), (["runs", "0", "attacks"], ["BENIGN"], "no attack"), (["runs", "0", "attacks"], ["PortScan"], "does not expect"),
    (["expected_labels"], ["BENIGN", "DoS", "PortScan"], "planned by no run"), (["required_policy_profile"], "lax", "unknown"), (["benign_quality_policy"], {"min_benign_flow": 1}, "unknown fields"), (["benign_quality_policy"], {"min_benign_flows": 0}, "positive"),
    (["max_domain_auc"], 2, "share"), (["max_duration_fallback_rate"], 0.1, "needs a window overlap"), (["min_overall_realism_quality"], "strong", "belongs"), (["release_quality_policy"], {"max_mean_js": 0.2}, "not all its fields"),
])
def test_bad_manifests(path, value, said):
    with pytest.raises(campaign.ManifestError, match=said):
        campaign.load_manifest(changed(path, value))


@pytest.mark.parametrize("field,value,said", [("target_ip", "10.0.0.9", "are one"), ("attacker_ip", "::1", "IPv4"), ("target_host", "-x", "host name"), ("timeout", 0, "timeout"), ("dos_seconds", None, "dos_seconds"), ("day", None, "seed or day")])
def test_runs_that_cannot_be_made_again(field, value, said):
    with pytest.raises(campaign.ManifestError, match=said):
        campaign.load_manifest(changed(["runs", "0", field], value), reproducible=True)
    brute = json.loads(json.dumps(MANIFEST).replace("DoS", "BruteForce"))
    with pytest.raises(campaign.ManifestError, match="word lists"):
        campaign.load_manifest(json.dumps(brute), reproducible=True)


def test_policy():
    assert campaign.load_manifest(json.dumps(MANIFEST), reproducible=True)["campaign_id"] == "demo-1"
    assert campaign.policy_violations(campaign.STRICT, campaign.STRICT) == []
    lax = campaign.STRICT | {"min_port_coverage": 0.5, "window_padding_ms": 10, "use_failed": 1, "min_ssl_join_rate": float("nan")}
    assert sorted(k for k, _, _ in campaign.policy_violations(lax, campaign.STRICT)) == ["min_port_coverage", "min_ssl_join_rate", "use_failed", "window_padding_ms"]
    assert campaign.policy_violations(campaign.STRICT | {"min_port_coverage": 0.9}, campaign.STRICT) == []


EVENT = {"label": "DoS", "usable_flows": 2, "matched_flows": 2, "ambiguous_flows": 0, "unique_dst_ports": 1, "port_range_width": 1, "port_coverage": 1.0, "first_match": 11.0, "last_match": 12.0, "window_start": 10.0, "window_end": 20.0}
JOIN = {"records": 4, "records_matching_conn": 3, "orphan_records": 1, "missing_uid_records": 0, "join_rate": 0.75}
STATUS = "run_id int, status string, split_ready_sha256 string, labeling_policy struct<{p}>, events map<string,struct<{e}>>, ssl_join struct<{j}>, quic_join struct<{j}>, class_counts_split_ready map<string,long>, flows_audit long, flows_written_ml long, flows_dropped_ambiguous long, diagnostic boolean, diagnostic_reasons array<string>"
KIND = {bool: "boolean", int: "long", float: "double", str: "string"}


def status(spark, **changes):
    fields = lambda d: ", ".join(f"{k}:{KIND[type(v)]}" for k, v in d.items())
    one = {"run_id": 0, "status": "success", "split_ready_sha256": "ab" * 32, "labeling_policy": campaign.STRICT, "events": {"e1": EVENT}, "ssl_join": JOIN, "quic_join": JOIN, "class_counts_split_ready": {"DoS": 2, "BENIGN": 3},
           "flows_audit": 6, "flows_written_ml": 5, "flows_dropped_ambiguous": 1, "diagnostic": False, "diagnostic_reasons": []} | changes
    schema = STATUS.replace("{p}", fields(campaign.STRICT)).replace("{e}", fields(EVENT)).replace("{j}", fields(JOIN))
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(one)]))


@pytest.mark.parametrize("changes,rule", [
    ({"status": "running"}, "status"), ({"flows_audit": 9}, "flows"), ({"class_counts_split_ready": {"DoS": 9}}, "class counts"), ({"diagnostic": True}, "diagnostic"),
    ({"ssl_join": JOIN | {"join_rate": 0.9}}, "ssl_join: rate"), ({"quic_join": JOIN | {"orphan_records": 0}}, "quic_join: does not close"), ({"events": {"e": EVENT | {"usable_flows": 3}}}, "over matched"),
    ({"events": {"e": EVENT | {"matched_flows": 5}}}, "not matched"), ({"events": {"e": EVENT | {"first_match": 1.0}}}, "times"), ({"events": {"e": EVENT | {"label": "BENIGN"}}}, "label"), ({"events": {"e": EVENT | {"port_range_width": 2}}}, "port_coverage"),
])
def test_bad_statuses(spark, changes, rule):
    bad = [r.rule for r in campaign.validate_statuses(status(spark, **changes)).filter("violations > 0").collect()]
    assert any(rule in b for b in bad)


def test_authentication(spark):
    assert campaign.validate_statuses(status(spark)).filter("violations > 0").count() == 0
    runs = campaign.manifest_runs(spark, MANIFEST).filter("run_id = 0")
    files = spark.createDataFrame([(0, "ab" * 32)], "run_id int, sha256 string")
    rows = spark.createDataFrame([(0, "DoS", 11.0, 1.0)] * 2 + [(0, "BENIGN", 1.0, None)] * 3, "run_id int, label string, ts double, duration double")
    assert campaign.authenticate(files, status(spark), rows, runs, campaign.STRICT) == []
    off = rows.withColumn("ts", F.when(F.col("label") == "DoS", 99.0).otherwise(F.col("ts")))
    assert any("no window" in r for r in campaign.authenticate(files, status(spark), off, runs, campaign.STRICT))
    other = spark.createDataFrame([(3, "cd" * 32)], "run_id int, sha256 string")
    said = " ".join(campaign.authenticate(other, status(spark), rows, runs, campaign.STRICT | {"min_port_coverage": 0.9}))
    assert "don't pair" in said and "run 0: missing" in said and "run 3: extra" in said and "min_port_coverage" in said
    notes = spark.createDataFrame([("0", "DoS", "10.0.0.1", "10.0.0.9"), ("1", "PortScan", "x", "y")], "run_id string, label string, target_ip string, attacker_ip string")
    assert {tuple(r) for r in campaign.annotation_plan_gaps(notes, campaign.manifest_runs(spark, MANIFEST)).collect()} == {(1, "DoS", "missing"), (1, "PortScan", "unplanned")}


def test_generated_campaign_is_built_and_judged(spark):
    shares = {"BENIGN": 0.7, "PortScan": 0.1, "BruteForce": 0.1, "DoS": 0.1}
    d = generator.generate(spark, 1500, shares, runs=3, seed=1)
    s = {r.label: r for r in generator.summary(d).collect()}
    assert sum(r.flows for r in s.values()) == 1500 and s["DoS"].median_duration > s["PortScan"].median_duration and s["PortScan"].client_prints == 0
    rows = d.select("run_id", "timestamp", *ft.COMMON, "label").cache()
    plan = {0: "train", 1: "validation", 2: "test"}
    b = campaign.build(rows, plan, ft.COMMON, max_duplicate_rate=0.05)
    assert b.official and b.manifest.count() == 3
    with pytest.raises(campaign.ManifestError, match="time order"):
        campaign.build(rows, {0: "test", 1: "validation", 2: "train"}, ft.COMMON, max_duplicate_rate=0.05)
    assert campaign.build(rows, {0: "train", 1: "test"}, ft.COMMON, 0.05, diagnostic=True).reasons
    train, test = b.rows.filter("split = 'train'"), b.rows.filter("split = 'test'")
    numeric, text = ["flow_duration", "tot_fwd_pkts", "totlen_bwd_bytes"], ["transport", "ja3s"]
    p = models.predict(models.forest(train, numeric, text, trees=10, balanced=True), test, numeric, text)
    assert models.macro_f1(p, "label", "predicted") > 0.5
    real = b.rows.filter("split <> 'validation'")
    other = generator.generate(spark, 600, shares, runs=2, seed=9, profile="broad").select("run_id", "label", *numeric, *text).cache()
    for balanced in (False, True):
        out = realism.transfer(real, other, numeric, text, balance=balanced, seeds=(0,), trees=8)
        assert out["reference"] > 0.4 and out["ratio"] > 0.3 and 0 <= out["trts"] <= 1
    by = realism.domain_report(rows, other, numeric, text, trees=5)
    assert by["held_out_by"] == "run" and 0 <= by["macro_auc"] <= 1 and set(by["per_class"]) <= set(shares) and len(by["top_features"]) == 8
    same = realism.domain_report(rows.drop("run_id"), rows.drop("run_id"), numeric, [], run=None, trees=5)
    assert same["held_out_by"] == "hash" and abs(same["auc_raw"] - 0.5) < 0.2 and sum(x["real"] for x in same["support_test"].values()) > 100
    assert realism.domain_report(rows.limit(0), other, numeric, [], run=None, trees=5)["auc_raw"] is None
    found = models.baseline(named(b.rows), numeric, text, trees=8)
    assert found["balanced_accuracy"] > 0.4 and found["mcc"] > 0.3 and 0 < found["pr_auc"] <= 1 and sum(found["confusion"].values()) == test.count()
    assert "before test" in models.baseline(named(b.rows).withColumn("timestamp", -F.col("timestamp")), numeric, text)["reason"]
    assert "unknown" in models.baseline(named(b.rows).drop("timestamp"), numeric, text)["reason"] and "class" in models.baseline(named(b.rows.filter("label = 'DoS'")), numeric, text)["reason"]
    apart = realism.separability(rows, ["flow_duration", "tot_fwd_pkts", "totlen_bwd_bytes"], [], ["flow_duration", "tot_fwd_pkts"], trees=8)
    assert 0.5 < apart["volume_f1"] <= 1 and len(apart["importances"]) == 3 and apart["split"] == "last run"
    meter = generator.with_meter(generator.generate(spark, 300, shares, seed=4))
    assert set(ft.EXTENDED) <= set(meter.columns) and campaign.contracts.evaluate(meter, campaign.contracts.meter_rules(meter.columns) + campaign.contracts.common_rules(meter.columns)).filter("violations > 0").count() == 0
    assert meter.filter("transport = 'UDP' and flow_SYN_flag_count is not null").count() == 0 and {r.alpn for r in d.filter("label = 'DoS'").select("alpn").distinct().collect()} == {"h2", "http/1.1"}
    curve, said = models.fragility(train, test, ["flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_bytes", "totlen_bwd_bytes", "down_up_ratio", "flow_bytes_s", "flow_pkts_s"], levels=(0.0, 2.0), trees=8)
    assert said in ("stable", "moderate", "severe") and curve[0.0] >= curve[2.0] - 0.1
    assert [len(c) for c in policy.regimes([*ft.COMMON, "label"]).values()] == [15, 14, 13, 13, 12, 11]
    with pytest.raises(ValueError, match="no regime"):
        policy.regimes(ft.COMMON, wanted=("X",))
    assert policy.group_of("Src IP") == "sii" and policy.group_of("Start-UTC") == "bookkeeping" and policy.group_of("tls_fingerprint") == "fingerprints"
    net = models.predict(models.network(train, numeric, []), test, numeric, [])
    assert models.macro_f1(net, "label", "predicted") > 0.2
    drawn = models.balance_to(rows, "label", {"DoS": 5, "BENIGN": 7, "PortScan": 0}, 1)
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {"DoS": 5, "BENIGN": 7}
    assert [drawn.exceptAll(models.balance_to(rows, "label", {"DoS": 5, "BENIGN": 7}, s)).count() == 0 for s in (1, 2)] == [True, False]
    with pytest.raises(ValueError, match="train lacks"):
        models.encode_labels(train, [test.withColumn("label", F.lit("new"))])


def test_realism_and_release():
    limits = {"max_mean_js": 0.25, "max_cat_js": 0.25, "max_cond_js": 0.3, "max_missing_rate_difference": 0.15, "min_tstr_reference_ratio": 0.8, "min_reference_f1": 0.5}
    good = {"mean_js": 0.1, "mean_cat_js": 0.2, "cond_js": 0.3, "missing_gap": 0.0, "tstr_ratio": 0.9, "reference_f1": 0.9}
    assert campaign.realism(good, limits)["overall"] == "strong"
    assert campaign.realism(good | {"cond_js": 0.5}, limits)["overall"] == "moderate"
    assert campaign.realism(good | {"reference_f1": 0.2}, limits)["transfer"] == "moderate"
    assert campaign.realism(good | {"mean_js": float("nan")}, limits)["overall"] == "poor"
    assert campaign.release_reasons(False, True, "pass", "strong", "moderate") == []
    assert len(campaign.release_reasons(True, False, None, "poor", "moderate")) == 4
    assert [campaign.shortcut_verdict(*x) for x in ((0.95, 0.5), (0.5, 0.99), (0.5, 0.93), (0.5, 0.5))] == ["shortcut", "shortcut", "suspicious", "clean"]
    steps = campaign.run_steps([campaign.Step("a", lambda: None), campaign.Step("b", lambda: 1 / 0), campaign.Step("c", lambda: None), campaign.Step("d", lambda: None, always=True)])
    assert steps["a"] == "ok" and steps["b"].startswith("failed") and steps["c"] == "skipped" and steps["d"] == "ok"


def test_effect_of_an_outage(spark):
    rows = [(float(t), "u", 0 if 10 <= t < 20 else 1, 5.0 + t % 3, "down" if 10 <= t < 20 else "", 200) for t in range(30)] + [(float(t), "control", 1, 5.0, "", 200) for t in range(30)]
    probes = spark.createDataFrame(rows, "ts double, url string, ok int, latency_ms double, error string, http_code int")
    w = spark.createDataFrame([(10.0, 19.5)], "start double, end double")
    got = {r.url: r for r in effects.effects(probes, w).collect()}
    assert got["u"].effect_confirmed and not got["control"].effect_confirmed and got["u"].availability_attack == 0


def test_requests_are_attributed(spark):
    e = spark.createDataFrame([("b", "BruteForce", "10.0.0.9", "blog.lab", 0.0, 100.0, "/login")], "event_id string, label string, attacker string, target string, start double, end double, path string")
    line = lambda ts, ip, method="POST", host="blog.lab:443": json.dumps({"ts": ts, "status": 200, "request": {"method": method, "uri": "/wp/login", "remote_ip": ip, "host": host}})
    raw = spark.createDataFrame([(x,) for x in [line(1.0, "10.0.0.9:50"), line(2.0, "10.0.0.9"), line(100.0, "10.0.0.9"), line(3.0, "10.0.0.5"), line(4.0, "10.0.0.9", "GET"), line(5.0, "10.0.0.9", host="x"), line(200.0, "10.0.0.9"), "{broken"]], "value string")
    assert tuple(effects.attributed_requests(e, logs.read_access_log(raw)).first()) == ("b", 3, 1)


def test_readers_and_checks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text("x")
    inv = tables.inventory(spark, str(tmp_path / "m")).first()
    assert (inv.path, inv["size"]) == ("a.txt", 1) and len(inv.sha256) == 64
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    packet = lambda s: struct.pack("<IIII", s, 500000, 3, 3) + b"abc"
    assert tables.pcap_info(head + packet(5) + packet(9)) == {"ok": True, "reason": "", "packets": 2, "first_ts": 5.5, "last_ts": 9.5}
    assert not tables.pcap_info(head + packet(5)[:-1])["ok"] and not tables.pcap_info(b"junk" * 9)["ok"] and not tables.pcap_info(head)["ok"]
    (tmp_path / "c.pcap").write_bytes(head + packet(5))
    assert tables.read_captures(spark, str(tmp_path / "c.pcap")).first().packets == 1
    with pytest.raises(Exception, match="malformed manifest"):
        tables.parse_manifest(spark.createDataFrame([("nonsense",)], "value string")).collect()
    (tmp_path / "mon.csv").write_text("utc,url,ok,http_code,latency_ms,error,cpu_busy,mem_used_frac\n1970-01-01T00:00:05Z,u,1,200,3.5,,0,0\n1970-01-01T00:00:06,u,0,0,,x,0,0\njunk,u,1,200,1,,0,0\n")
    assert [(r.ts, r.ok, r.latency_ms) for r in logs.read_monitor(spark, str(tmp_path / "mon.csv")).orderBy("ts").collect()] == [(5.0, 1, 3.5), (6.0, 0, None)]
    text = spark.range(1).select(F.lit("Reference ID : X\nSystem time     : 0.000120 seconds slow of NTP time").alias("t"))
    assert text.select(logs.clock_offset_ms(F.col("t"))).first()[0] == pytest.approx(0.12) and text.select(logs.parse_key_lines(F.col("t"))["Reference ID"]).first()[0] == "X"
    for name, columns in (("run_3.csv", "label,flow_duration"), ("x.csv", "label,flow_duration")):
        (tmp_path / name).write_text(columns + "\nDoS,1.5\nDoS,\n")
    both = tables.load_runs(spark, [str(tmp_path / "run_3.csv"), str(tmp_path / "x.csv")])
    assert {r.run_id for r in both.collect()} == {1, 3} and both.filter("flow_duration is null").count() == 2
    with pytest.raises(ValueError, match="differ"):
        splits.union_runs([both, both.drop("label")])
    with pytest.raises(Exception):
        logs.read_sessions(spark.createDataFrame([("{broken",)], "value string")).collect()
    flows = spark.createDataFrame([("c", "v", "TCP", 443, 2), ("c", "v", "udp", 443, 0), ("c", "x", "udp", 443, 5)], "src string, dst string, proto string, port int, resp_pkts int")
    seen = joins.mirrored(flows, "c", "v", 443, 443).first()
    assert seen.victim_responded and seen.tcp_answered and not seen.udp_answered and not seen.victim_to_client and not seen.confirmed and len(seen.problems) == 1
    assert joins.mirrored(flows, "c", "v", 443).first().confirmed and joins.mirrored(flows, "v", "c").first().problems == ["no flow from client to victim"]
    assert joins.mirrored(flows.filter("proto = 'udp'"), "c", "v").first().problems == ["no response was mirrored"]
    assert 0.9 < statistics.ks_p_value(0.01, 100, 100) <= 1 and statistics.ks_p_value(0.5, 100, 100) < 1e-6


def test_tree_finds_the_split(spark):
    rows = [(float(i % 32), "a" if i % 2 else "b", "DoS" if i % 32 >= 16 else "BENIGN") for i in range(800)]
    nodes = shortcuts.tree(spark.createDataFrame(rows, "x double, k string, label string"), ["k", "x"], "label", depth=2)
    assert nodes[0]["split"][0] == "x" and {n["label"] for n in nodes[1:]} == {"DoS", "BENIGN"} and len(nodes) == 3


def test_streamed_availability(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, 0, s), "u", int(s < 30)) for s in range(0, 60, 5)]
    spark.createDataFrame(rows, "at timestamp, url string, ok int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, url string, ok int").parquet(f"{tmp_path}/in")
    t = datetime(2026, 1, 1).timestamp()
    w = spark.createDataFrame([(rows[6][0].timestamp(), t + 3600)], "start double, end double")
    q = monitor.availability_by_minute(stream, w).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    try:
        q.processAllAvailable()
        got = {r.inside: (r.probes, r.availability) for r in spark.table("seen").collect()}
    finally:
        q.stop()
    assert got == {False: (6, 1.0), True: (6, 0.0)}
