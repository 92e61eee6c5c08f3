import copy
import json

import pytest
from pyspark.sql import functions as F

from netloom.operators import contracts, intervals, joins, splits, statistics
from netloom.plans import campaign, evidence
from netloom.sources import logs, shared, tables

END = {"tcpdump_returncode": 0, "tcpdump_stats": {"packets_captured": 1000, "packets_received": 1010, "packets_dropped": 10, "drop_rate": 10 / 1010}, "pcap": {"size_bytes": 9, "sha256": "ab"}}
FOUND = {"size": 9, "sha256": "ab", "ok": True, "reason": "", "packets": 1000}


def put(value, path, new):
    out = copy.deepcopy(value)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = new
    return out


@pytest.mark.parametrize("path,value,said", [
    (["tcpdump_returncode"], 1, "return code"), (["tcpdump_returncode"], False, "return code"), (["tcpdump_stats"], None, "missing"), (["tcpdump_stats", "drop_rate"], -1, "no share"), (["tcpdump_stats", "drop_rate"], 0.02, "not dropped by received"),
    (["tcpdump_stats", "packets_captured"], 999, "other number"), (["tcpdump_stats", "packets_captured"], 2000, "more packets"), (["tcpdump_stats", "packets_dropped"], 500, "too many"), (["pcap", "sha256"], "cd", "other digest"), (["pcap", "size_bytes"], 8, "other size"),
])
def test_captures(path, value, said):
    assert evidence.capture(END, FOUND, 1000, 0.02) == evidence.Check("PASS")
    got = evidence.capture(put(END, path, value), FOUND, 1000, 0.02)
    assert got.state == "FAIL" and any(said in p for p in got.problems)


def test_capture_files():
    assert evidence.capture(None, FOUND).state == "SKIP" and evidence.capture(END, None).state == "FAIL"
    assert evidence.capture(END, FOUND | {"ok": False, "reason": "cut"}).problems == ["no capture: cut"]
    assert evidence.capture(END, FOUND, least_packets=2000).state == "FAIL"
    assert evidence.capture({"tcpdump_returncode": 0}, FOUND, strict=False).state == "PASS"


HEAD = "#separator \\x09\n#fields\t"


def write_logs(folder, ssl_uid="u1", ssl_fields="uid\tversion\tserver_name\tja3\tja3s\tnext_protocol"):
    conn = "uid\tid.orig_h\tid.resp_h\tproto\tid.resp_p\tts\n"
    (folder / "conn.log").write_text(HEAD + conn + "u1\ta\tb\ttcp\t443\t1.0\nu2\ta\tb\tudp\t443\t2.0\n")
    (folder / "ssl.log").write_text(HEAD + ssl_fields + "\n" + "\t".join([ssl_uid, *["x"] * ssl_fields.count("\t")]) + "\n")
    (folder / "quic.log").write_text(HEAD + "uid\tversion\tserver_name\n" + "u2\t1\tx\n")


def read_logs(spark, folder):
    names = ("conn.log", "ssl.log", "quic.log")
    frames = {n: logs.read_zeek(spark, f"{folder}/{n}") for n in names}
    return frames, {n: logs.profile(spark, f"{folder}/{n}").first().asDict() for n in names}


def test_logs(spark, tmp_path):
    write_logs(tmp_path)
    record = {"zeek_returncode": 0, "logs": {"conn.log": {"records": 2}, "ssl.log": {"records": 1}, "quic.log": {"records": 1}}, "site_script_sha256": "ab"}
    frames, profiles = read_logs(spark, tmp_path)
    assert evidence.logs(record, frames, profiles, ["ab"]) == evidence.Check("PASS")
    assert evidence.logs(record, frames, profiles, ["cd"]).problems == ["the site script is missing or another"]
    assert "return code None" in evidence.logs({}, frames, profiles).problems and evidence.logs({}, frames, profiles, strict=False).state == "PASS"
    assert any("claimed" in p for p in evidence.logs(put(record, ["logs", "ssl.log", "records"], 7), frames, profiles, ["ab"]).problems)
    write_logs(tmp_path, ssl_uid="other", ssl_fields="uid\tversion")
    frames, profiles = read_logs(spark, tmp_path)
    bad = evidence.logs(record, frames, profiles, ["ab"]).problems
    assert any("lacks server_name" in p for p in bad) and any("uids that conn.log lacks" in p for p in bad)
    nowhere = read_logs(spark, tmp_path / "nowhere")
    assert evidence.logs(None, *nowhere).state == "SKIP" and evidence.logs(record, *nowhere, ["ab"]).state == "FAIL"
    absent = nowhere[0]["quic.log"]
    assert absent.columns == ["uid", "line_no"] and absent.count() == 0


SESSION = {"campaign_id": "c", "run_id": 1, "seed": 2, "attempt_id": "a", "session_id": 1, "browser": "b", "site": "s", "start": 10.0, "end": 12.0, "ok": True, "pages": 2, "webdriver": "w", "browser_name": "firefox", "browser_version": "1", "webdriver_name": "geckodriver", "webdriver_version": "2"}
POLICY = {"require_benign_jsonl": True, "require_browser_evidence": True, "min_successful_sessions": 2, "min_success_rate": 0.5}


def judged(spark, sessions, policy=None, **given):
    raw = spark.createDataFrame([(s if isinstance(s, str) else json.dumps(s),) for s in sessions] + [("",)], "value string")
    return evidence.benign(evidence.sessions(raw), POLICY if policy is None else policy, {"campaign_id": "c", "run_id": 1, "seed": 2, "attempt_id": "a"}, **given)


def test_benign_sessions(spark):
    two = SESSION | {"session_id": 2, "start": "1970-01-01T00:00:20Z", "end": 22.0}
    assert judged(spark, [SESSION, two], window=(5.0, 30.0), packets=(11.0, 21.0)) == evidence.Check("PASS")
    assert evidence.benign(None, {}) == evidence.Check("PASS")
    cases = [
        ([SESSION, "[1"], "no object"), ([SESSION, two | {"seed": None}], "seed: missing"), ([SESSION, two | {"ok": "true"}], "no boolean"), ([SESSION, two | {"pages": 0}], "none on success"), ([SESSION, two | {"session_id": 1}], "come twice"), ([SESSION, two | {"session_id": "2"}], "no positive number"),
        ([SESSION, two | {"end": 19.0}], "end not after start"), ([SESSION, two | {"end": 20.01}], "too short"), ([SESSION, two | {"attempt_id": "old"}], "attempt_id: not a"), ([SESSION, two | {"webdriver_name": "chromedriver"}], "not the browser's"), ([SESSION, two | {"browser_name": "lynx"}], "unknown"),
        ([SESSION, two | {"start": 11.0}], "overlap"), ([SESSION, SESSION | {"session_id": 2}], "copied"), ([SESSION, two | {"ok": False}], "1 successful"), ([], "no session"),
    ]
    for sessions, said in cases:
        got = judged(spark, sessions)
        assert got.state == "FAIL" and any(said in p for p in got.problems), (said, got)
    assert any("before the capture" in p for p in judged(spark, [SESSION, two], window=(11.0, None)).problems)
    assert any("apart from the packets" in p for p in judged(spark, [SESSION, two], packets=(13.0, 21.0)).problems)


def test_binding_and_verdict():
    start = {"run_id": 1, "interface": "e", "tcpdump_version": "t", "filter": None, "duration_s": 5, "started_utc": "2026-01-01T00:00:00Z"}
    status = {"run_id": 1, "campaign_id": "c", "output_hashes": {"ml": "1", "audit": "2"}}
    records = {"capture_start": start, "run_status": status}
    claims = [("conn", "AB", "ab"), ("audit", "2", "2")]
    assert evidence.binding(1, records, claims, {"campaign_id": "c"}) == evidence.Check("PASS")
    for args, said in (((2, records, claims, {"campaign_id": "c"}), "of run 1"), ((1, records, [("x", None, "a")], {}), "no digest"), ((1, records, [("x", "a", None)], {}), "file is missing"), ((1, records, [("x", "a", "b")], {}), "other digest"), ((1, records, claims, {"campaign_id": "d"}), "not 'd'"),
                       ((1, records, claims, None), "no campaign"), ((1, records | {"capture_start": start | {"duration_s": 0}}, claims, {}), "duration_s"), ((1, put(records, ["run_status", "output_hashes", "audit"], "1"), claims, {}), "not distinct")):
        assert any(said in p for p in evidence.binding(*args).problems), said
    assert evidence.binding(1, {"zeek": None}, [("x", None, None)], None, strict=False).state == "PASS"
    good, skipped = evidence.Check("PASS"), evidence.Check("SKIP")
    sealed = evidence.verdict([], good, {"capture": good}, False, False)
    assert sealed["overall"] == "PASS" and sealed["official"] and not evidence.verdict_mismatches(sealed, sealed)
    assert evidence.verdict([], good, {"capture": skipped}, False, False)["overall"] == "FAIL" and not evidence.verdict([], good, {"capture": skipped}, True, True)["official"]
    assert evidence.verdict([], good, {"capture": good}, True, False)["overall"] == "FAIL" and evidence.verdict(["x"], good, {}, False, True)["overall"] == "FAIL"
    assert evidence.verdict_mismatches(evidence.verdict([], good, {"capture": skipped}, False, True), sealed) == ["official", "semantics"]
    assert evidence.roll_up([("a", "PASS", True), ("b", "FAIL", False), ("c", "SKIP", True)])["ok"] and not evidence.roll_up([("a", "FAIL", True)])["ok"]


def test_records_and_gates(spark):
    assert evidence.overlap_gate(10, 1, 0.2) == [] and evidence.overlap_gate(10, 10, None) == ["overlap_duration_fallback"] and len(evidence.overlap_gate(10, 5, 0.1)) == 1
    one = spark.createDataFrame([(0.5,), (0.5,)], "min_window_overlap double")
    assert evidence.overlap_pins(one, 0.5, True) == [] and len(evidence.overlap_pins(one, None, True)) == 1 and evidence.overlap_pins(one.unionByName(spark.createDataFrame([(None,)], "min_window_overlap double")), 0.5, False)
    assert evidence.verdict_record("x", [], [], {"a": 1.0}) == ({"name": "x", "verdict": "PASS", "reasons": [], "measures": {"a": 1.0}}, 0)
    assert evidence.verdict_record("x", [], ["r"])[1] == 3 and evidence.verdict_record("x", ["i"], ["r"])[1] == 2 and evidence.verdict_record("x", [], [], {"a": float("nan")})[1] == 2
    rows = evidence.seed_rows([{"m": "rf", "seed": 0, "f1": 0.5}, {"m": "rf", "seed": 1, "f1": 0.7}], ["m"], ["f1"])
    assert len(rows) == 3 and rows[2] == {"m": "rf", "seed": "all", "f1": "0.600000 ± 0.100000"}
    p = evidence.provenance("ab", {"b": "2", "a": "1"}, {}, {}, {}, [], {"allow": False, "force": True})
    assert not p["official"] and p["diagnostic_reasons"] == ["force"] and list(p["inputs"]) == ["a", "b"]
    assert evidence.generator_record({"seed": 1}, "ab", {"DoS": 2, "BENIGN": 3})["rows"] == 5


def test_bundles(tmp_path):
    for n in ("a.csv", "b.json"):
        (tmp_path / n).write_text(n)
    out = str(tmp_path / "x.tar.gz")
    sealed = evidence.write_bundle(str(tmp_path), ["b.json", "a.csv"], out, "m.json", "h.json")
    assert evidence.verify_bundle(out, sealed, "m.json", "h.json") == []
    assert evidence.verify_bundle(out, sealed | {"bundle_sha256": "0"}, "m.json", "h.json") == ["the bundle has another digest"]
    (tmp_path / "a.csv").write_text("changed")
    import tarfile

    with tarfile.open(out, "w:gz") as tar:
        for n in ("a.csv", "b.json", "m.json", "h.json", "x.txt"):
            (tmp_path / "x.txt").write_text("x")
            tar.add(tmp_path / n, arcname=n)
    again = sealed | {"bundle_sha256": evidence.sha256_of(out)}
    assert evidence.verify_bundle(out, again, "m.json", "h.json") == ["x.txt: not in the manifest", "a.csv: other digest"]
    with tarfile.open(out, "w:gz") as tar:
        tar.add(tmp_path / "a.csv", arcname="../a.csv")
    assert evidence.verify_bundle(out, sealed | {"bundle_sha256": evidence.sha256_of(out)}, "m.json", "h.json")[0].startswith("unsafe")
    (tmp_path / "x.tar.gz").write_text("no tar")
    assert evidence.verify_bundle(out, sealed | {"bundle_sha256": evidence.sha256_of(out)}, "m.json", "h.json")[0].startswith("no valid bundle")


def test_campaigns_are_driven():
    ran = []
    one = lambda good: lambda r: ran.append(r) or r in good
    assert evidence.drive([2, 1], one({1, 2}), lambda r: False, lambda: True) == {"runs": {1: "ok", 2: "ok"}, "state": "COMPLETE", "analysed": True} and ran == [1, 2]
    assert evidence.drive([1, 2, 3], one({1, 3}), lambda r: False, lambda: True)["runs"] == {1: "ok", 2: "failed", 3: "not run"}
    assert evidence.drive([1, 2], one({2}), lambda r: False, lambda: True, diagnostic=True)["state"] == "FAILED"
    assert evidence.drive([1, 2], one({2}), lambda r: r == 1, lambda: True, resume=True)["runs"] == {1: "resumed", 2: "ok"}


JOIN = {"records": 4, "records_matching_conn": 4, "orphan_records": 0, "missing_uid_records": 0, "join_rate": 1.0}
D = "ab" * 32
STATUS = {
    "attempt_id": "a", "code_version": "1", "status": "success", "run_id": 0, "split_ready_sha256": D, "campaign_id": "c", "campaign_sha256": D, "config_id": 0, "split": "train", "labeling_policy": campaign.STRICT, "diagnostic": False, "diagnostic_reasons": [], "min_window_overlap": 0.5,
    "overlap_accounting": {"matched_flows": 2, "duration_fallback_flows": 0}, "ssl_join": JOIN, "quic_join": JOIN, "ip_bytes_fallback": 0, "flows_written_ml": 5, "flows_audit": 6, "flows_dropped_ambiguous": 1, "class_counts_split_ready": {"DoS": 2, "BENIGN": 3},
    "input_hashes": {"conn": D, "ssl": D, "quic": D, "annotations": D}, "output_hashes": {"ml": D, "split_ready": D, "audit": D}, "files": {"ml": "m", "split_ready": "s", "audit": "a"},
    "events": {"e1": {"label": "DoS", "usable_flows": 2, "matched_flows": 2, "ambiguous_flows": 0, "unique_dst_ports": 1, "port_range_width": 1, "port_coverage": 1.0, "first_match": 11.0, "last_match": 12.0, "window_start": 10.0, "window_end": 20.0}},
    "annotation_scenario_version": "2", "annotation_orchestrator_version": "3",
}
VERSIONS = {"code_version": ["1"], "annotation_scenario_version": ["2"], "annotation_orchestrator_version": ["3"]}


def test_official_statuses(spark):
    cases = [
        ([], None, None), (["split"], "x", "split"), (["input_hashes", "ssl"], "zz", "ssl_join: against"), (["output_hashes", "split_ready"], "cd" * 32, "other split_ready"), (["files"], {"ml": "m"}, "files"), (["labeling_policy", "use_failed"], True, "hidden"), (["ip_bytes_fallback"], 3, "ip_bytes"),
        (["ssl_join"], JOIN | {"records_matching_conn": 2, "orphan_records": 2, "join_rate": 0.5}, "ssl_join: against"), (["events", "e1", "usable_flows"], 0, "too few usable"), (["overlap_accounting", "matched_flows"], 3, "not the events'"), (["overlap_accounting", "duration_fallback_flows"], 2, "all fell back"),
        (["min_window_overlap"], None, "without overlap"), (["class_counts_split_ready"], {"DoS": 1, "BENIGN": 4}, "other numbers"), (["class_counts_split_ready"], {"PortScan": 2, "BENIGN": 3}, "not the classes"), (["code_version"], "9", "unsupported"), (["min_window_overlap"], 2.0, "no share"),
    ]
    texts = spark.createDataFrame([(json.dumps((put(STATUS, path, value) if path else STATUS) | {"attempt_id": str(i)}),) for i, (path, value, _) in enumerate(cases)], "text string")
    rules = campaign.status_rules(["full"], VERSIONS)
    parsed = campaign.parse_statuses(texts)
    assert campaign.validate_statuses(parsed.filter("attempt_id = '0'"), official=True, versions=VERSIONS).filter("violations > 0").count() == 0
    broken = parsed.select("attempt_id", *[F.coalesce(r.broken, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]).collect()
    for row in broken:
        said, bad = cases[int(row.attempt_id)][2], [r.name for i, r in enumerate(rules) if row[f"r{i}"]]
        assert (not bad) if said is None else any(said in b for b in bad), (said, bad)
    with pytest.raises(Exception):
        campaign.parse_statuses(spark.createDataFrame([("[1",)], "text string")).collect()


def test_statuses_are_found_beside_files(spark, tmp_path):
    (tmp_path / "run0_run_status.json").write_text(json.dumps(STATUS))
    got = {r.path[-20:]: (r.present, r.sha256) for r in tables.statuses_beside(spark, [f"{tmp_path}/run{i}_split_ready.csv" for i in (0, 1)]).collect()}
    assert got["run0_split_ready.csv"][0] and len(got["run0_split_ready.csv"][1]) == 64 and got["run1_split_ready.csv"] == (False, None)
    with pytest.raises(ValueError, match="is not named"):
        tables.statuses_beside(spark, ["x.csv"])
    path = f"{tmp_path}/s.json"
    digest = tables.write_status(spark, path, "running", {"run_id": 1})
    text = (tmp_path / "s.json").read_text()
    assert tables.read_json(text) == ({"run_id": 1, "status": "running"}, digest)
    tables.write_status(spark, path, "failed", {"error": "x"})
    assert json.loads((tmp_path / "s.json").read_text())["status"] == "failed"
    for state in ("failed", "odd"):
        with pytest.raises(ValueError):
            tables.write_status(spark, path, state, {})
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]"):
        with pytest.raises(ValueError):
            tables.read_json(text)


def test_annotations_as_a_file(spark):
    a = spark.createDataFrame([("e1", "1"), ("e1", "1"), ("e2", "2")], "event_id string, run_id string")
    assert {r.rule: r.violations for r in tables.annotation_file_rules(a).collect()} == {"event_id: repeated": 1, "run_id: several runs": 1}
    b = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    for column, every in (("a", False), ("b", True), ("c", True), ("b", False)):
        with pytest.raises(ValueError):
            tables.single_version(b, column, ["1", "2"], every)
    assert tables.single_version(b, "b", ["x"]) == "x" and tables.single_version(b, "c", ["x"]) is None


def test_chronology_without_validation(spark):
    rows = spark.createDataFrame([("train", 5.0), ("test", 1.0), ("train", float("nan")), ("test", None)], "split string, t double")
    assert splits.chronology(rows, "t").first()["ordered"] is False
    assert splits.chronology(rows.withColumn("t", -F.col("t")), "t").first()["ordered"] is True
    assert splits.chronology(rows.filter("split = 'train'"), "t").first()["ordered"] is None
    assert splits.chronology(rows.unionByName(spark.createDataFrame([("val", None)], "split string, t double")), "t").first()["ordered"] is None


def test_real_splits(spark):
    d = spark.createDataFrame([(i % 3, float(i), i) for i in range(100)], "run_id int, timestamp double, i int")
    got, how = splits.real_split(d)
    assert how == "last run" and got.filter("split = 'test'").select("run_id").distinct().collect()[0][0] == 2
    got, how = splits.real_split(d.drop("run_id"))
    assert how.startswith("latest") and got.filter("split = 'test'").agg(F.min("timestamp"), F.count("*")).first()[:] == (70.0, 30)
    got, how = splits.real_split(d.select("i"))
    assert "hash" in how and 10 < got.filter("split = 'test'").count() < 50


def test_ranks_with_one_time(spark):
    d = spark.createDataFrame([(1.0, i) for i in range(2000)] + [(None, 5)], "t double, i int")
    got = splits.ranks(d, ["t", "i"]).collect()
    assert sorted((r["rank"], r.t, r.i) for r in got) == [(1, None, 5)] + [(i + 2, 1.0, i) for i in range(2000)]


def test_running_sums_over_all_kinds_of_values(spark):
    import math
    import random

    rng = random.Random(3)
    values = [0.0, -0.0, 1e-320, -1e-320, 1e308, -1e308, float("inf"), float("-inf"), 1.7e9, 1.7e9 + 0.25] + [rng.choice([-1, 1]) * math.exp(rng.uniform(-700, 700)) for _ in range(300)]
    rows = [(k, v) for k in ("a", None) for v in set(values)]
    counts = spark.createDataFrame([(k, v, i % 5) for i, (k, v) in enumerate(rows)], "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    for down in (False, True):
        got = {(r.k, r.v): r.n_before for r in statistics.running(counts, ["k"], "v", ["n"], down).collect()}
        table = counts.collect()
        for r in table[::7]:
            assert got[r.k, r.v] == sum(x.n for x in table if x.k == r.k and (x.v > r.v if down else x.v < r.v))


def test_windows_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([("DoS", 5.0, 1.0), ("DoS", 500.0, None), ("DoS", 7300.0, 9000.0)], "label string, ts double, duration double")
    w = spark.createDataFrame([("DoS", float(i * 10), float(i * 10 + 6)) for i in range(20)], "w_label string, start double, end double")
    assert {r.ts for r in intervals.off_window(rows, w).collect()} == {500.0, 7300.0}


def test_shared_folder(spark):
    assert shared.folder(spark) and shared.new_path(spark, "x") != shared.new_path(spark, "x")


def test_events_against_audit_rows(spark):
    events = spark.createDataFrame([("e1", "DoS", 10.0, 20.0), ("e2", "PortScan", 50.0, 60.0)], "event_id string, label string, start double, end double")
    audit = spark.createDataFrame([("e1", "DoS", 0, 9.5, 0.0), ("e1", "DoS", 1, 15.0, 0.0), ("e1", "PortScan", 0, 15.0, 0.0), ("e1", "DoS", 0, 40.0, 1.0), ("e9", "DoS", 0, 1.0, 1.0), ("", "BENIGN", 0, 1.0, 1.0)], "matched_event_id string, label string, ambiguous int, ts double, duration double")
    got = {r.event_id: tuple(r)[1:] for r in joins.audit_events(audit, events).collect()}
    assert got == {"e1": (3, 1, 1, 1, 0), "e2": (0, 0, 0, 0, 0), "e9": (1, 0, 0, 0, 1)}
