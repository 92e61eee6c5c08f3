import pytest
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions import parse
from netloom.operators import contracts, intervals
from netloom.plans import labeling

FLOW = "flow_id long, src string, dst string, proto string, port int, ts double, duration double"
WINDOW = "event_id string, w_label string, attacker string, target string, w_proto string, port_lo int, port_hi int, span int, start double, end double, ord long"


def windows(spark, rows):
    out = []
    for i, (event, label, ports, start, end) in enumerate(rows):
        lo, _, hi = ports.partition("-")
        lo, hi = int(lo), int(hi or lo)
        out.append((event, label, "a", "v", "tcp", lo, hi, hi - lo + 1, float(start), float(end), i))
    return spark.createDataFrame(out, WINDOW)


def flows(spark, rows):
    return spark.createDataFrame([(i, src, "v", "TCP", port, float(ts), None if d is None else float(d)) for i, (src, port, ts, d) in enumerate(rows)], FLOW)


def labels(spark, flow_rows, window_rows, share=None):
    d = intervals.classify(flows(spark, flow_rows), windows(spark, window_rows), share)
    return [(r.label, r.matched_event_id, r.ambiguous) for r in d.orderBy("flow_id").collect()]


def test_specific_beats_range(spark):
    got = labels(spark, [("a", 443, 150, 1), ("a", 500, 150, 1), ("a", 80, 150, 1)], [("s", "PortScan", "1-1024", 100, 200), ("b", "BruteForce", "443", 100, 200)])
    assert got == [("BruteForce", "b", 0), ("PortScan", "s", 0), ("PortScan", "s", 0)]


def test_mismatch_tie_and_other_host(spark):
    one = [("b", "BruteForce", "443", 100, 200)]
    assert labels(spark, [("a", 8080, 150, 1)], one) == [("BENIGN", "", 1)]
    assert labels(spark, [("c", 443, 150, 1)], one) == [("BENIGN", "", 0)]
    assert labels(spark, [("a", 443, 150, 1)], [("s", "PortScan", "443", 100, 200), *one]) == [("PortScan", "s", 1)]


@pytest.mark.parametrize("ts,duration,legacy,half", [(90, 100, "BENIGN", "BruteForce"), (199, 100, "BruteForce", "BENIGN"), (150, None, "BruteForce", "BruteForce"), (150, 0, "BruteForce", "BruteForce")])
def test_time_rules(spark, ts, duration, legacy, half):
    one = [("b", "BruteForce", "443", 100, 200)]
    assert labels(spark, [("a", 443, ts, duration)], one)[0][0] == legacy
    assert labels(spark, [("a", 443, ts, duration)], one, 0.5)[0][0] == half


def test_overlap_accounting_and_evidence(spark):
    one = windows(spark, [("b", "BruteForce", "443", 1000, 1100), ("z", "DoS", "80-89", 5000, 5100)])
    f = flows(spark, [("a", 443, 990, 100), ("a", 443, 1099, None)])
    assert tuple(intervals.overlap_accounting(f, one, 0.5).first()) == (2, 1)
    e = {r.event_id: r for r in intervals.event_evidence(f, one, 0.5).collect()}
    assert (e["b"].matched_flows, e["b"].usable_flows, e["b"].first_match, e["b"].last_match, e["b"].port_coverage) == (2, 2, 1000.0, 1099.0, 1.0)
    assert (e["z"].matched_flows, e["z"].unique_dst_ports, e["z"].first_match) == (0, 0, None)
    assert [r.event_id for r in labeling.coverage_gates(intervals.event_evidence(f, one, 0.5)).collect()] == ["z"]


def test_rows_off_their_windows(spark):
    w = windows(spark, [("x", "DoS", "443", 1000, 1001), ("y", "DoS", "443", 1010, 1011), ("s", "PortScan", "443", 1004, 1006)])
    rows = spark.createDataFrame([("DoS", 1005.0, None), ("DoS", 1010.5, None), ("BENIGN", 1.0, None)], "label string, ts double, duration double")
    assert intervals.off_window(rows, w).count() == 1


def test_many_windows_take_the_bucket_join(spark, monkeypatch):
    w = windows(spark, [(f"e{i}", "DoS", "443", i * 900, i * 900 + 4000) for i in range(40)])
    f = flows(spark, [("a", 443, i * 137, (i % 7) * 1500 or None) for i in range(200)])
    for share in (None, 0.5):
        want = {tuple(r) for r in intervals.candidates(f, w, share).select("flow_id", "event_id").collect()}
        with monkeypatch.context() as m:
            m.setattr(intervals, "BROADCAST_ROWS", 5)
            rows = [tuple(r) for r in intervals.candidates(f, w, share).select("flow_id", "event_id").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_parsing(spark):
    d = spark.createDataFrame([("-",), ("BAD",), ("1.5",), ("nan",), ("inf",), (None,), (" 7 ",)], "x string")
    assert [r[0] for r in d.select(parse.number("x")).collect()] == [None, None, 1.5, None, float("inf"), None, 7.0]
    one = spark.range(1)
    e = lambda x, **k: one.select(parse.epoch(F.lit(x), **k)).first()[0]
    assert e("1970-01-01T00:01:00Z") == 60 and e("1970-01-01T02:00:00+02:00") == 0 and e("1970-01-01T00:01:00") is None and e("junk") is None
    assert e("1970-01-01T00:01:00", naive="utc") == 60
    kv = lambda x: one.select(parse.key_values(F.lit(x))).first()[0]
    assert kv("a=1; b = x=y;") == {"a": "1", "b": "x=y"} and kv("a=1;a=2") is None and kv("=1") is None and kv("a") is None and kv("") == {}
    span = lambda x: one.select(parse.port_span(F.lit(x))).first()[0]
    assert (span("443"), span("1-1024"), span("x-9")) == (1, 1024, 10**9)
    tls = lambda x: one.select(ft.tls_version(F.lit(x).cast("string"))).first()[0]
    assert [tls(x) for x in ("TLSv13", "TLSv1.2", "-", None, "weird")] == ["1.3", "1.2", "none", "none", "weird"]
    ports = lambda x: one.select(ft.port_class(F.lit(x))).first()[0]
    assert [ports(x) for x in ("80", "8080", "50000", "x")] == ["well_known", "registered", "ephemeral", "unknown"]
    assert len(ft.COMMON) == 15 and len(ft.METER) == 74 and len(ft.EXTENDED) == 89 and len(ft.METER_TCP_ONLY) == 10


CONN = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts", "conn_state"]


def log(folder, name, fields, rows):
    text = "#separator \\x09\n#fields\t" + "\t".join(fields) + "\n" + "".join("\t".join(r) + "\n" for r in rows) + "#close\n"
    (folder / name).write_text(text)
    return str(folder / name)


def test_a_run_from_logs_to_projections(spark, tmp_path):
    from netloom.sources import logs, tables

    rows = [["100.5", "u1", "a", "5000", "v", "443", "tcp", "-", "2.0", "100", "50", "140", "-", "4", "3", "SF"], ["101.0", "u2", "a", "5001", "v", "443", "udp", "-", "-", "10", "0", "-", "-", "-", "-", "S0"],
            ["500.0", "u3", "c", "5002", "v", "80", "tcp", "-", "0", "1", "1", "41", "41", "1", "1", "SF"], ["102.0", "u4", "a", "5003", "v", "9999", "tcp", "-", "1", "1", "1", "41", "41", "1", "1", "SF"]]
    conn = logs.read_zeek(spark, log(tmp_path, "conn.log", CONN, rows))
    ssl = logs.read_zeek(spark, log(tmp_path, "ssl.log", ["uid", "version", "server_name", "next_protocol", "ja3", "ja3s"], [["u1", "TLSv12", "old", "-", "j", "-"], ["u1", "TLSv13", "blog", "h2", "j", "s"]]))
    quic = logs.read_zeek(spark, log(tmp_path, "quic.log", ["uid", "version", "server_name", "client_protocol"], [["u2", "1", "-", "h3"]]))
    meter = logs.read_zeek(spark, log(tmp_path, "fm.log", ["uid", "fwd_pkts_tot", "fwd_iat.avg", "flow_SYN_flag_count"], [["u1", "4", "0.5", "2"], ["u2", "1", "0.1", "7"]]))
    annotations = tmp_path / "ann.csv"
    annotations.write_text("event_id,run_id,label,attacker_ip,target_ip,protocol,target_port,start_utc,end_utc,status,return_code\n"
                           "b,1,BruteForce,a,v,TCP,443,1970-01-01T00:01:40Z,1970-01-01T00:03:20Z,success,0\n"
                           "x,1,DoS,a,v,UDP,443,1970-01-01T00:01:40Z,1970-01-01T00:03:20Z,failed,1\n")  # fmt: skip
    notes = tables.read_annotations(spark, str(annotations))
    bad = {r.rule for r in contracts.evaluate(notes, tables.annotation_rules(notes.columns)).filter("violations > 0").collect()}
    assert bad == {"attacker_ip: invalid", "target_ip: invalid"}
    labelled = labeling.label_run(conn, ssl, quic, meter, tables.attack_windows(notes))
    got = {r.uid: r for r in labelled.collect()}
    assert [(got[u].label, got[u].matched_event_id, got[u].ambiguous) for u in ("u1", "u2", "u3", "u4")] == [("BruteForce", "b", 0), ("BENIGN", "", 1), ("BENIGN", "", 0), ("BENIGN", "", 1)]
    r = got["u1"]
    assert (r.f_flow_duration, r.f_totlen_fwd_bytes, r.f_totlen_bwd_bytes, r.f_flow_bytes_s, r.f_flow_pkts_s, r.f_down_up_ratio) == (2.0, 140.0, 50.0, 95.0, 3.5, 0.75)
    assert (r.f_sni_present, r.f_tls_version, r.f_alpn, r.f_ja3s, r.f_fwd_iat_avg, r.f_flow_SYN_flag_count) == (1, "1.3", "h2", "s", 0.5, 2.0)
    q = got["u2"]
    assert (q.f_flow_duration, q.f_tot_fwd_pkts, q.f_flow_bytes_s, q.f_transport, q.f_tls_version, q.f_alpn, q.f_flow_SYN_flag_count, q.f_fwd_pkts_tot) == (None, None, None, "UDP", "1.3", "h3", None, 1.0)
    assert got["u3"].f_flow_bytes_s is None and got["u3"].f_tls_version == "none" and got["u3"].f_fwd_pkts_tot is None
    out = labeling.projections(labelled, 7)
    assert out["ml"].columns == [*ft.EXTENDED, "label"] and out["split_ready"].columns == ["run_id", "timestamp", *ft.EXTENDED, "label"]
    assert out["ml"].count() == 2 and out["audit"].count() == 4
    assert contracts.dataset_contract(out["split_ready"]).filter("violations > 0 and severity = 'error'").count() == 0
    tables.publish(out, f"{tmp_path}/out", {"status": "success"})
    assert spark.read.parquet(f"{tmp_path}/out/ml").count() == 2 and (tmp_path / "out/status.json").exists()
    with pytest.raises(FileExistsError):
        tables.publish(out, f"{tmp_path}/out", {})


def test_bad_logs_are_errors(spark, tmp_path):
    from netloom.sources import logs

    path = log(tmp_path, "short.log", ["a", "b"], [["1", "2"], ["1"]])
    with pytest.raises(Exception, match="has not 2 cells"):
        logs.read_zeek(spark, path).collect()
    conn = spark.createDataFrame([("u", "1", "a", "1", "v", "70000", "tcp", "-3", "1.5")], "uid string, ts string, `id.orig_h` string, `id.orig_p` string, `id.resp_h` string, `id.resp_p` string, proto string, duration string, orig_pkts string")
    with pytest.raises(ValueError, match="negative.*not a port|not a port"):
        contracts.require(conn, contracts.conn_rules(conn.columns))


def test_contract_finds_impossible_rows(spark):
    rows = [(2.0, 4.0, 3.0, 140.0, 50.0, 0.75, 95.0, 3.5, 1, "TCP", "well_known", "1.3", "h2", "BENIGN"), (0.0, 1.5, -1.0, float("inf"), 0.0, 9.0, 5.0, 1.0, 2, "ICMP", "odd", "2.0", "x", "Worm")]
    d = spark.createDataFrame(rows, "flow_duration double, tot_fwd_pkts double, tot_bwd_pkts double, totlen_fwd_bytes double, totlen_bwd_bytes double, down_up_ratio double, flow_bytes_s double, flow_pkts_s double, sni_present int, transport string, dst_port_class string, tls_version string, alpn string, label string")
    bad = {r.rule for r in contracts.dataset_contract(d, with_time=False).filter("violations > 0").collect()}
    assert {"tot_fwd_pkts: fractional", "tot_bwd_pkts: negative", "totlen_fwd_bytes: inf", "sni_present: not 0 or 1", "transport: out of domain", "dst_port_class: out of domain", "tls_version: out of domain",
            "alpn: out of domain", "label: unknown", "flow_bytes_s: finite without duration", "ja3: missing column", "ja3s: missing column"} <= bad
    assert contracts.evaluate(d.limit(1), contracts.common_rules(d.columns) + contracts.relational_rules()).filter("violations > 0").count() == 0


def test_any_number_of_windows_without_a_match(spark, monkeypatch):
    import random

    rng = random.Random(5)
    flows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.uniform(0, 90_000)]), rng.choice([None, 0.0, 50.0, 9000.0])) for i in range(400)]
    flows += [(1000 + i, *f[1:]) for i, f in enumerate(flows[:50])]
    wins = [(rng.choice("ab"), s := rng.uniform(0, 90_000), s + rng.choice([0.0, 100.0, 5000.0])) for _ in range(60)]
    rows = spark.createDataFrame(flows, "flow_id long, label string, ts double, duration double")
    w = spark.createDataFrame(wins, "w_label string, start double, end double")

    def hit(label, ts, d, share):
        for k, s, e in wins:
            if label == k and ts is not None:
                inside = min(ts + (d or 0), e) - max(ts, s)
                if (inside > 0 and inside / d >= share) if share and d else s <= ts <= e:
                    return True
        return False

    for limit in (20_000, 10):
        monkeypatch.setattr(intervals, "BROADCAST_ROWS", limit)
        for share in (None, 0.5):
            got = sorted(r.flow_id for r in intervals.off_window(rows, w, share).collect())
            assert got == sorted(i for i, label, ts, d in flows if label is not None and not hit(label, ts, d, share))


def test_points_in_more_windows_than_are_broadcast(spark):
    import bisect
    import random

    rng = random.Random(6)
    wins = [(s := rng.uniform(0, 4e6), s + rng.choice([0.0, 5.0, 100.0, 8000.0 if rng.random() < 0.05 else 1.0])) for _ in range(21_000)]
    wins += [(7200.0, 7200.0), (50.0, 40.0)]
    at = [rng.uniform(-9000, 4.1e6) for _ in range(3000)] + [w[0] for w in wins[:200]] + [w[1] for w in wins[:200]] + [7200.0]
    order = sorted(w for w in wins if w[0] <= w[1])
    ends, most = [], 0.0
    for _, e in order:
        ends.append(most := max(most, e))
    starts = [s for s, _ in order]
    want = [(i, (k := bisect.bisect_right(starts, t)) > 0 and ends[k - 1] >= t) for i, t in enumerate(at)]
    got = intervals.in_any_window(spark.createDataFrame(list(enumerate(at)), "i long, ts double"), spark.createDataFrame(wins, "start double, end double"))
    assert sorted((r.i, r.inside) for r in got.collect()) == want
