import hashlib
import json

import pytest

from netloom.__main__ import main, parser


def test_arguments():
    for bad in ("nan", "2", "-0.1", "x"):
        with pytest.raises(SystemExit):
            parser().parse_args(["label", "--logs", "x", "--annotations", "x", "--out", "x", "--run-id", "1", "--min-overlap", bad])
    assert parser().parse_args(["audit", "--file", "x"]).top == 15


def test_digests(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_text("a")
    good = f"{hashlib.sha256(b'a').hexdigest()}  a\n"
    (tmp_path / "m").write_text(good)
    assert main(["hashes", "--folder", f"{tmp_path}/d", "--manifest", f"{tmp_path}/m"]) == 0
    (tmp_path / "m2").write_text(good + "0" * 64 + "  gone\n")
    assert main(["hashes", "--folder", f"{tmp_path}/d", "--manifest", f"{tmp_path}/m2"]) == 2
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["problems"] == [{"path": "gone", "status": "missing"}]


def test_shortcuts(spark, tmp_path, capsys):
    rows = [f"{i % 7},{'x' if i % 2 else 'y'},{'DoS' if i % 2 else 'BENIGN'}" for i in range(400)]
    (tmp_path / "a.csv").write_text("n,k,label\n" + "\n".join(rows) + "\n")
    assert main(["audit", "--file", f"{tmp_path}/a.csv"]) == 3
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["verdict"] == "shortcut" and out["columns"][0]["feature"] == "k" and out["tree"] == 1.0


def test_a_run_is_labelled_once(spark, tmp_path, capsys):
    head = "#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\torig_pkts\tresp_pkts\n"
    (tmp_path / "conn.log").write_text(head + "100.5\tu1\t10.0.0.2\t5000\t10.0.0.1\t443\ttcp\t1\t10\t10\t2\t2\n200.0\tu2\t10.0.0.3\t5000\t10.0.0.1\t443\ttcp\t1\t10\t10\t2\t2\n")
    (tmp_path / "a.csv").write_text("event_id,run_id,label,attacker_ip,target_ip,protocol,target_port,start_utc,end_utc,tool,command,return_code,status\n"
                                    "e,1,BruteForce,10.0.0.2,10.0.0.1,tcp,443,1970-01-01T00:01:40Z,1970-01-01T00:02:00Z,hydra,hydra x,0,success\n")  # fmt: skip
    args = ["label", "--logs", str(tmp_path), "--annotations", f"{tmp_path}/a.csv", "--out", f"{tmp_path}/out", "--run-id", "1", "--min-overlap", "0.5"]
    assert main(args) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["class_counts"] == {"BENIGN": 1, "BruteForce": 1}
    assert main(args) == 2 and "out" in json.loads(capsys.readouterr().out.splitlines()[-1])["problems"][0]
