"""Evidence of a run: captures, logs, benign sessions, bindings by digest, the sealed bundle and the verdict."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
import tarfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.parse import epoch, number
from netloom.operators import contracts, joins
from netloom.operators.contracts import Rule

PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"


@dataclass
class Check:
    """PASS, FAIL or SKIP, with what is wrong."""

    state: str
    problems: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, problems: list[str]) -> Check:
        return cls(FAIL if problems else PASS, problems)


def _count(x: object) -> bool:
    return type(x) is int and x >= 0


def _rate(x: object) -> bool:
    return type(x) in (int, float) and math.isfinite(x) and 0 <= x <= 1


def capture(end: dict | None, found: dict | None, least_packets: int = 0, max_drop: float | None = None, strict: bool = True) -> Check:
    """Whether a capture is what its closing record says.

    ``end``: tcpdump_returncode, tcpdump_stats (packets_captured, packets_received, packets_dropped,
    drop_rate), pcap (size_bytes, sha256). ``found``: size, sha256 of the file and what walking it
    gave (ok, reason, packets). The drop rate is recomputed, and that one is held against the limit.
    """
    if end is None:
        return Check(SKIP, ["no closing record"])
    stats, said = end.get("tcpdump_stats"), end.get("pcap") or {}
    s = stats or {}
    captured, received, dropped, rate = (s.get(k) for k in ("packets_captured", "packets_received", "packets_dropped", "drop_rate"))
    bad = [] if end.get("tcpdump_returncode") == 0 and type(end.get("tcpdump_returncode")) is int else [f"return code {end.get('tcpdump_returncode')}"]
    real_rate = dropped / received if _count(dropped) and _count(received) and received else rate
    if strict:
        bad += [f"{k} is missing" for k, v in (("tcpdump_stats", stats), ("packets_captured", captured), ("drop_rate", rate), ("pcap size", said.get("size_bytes")), ("pcap digest", said.get("sha256"))) if v is None]
        bad += [f"{k} is no count" for k, v in (("packets_captured", captured), ("packets_received", received), ("packets_dropped", dropped)) if v is not None and not _count(v)]
        bad += ["drop_rate is no share"] if rate is not None and not _rate(rate) else []
        if _count(received):
            bad += ["more packets captured than received"] if _count(captured) and captured > received else []
            bad += ["packets dropped where none was received"] if received == 0 and _count(dropped) and dropped else []
            if _count(dropped) and _rate(rate) and abs(rate - (dropped / received if received else 0.0)) > 1e-6:
                bad.append("drop_rate is not dropped by received")
    if found is None:
        bad.append("the capture file is missing")
    else:
        bad += [f"other {k} than recorded" for k, a, b in (("size", said.get("size_bytes"), found["size"]), ("digest", said.get("sha256"), found["sha256"])) if a is not None and a != b]
        bad += ["the capture file is empty"] if found["size"] == 0 else []
        if strict:
            bad += [] if found["ok"] else [f"no capture: {found['reason']}"]
            bad += ["other number of packets than recorded"] if found["ok"] and _count(captured) and captured != found["packets"] else []
    bad += ["too few packets"] if least_packets and (not _count(captured) or captured < least_packets) else []
    bad += ["too many packets were dropped"] if max_drop is not None and real_rate is not None and _rate(real_rate) and real_rate > max_drop else []
    return Check.of(bad)


# The logs of a run and the fields that features come from.
LOG_FIELDS = {"conn.log": ("uid", "id.orig_h", "id.resp_h", "proto", "id.resp_p"), "ssl.log": ("uid", "version", "server_name", "ja3", "ja3s", "next_protocol"), "quic.log": ("uid", "version", "server_name")}


def logs(processing: dict | None, frames: dict[str, DataFrame], profiles: dict[str, dict], scripts: list[str] | None = None, strict: bool = True) -> Check:
    """Whether the sensor's logs are there, hold what the processing record says, and fit each other.

    ``frames`` by log name as read, ``profiles`` their rows of ``sources.logs.profile``; ``scripts``
    are digests of the site script where it was found.
    """
    present = {n: profiles.get(n, {"present": False, "empty": True, "records": 0, "fields": []}) for n in LOG_FIELDS}
    if processing is None and all(p["empty"] for p in present.values()):
        return Check(SKIP, ["no processing record and no log"])
    bad = [f"{n} is missing or empty" for n, p in present.items() if p["empty"]]
    if processing is not None:
        code = processing.get("zeek_returncode")
        bad += [f"return code {code}"] if not (type(code) is int and code == 0) and (strict or code is not None) else []
        wanted = processing.get("site_script_sha256")
        bad += ["the site script is missing or another"] if wanted and wanted not in (scripts or []) else []
        if strict:
            for n, p in present.items():
                said = ((processing.get("logs") or {}).get(n) or {}).get("records")
                bad += [f"{n}: {said} records claimed, {p['records']} found"] if said != p["records"] else []
    if strict:
        for n, need in LOG_FIELDS.items():
            lacking = [c for c in need if present[n]["present"] and c not in present[n]["fields"]]
            bad += [f"{n} lacks {', '.join(lacking)}"] if lacking else []
        conn = frames.get("conn.log")
        if conn is not None and not present["conn.log"]["empty"]:
            rules = [r for r in contracts.conn_rules(conn.columns) if r.name.endswith(": blank")]
            bad += [f"conn.log: {r.rule} in {r.violations} rows" for r in contracts.evaluate(conn, rules).filter("violations > 0").collect()]
            for n in ("ssl.log", "quic.log"):
                if n in frames and "uid" in frames[n].columns and not present[n]["empty"]:
                    foreign = joins.orphans(frames[n].filter("uid is not null"), conn, "uid").limit(1).count()
                    bad += [f"{n} has uids that conn.log lacks"] if foreign else []
    return Check.of(bad)


#: Fields of a benign session, all read as text.
SESSION = ("campaign_id", "run_id", "seed", "attempt_id", "session_id", "browser", "site", "start", "end", "ok", "pages", "webdriver", "browser_name", "browser_version", "webdriver_name", "webdriver_version")
# The driver of each browser, and how short a browser's session may be.
DRIVERS = {"firefox": "geckodriver", "chrome": "chromedriver"}
LEAST_SECONDS = 0.1


def sessions(raw: DataFrame) -> DataFrame:
    """Benign sessions from JSON lines (value): the SESSION cells as JSON text, ``broken`` for lines that are no object."""
    some = raw.filter(F.trim("value") != "")
    parsed = F.from_json("value", "map<string,variant>")
    cells = some.select(F.try_parse_json("value").isNull().alias("__bad"), parsed.alias("m"))
    d = cells.select((F.col("__bad") | F.col("m").isNull()).alias("broken"), *[F.to_json(F.try_element_at("m", F.lit(c))).alias(f"j_{c}") for c in SESSION])
    plain = lambda c: F.regexp_replace(F.col(f"j_{c}"), r'^"(.*)"$', "$1")
    return d.select("broken", *[F.when(F.col(f"j_{c}") != "null", plain(c)).alias(c) for c in SESSION], *[F.col(f"j_{c}").startswith('"').alias(f"{c}_text") for c in ("start", "end", "session_id", "pages", "ok")])


def benign(found: DataFrame, policy: dict, identity: dict | None = None, window: tuple[float | None, float | None] = (None, None), packets: tuple[float, float] | None = None) -> Check:
    """Whether benign sessions (of ``sessions``) back a policy: well formed, inside the capture, each one once, enough of them successful.

    ``identity`` names what each session must carry (campaign_id, run_id, seed, attempt_id).
    ``packets`` are the times of the first and last packet: they replace the window, with 5 seconds
    to spare, and each session must touch them.
    """
    gates = policy.get("require_benign_jsonl") or policy.get("require_browser_evidence") or policy.get("min_successful_sessions") is not None or policy.get("min_success_rate") is not None
    if not gates:
        return Check(PASS)
    lo, hi = (packets[0] - 5, packets[1] + 5) if packets else window
    at = lambda c: F.when(F.col(f"{c}_text"), epoch(c)).otherwise(number(c))
    d = found.withColumns({"__s": at("start"), "__e": at("end")})
    c, none = F.col, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    whole = lambda x: ~F.coalesce(c(f"{x}_text"), F.lit(True)) & F.coalesce(c(x).rlike(r"^[1-9]\d*$"), F.lit(False))
    fine = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    rules = [
        Rule("line: no object", c("broken")), *[Rule(f"{k}: missing", ~c("broken") & c(k).isNull()) for k in SESSION[:10]], Rule("site: blank", none("site")), Rule("attempt_id: blank", none("attempt_id")),
        Rule("ok: no boolean", c("ok_text") | ~F.coalesce(c("ok").isin("true", "false"), F.lit(False))), Rule("pages: none on success", (c("ok") == "true") & ~whole("pages")), Rule("session_id: no positive number", ~whole("session_id")),
        Rule("times: not finite", ~fine(c("__s")) | ~fine(c("__e"))), Rule("times: end not after start", c("__e") <= c("__s")),
    ]
    rules += [Rule("start: before the capture", c("__s") < lo - 1e-6)] if lo is not None else []
    rules += [Rule("end: after the capture", c("__e") > hi + 1e-6)] if hi is not None else []
    rules += [Rule("times: apart from the packets", (c("__s") > packets[1]) | (c("__e") < packets[0]))] if packets else []
    rules += [Rule(f"{k}: not {v}", ~F.coalesce(c(k) == str(v), F.lit(False))) for k, v in (identity or {}).items() if v is not None]
    browsers = bool(policy.get("require_browser_evidence"))
    if browsers:
        driver = F.try_element_at(F.create_map(*[F.lit(x) for kv in DRIVERS.items() for x in kv]), F.lower(F.trim("browser_name")))
        rules += [Rule(f"{k}: blank", none(k)) for k in ("browser", "webdriver", "browser_version", "webdriver_version")]
        rules += [Rule("browser_name: unknown", driver.isNull()), Rule("webdriver_name: not the browser's", driver.isNotNull() & ~F.coalesce(F.lower(F.trim("webdriver_name")) == driver, F.lit(False))), Rule("times: too short", c("__e") - c("__s") < LEAST_SECONDS)]
    bad = [f"{r.rule} ({r.violations})" for r in contracts.evaluate(d, rules).filter("violations > 0").collect()]
    total = d.agg(F.count("*").alias("n"), F.count_if(c("ok") == "true").alias("ok")).first()
    bad += ["no session"] if not total.n else []
    again = joins.repeated_keys(d.filter("session_id is not null"), ["session_id"]).agg(F.count("*")).first()[0]
    bad += [f"{again} session id(s) come twice"] if again else []
    if browsers:
        clones = joins.repeated_keys(d, ["attempt_id", "browser", "site", "start", "end"]).agg(F.count("*")).first()[0]
        bad += [f"{clones} session(s) are copied"] if clones else []
        timed = d.filter("__s is not null and __e is not null").withColumn("__all", F.lit(1))
        meet = joins.overlaps_predecessor(timed, ["__all"], "__s", "__e").limit(1).count()  # the sessions of one client
        bad += ["sessions overlap"] if meet else []
    least, share = policy.get("min_successful_sessions"), policy.get("min_success_rate")
    bad += [f"{total.ok} successful sessions, {least} needed"] if least is not None and total.ok < least else []
    bad += [f"success rate under {share}"] if share is not None and (total.ok / total.n if total.n else 0.0) < share else []
    return Check.of(bad)


def capture_start(record: dict | None) -> list[str]:
    """What an opening record of a capture lacks."""
    if record is None:
        return ["no opening record"]
    text = lambda k: isinstance(record.get(k), str) and bool(record[k].strip())
    bad = [f"{k} is blank" for k in ("interface", "tcpdump_version") if not text(k)]
    bad += ["filter is neither text nor null"] if "filter" not in record or not (record["filter"] is None or isinstance(record["filter"], str)) else []
    seconds = record.get("duration_s")
    bad += [] if type(seconds) in (int, float) and math.isfinite(seconds) and seconds > 0 else ["duration_s is no positive number"]
    return bad + ([] if isinstance(record.get("started_utc"), str) and re.search(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$", record["started_utc"]) else ["started_utc is no time"])


def binding(run_id: int, records: dict[str, dict | None], claims: list[tuple[str, str | None, str | None]], campaign: dict | None = None, strict: bool = True) -> Check:
    """Whether all artifacts are of one run: run ids agree, and each digest that one claims is the file's.

    ``claims``: what, claimed digest, digest of the file found. ``campaign``: what the status must
    carry of the manifest (campaign_id, campaign_sha256, config_id, split). Strict, nothing may be absent.
    """
    bad = []
    for name, r in records.items():
        if r is None:
            bad += [f"{name} is missing"] if strict else []
        elif str(r.get("run_id")) != str(run_id):
            bad.append(f"{name} is of run {r.get('run_id')}")
    for what, said, real in claims:
        if said is None:
            bad += [f"{what}: no digest claimed"] if strict else []
        elif real is None:
            bad.append(f"{what}: file is missing")
        elif said.lower() != real.lower():
            bad.append(f"{what}: other digest")
    status = records.get("run_status") or {}
    outputs = list((status.get("output_hashes") or {}).values())
    bad += ["outputs are not distinct files"] if strict and len(set(outputs)) < len(outputs) else []
    if campaign is None:
        bad += ["no campaign"] if strict else []
    else:
        bad += [f"status: {k} is {status.get(k)!r}, not {v!r}" for k, v in campaign.items() if status.get(k) != v]
    if strict:
        bad += [f"capture start: {x}" for x in capture_start(records.get("capture_start"))]
    return Check.of(bad)


def overlap_gate(matched: int, fallback: int, max_rate: float | None) -> list[str]:
    """Why too many matched flows were judged by their start: the rate's ceiling, or all of them."""
    out = ["overlap_duration_fallback"] if matched > 0 and fallback == matched else []
    return out + ([f"fallback rate {fallback / matched:.4f} over {max_rate}"] if max_rate is not None and matched > 0 and fallback / matched > max_rate else [])


def overlap_pins(statuses: DataFrame, pinned: float | None, is_pinned: bool) -> list[str]:
    """Why runs were not labelled under one window rule: several values, or another than the campaign pins."""
    seen = [r[0] for r in statuses.select("min_window_overlap").distinct().limit(3).collect()]
    out = ["runs were labelled under several window rules"] if len(seen) > 1 else []
    return out + ([f"window rule {seen[0]}, not {pinned}"] if is_pinned and seen and any(v != pinned for v in seen) else [])


def verdict(required_missing: list[str], status: Check, semantics: dict[str, Check], status_diagnostic: bool, diagnostic: bool) -> dict:
    """PASS or FAIL and whether it is official: what was skipped passes, and a diagnostic status, only in a diagnostic seal."""
    fine = lambda c: c.state == PASS or (c.state == SKIP and diagnostic)
    good = not required_missing and fine(status) and all(map(fine, semantics.values())) and (diagnostic or not status_diagnostic)
    return {
        "overall": PASS if good else FAIL, "official": good and not diagnostic, "status_is_diagnostic": status_diagnostic, "required_missing": sorted(required_missing),
        "semantics": {n: {"state": c.state, "problems": c.problems} for n, c in semantics.items()}, "status_validation": {"state": status.state, "problems": status.problems},
    }


def verdict_mismatches(derived: dict, recorded: dict) -> list[str]:
    """Fields in which a recorded verdict is not the one that the artifacts give."""
    out = [k for k in ("overall", "official", "status_is_diagnostic", "required_missing") if derived.get(k) != recorded.get(k)]
    states = lambda v: {n: c.get("state") for n, c in (v.get("semantics") or {}).items()}
    return out + (["semantics"] if states(derived) != states(recorded) else [])


def roll_up(checks: list[tuple[str, str, bool]]) -> dict:
    """Of checks (name, state, required): ok unless a required one failed, and the names that failed or were skipped."""
    failed = [n for n, s, required in checks if s == FAIL and required]
    return {"ok": not failed, "failed": failed, "warnings": [n for n, s, required in checks if s == FAIL and not required], "skipped": [n for n, s, _ in checks if s == SKIP]}


def provenance(manifest_sha256: str | None, inputs: dict[str, str], outputs: dict[str, str], counts: dict, duplicates: dict, reasons: list[str], overrides: dict) -> dict:
    """The record of a merge: digests, counts, what was overridden, and whether it is official."""
    return {
        "campaign_sha256": manifest_sha256, "inputs": dict(sorted(inputs.items())), "outputs": dict(sorted(outputs.items())), "class_counts": counts, "duplicates": duplicates,
        "overrides": {k: v for k, v in sorted(overrides.items()) if v}, "diagnostic_reasons": sorted({*reasons, *(k for k, v in overrides.items() if v)}), "official": not reasons and not any(overrides.values()),
    }


EXIT = {"ok": 0, "integrity": 2, "release": 3}


def verdict_record(name: str, integrity: list[str], release: list[str] | None = None, measures: dict | None = None) -> tuple[dict, int]:
    """A verdict as one JSON object, and the exit code that says it; what was not measured (no finite number) fails closed, as null."""
    clean = {k: (v if not isinstance(v, float) or math.isfinite(v) else None) for k, v in (measures or {}).items()}
    integrity = [*integrity, *[f"{k} is no number" for k, v in (measures or {}).items() if isinstance(v, float) and not math.isfinite(v)]]
    state = "integrity" if integrity else "release" if release else "ok"
    return {"name": name, "verdict": {"ok": PASS, "integrity": FAIL, "release": "NOT_RELEASABLE"}[state], "reasons": [*integrity, *(release or [])], "measures": clean}, EXIT[state]


def seed_rows(runs: list[dict], by: list[str], metrics: list[str]) -> list[dict]:
    """Rows of a summary file: one a seed, then one a group with ``mean ± deviation`` (of the population) as text."""
    out = [{**{k: r[k] for k in [*by, "seed"]}, **{m: r[m] for m in metrics}} for r in runs]
    for key in dict.fromkeys(tuple(r[k] for k in by) for r in runs):
        mine = [r for r in runs if tuple(r[k] for k in by) == key]
        row = dict(zip(by, key, strict=True)) | {"seed": "all"}
        for m in metrics:
            mean = sum(r[m] for r in mine) / len(mine)
            row[m] = f"{mean:.6f} ± {math.sqrt(sum((r[m] - mean) ** 2 for r in mine) / len(mine)):.6f}"
        out.append(row)
    return out


def generator_record(arguments: dict, sha256: str, class_counts: dict[str, int]) -> dict:
    """What stands beside a generated file: arguments, digest, rows by class."""
    return {"arguments": dict(sorted(arguments.items())), "sha256": sha256, "class_counts": dict(sorted(class_counts.items())), "rows": sum(class_counts.values()), "synthetic": True}


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def write_bundle(folder: str, names: list[str], out: str, manifest: str, hashes: str) -> dict:
    """Seal files of a run as a tar: the manifest with their digests and sizes, the digests alone, and the files; returns digests of bundle and manifest."""
    inventory = [{"path": n, "sha256": sha256_of(f"{folder}/{n}"), "size": os.path.getsize(f"{folder}/{n}")} for n in sorted(names)]
    texts = {manifest: json.dumps({"inventory": inventory}, sort_keys=True, indent=2), hashes: json.dumps({d["path"]: d["sha256"] for d in inventory}, sort_keys=True, indent=2)}
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    with tarfile.open(out, "w:gz") as tar:
        for n in [*sorted(names), manifest, hashes]:
            tar.add(f"{folder}/{n}", arcname=n)
    return {"bundle_sha256": sha256_of(out), "manifest_sha256": sha256_of(f"{folder}/{manifest}")}


def verify_bundle(out: str, sealed: dict, manifest: str, hashes: str) -> list[str]:
    """What is wrong with a sealed bundle: its digest, unsafe, repeated, missing or other members, digests of members."""
    try:
        if sha256_of(out) != sealed["bundle_sha256"]:
            return ["the bundle has another digest"]
        with tarfile.open(out, "r:gz") as tar:
            members = tar.getmembers()
            names = [m.name for m in members]
            bad = [f"unsafe member {n}" for n in names if n.startswith("/") or ".." in n.replace("\\", "/").split("/")]
            bad += [f"{m.name} is no file" for m in members if not m.isfile()]
            bad += ["members come twice"] if len(set(names)) < len(names) else []
            if bad:
                return bad
            digest = {}
            for m in members:
                h, f = hashlib.sha256(), tar.extractfile(m)
                while piece := f.read(1 << 20):
                    h.update(piece)
                digest[m.name] = h.hexdigest()
            if manifest not in digest or digest[manifest] != sealed["manifest_sha256"]:
                return ["the manifest is missing or another"]
            wanted = {d["path"]: d["sha256"] for d in json.loads(tar.extractfile(manifest).read())["inventory"]}
            bad += [] if hashes in digest and json.loads(tar.extractfile(hashes).read()) == wanted else ["the digests differ from the manifest's"]
            rest = {n: d for n, d in digest.items() if n not in (manifest, hashes)}
            bad += [f"{n}: missing" for n in sorted(wanted.keys() - rest.keys())] + [f"{n}: not in the manifest" for n in sorted(rest.keys() - wanted.keys())]
            return bad + [f"{n}: other digest" for n in sorted(wanted.keys() & rest.keys()) if wanted[n] != rest[n]]
    except (tarfile.TarError, OSError, ValueError, KeyError) as e:
        return [f"no valid bundle: {e}"]


def drive(runs: list[int], run_one: Callable[[int], bool], sealed: Callable[[int], bool], analyse: Callable[[], bool], resume: bool = False, diagnostic: bool = False) -> dict:
    """A campaign's runs in order of their number, then the analysis.

    With ``resume`` runs that are sealed and verify are passed over. The first failure stops an
    official campaign; a diagnostic one goes on. Only a campaign all of whose runs succeeded is
    analysed, and complete.
    """
    state: dict[int, str] = {}
    for run in sorted(runs):
        if resume and sealed(run):
            state[run] = "resumed"
            continue
        state[run] = "ok" if run_one(run) else "failed"
        if state[run] == "failed" and not diagnostic:
            break
    done = all(state.get(r) in ("ok", "resumed") for r in runs)
    analysed = done and analyse()
    return {"runs": {r: state.get(r, "not run") for r in sorted(runs)}, "state": "COMPLETE" if analysed else "FAILED", "analysed": analysed}
