"""A campaign: its manifest and policy, the merge of its runs into splits, and the release verdict."""

from __future__ import annotations

import ipaddress
import json
import math
import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions.parse import key_values
from netloom.operators import contracts, duplicates, intervals, joins, splits
from netloom.operators.contracts import Rule

# The policy's fields by kind, with the strict profile.
FLAGS = ("use_failed", "allow_empty", "allow_overlapping_windows", "ignore_annotation_campaign", "require_ip_bytes", "require_ssl_log", "require_quic_log")
SHARES = ("min_port_coverage", "min_ssl_join_rate", "min_quic_join_rate")
COUNTS = ("min_matches_per_event", "window_padding_ms")
CEILINGS = ("window_padding_ms",)
STRICT = {"use_failed": False, "allow_empty": False, "ambiguous_policy": "drop", "allow_overlapping_windows": False, "ignore_annotation_campaign": False, "min_matches_per_event": 1, "min_port_coverage": 0.8,
          "require_ip_bytes": True, "require_ssl_log": True, "require_quic_log": True, "min_ssl_join_rate": 0.8, "min_quic_join_rate": 0.8, "window_padding_ms": 0}
SPLITS = ("train", "validation", "test")


class ManifestError(ValueError):
    """A manifest or policy that breaks its rules."""


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ManifestError(message)


def _number(x: object) -> float | None:
    if isinstance(x, bool) or not isinstance(x, int | float | str):
        return None
    try:
        return float(x) if math.isfinite(float(x)) else None
    except ValueError:
        return None


def check_policy_shape(policy: object) -> None:
    """A policy has exactly the known fields, flags being real booleans and numbers finite."""
    _check(isinstance(policy, dict) and set(policy) == set(STRICT), "the policy's fields are not the official ones")
    for k in FLAGS:
        _check(type(policy[k]) is bool, f"{k} is no boolean")
    for k in SHARES:
        v = policy[k]
        _check(type(v) in (int, float) and math.isfinite(v) and 0 <= v <= 1, f"{k} is no share")
    for k in COUNTS:
        _check(type(policy[k]) is int and policy[k] >= 0, f"{k} is no count")
    _check(policy["ambiguous_policy"] in ("drop", "keep"), "ambiguous_policy is neither drop nor keep")


def policy_violations(observed: dict, required: dict) -> list[tuple[str, object, str]]:
    """Fields in which the observed policy is laxer than the required one: floors, ceilings, else equal in value and type."""
    out = []
    for k, want in required.items():
        have = observed.get(k)
        if k in CEILINGS or k in SHARES or k in COUNTS:
            n = _number(have)
            met = n is not None and (n <= float(want) if k in CEILINGS else n >= float(want))
            sign = "<=" if k in CEILINGS else ">="
        else:
            met, sign = type(have) is type(want) and have == want, "="
        if not met:
            out.append((k, have, f"{sign} {want}"))
    return out


def loosened(policy: dict) -> list[str]:
    """Fields of a policy that are laxer than the strict profile."""
    return sorted(k for k, _, _ in policy_violations(policy, STRICT))


def load_manifest(text: str, reserved: tuple[int, ...] = (), configs: int | None = None, reproducible: bool = False) -> dict:
    """A manifest that holds together: ids, labels, splits, days in order, test configs unseen elsewhere."""
    m = json.loads(text)
    _check(isinstance(m, dict), "the manifest is no object")
    _check(isinstance(m.get("campaign_id"), str) and re.fullmatch(r"[A-Za-z0-9._-]+", m["campaign_id"]) is not None, "campaign_id is no safe name")
    labels = m.get("expected_labels")
    _check(isinstance(labels, list) and bool(labels) and len(set(map(str, labels))) == len(labels), "expected_labels is empty or has repeats")
    _check(set(labels) <= set(ft.LABELS), "expected_labels has unknown labels")
    if "reserved_test_configs" in m:
        _check(isinstance(m["reserved_test_configs"], list) and set(m["reserved_test_configs"]) == set(reserved), "reserved_test_configs differ from the code's")
    runs = m.get("runs")
    _check(isinstance(runs, dict) and bool(runs), "runs is empty")
    used: dict[str, set[int]] = {s: set() for s in SPLITS}
    days: dict[str, list[str]] = {s: [] for s in SPLITS}
    for name, spec in runs.items():
        _check(re.fullmatch(r"0|[1-9]\d*", name) is not None, f"run id {name!r} is no plain number")
        _check(isinstance(spec, dict) and spec.get("split") in SPLITS, f"run {name} has no known split")
        config, seed, day = spec.get("config_id"), spec.get("seed"), spec.get("day")
        _check(type(config) is int and config >= 0 and (configs is None or config < configs), f"run {name} has no known config")
        _check(config not in reserved or spec["split"] == "test", f"run {name} uses a config reserved for tests")
        _check(seed is None or (type(seed) is int and seed >= 0), f"run {name} has a bad seed")
        if day is not None:
            try:
                date.fromisoformat(str(day))
            except ValueError:
                raise ManifestError(f"run {name} has no ISO day") from None
            days[spec["split"]].append(str(day))
        used[spec["split"]].add(config)
    _check(bool(used["train"]) and bool(used["test"]), "train or test has no run")
    _check(not used["test"] & (used["train"] | used["validation"]), "a config is in test and elsewhere")
    for a, b in (("train", "test"), ("train", "validation"), ("validation", "test")):
        _check(not days[a] or not days[b] or max(days[a]) <= min(days[b]), f"days of {a} lie after {b}")
    _check_attacks(runs, labels)
    _check_policies(m)
    if reproducible:
        for name, spec in runs.items():
            _check_reproducible(name, spec)
    return m


def _check_attacks(runs: dict, labels: list) -> None:
    """What runs plan must be attacks that the campaign expects, and all of them if every run has a plan."""
    planned: set[str] = set()
    for name, spec in runs.items():
        attacks = spec.get("attacks")
        if attacks is None:
            continue
        _check(isinstance(attacks, list) and bool(attacks), f"run {name} has an empty plan")
        _check(len(set(map(str, attacks))) == len(attacks), f"run {name} plans an attack twice")
        _check(all(a in ft.LABELS and a != "BENIGN" for a in attacks), f"run {name} plans what is no attack")
        _check(set(attacks) <= set(labels), f"run {name} plans what the campaign does not expect")
        planned |= set(attacks)
    if all(spec.get("attacks") is not None for spec in runs.values()):
        _check(set(labels) - {"BENIGN"} <= planned, "an expected attack is planned by no run")


def _share(x: object, top: float = 1.0) -> bool:
    return type(x) in (int, float) and math.isfinite(x) and 0 <= x <= top


def _positive(x: object) -> bool:
    return type(x) is int and x >= 1


# Fields of the release and the benign policy.
RELEASE_LIMITS = {"max_domain_auc": 1.0, "max_mean_js": 1.0, "max_cat_js": 1.0, "max_cond_js": 1.0, "max_missing_rate_difference": 1.0, "min_tstr_reference_ratio": 1e6, "min_reference_f1": 1.0}
RELEASE_OTHERS = ("min_overall_realism_quality", "min_domain_test_samples_per_class")
BENIGN_FLAGS = ("require_benign_jsonl", "require_browser_evidence")
BENIGN_FIELDS = ("min_benign_flows", "min_successful_sessions", "min_success_rate", *BENIGN_FLAGS)
PROFILES = {"strict": STRICT}


def _check_policies(m: dict) -> None:
    """The optional policies of a manifest; a profile's name is replaced by its fields."""
    if m.get("required_policy_profile") is not None:
        _check(m["required_policy_profile"] in PROFILES, "required_policy_profile is unknown")
        _check("required_labeling_policy" not in m, "a profile and a policy are both given")
        m["required_labeling_policy"] = dict(PROFILES[m["required_policy_profile"]])
    if "required_labeling_policy" in m:
        check_policy_shape(m["required_labeling_policy"])
    if "benign_quality_policy" in m:
        p = m["benign_quality_policy"]
        _check(isinstance(p, dict) and set(p) <= set(BENIGN_FIELDS), "benign_quality_policy has unknown fields")
        _check(_positive(p.get("min_benign_flows")), "min_benign_flows is no positive number")
        _check(p.get("min_successful_sessions") is None or _positive(p["min_successful_sessions"]), "min_successful_sessions is no positive number")
        _check(p.get("min_success_rate") is None or _share(p["min_success_rate"]), "min_success_rate is no share")
        _check(all(p.get(k) is None or type(p[k]) is bool for k in BENIGN_FLAGS), "a flag of benign_quality_policy is no boolean")
    for k in ("max_cross_split_duplicate_rate", "max_domain_auc", "max_duration_fallback_rate"):
        _check(k not in m or _share(m[k]), f"{k} is no share")
    _check(m.get("required_min_window_overlap") is None or _share(m["required_min_window_overlap"]), "required_min_window_overlap is no share")
    _check("max_duration_fallback_rate" not in m or m.get("required_min_window_overlap") is not None, "max_duration_fallback_rate needs a window overlap")
    _check("min_overall_realism_quality" not in m, "min_overall_realism_quality belongs in release_quality_policy")
    _check("min_domain_test_samples_per_class" not in m or _positive(m["min_domain_test_samples_per_class"]), "min_domain_test_samples_per_class is no positive number")
    if "release_quality_policy" in m:
        p = m["release_quality_policy"]
        _check(isinstance(p, dict) and set(p) == {*RELEASE_LIMITS, *RELEASE_OTHERS}, "release_quality_policy has not all its fields, or others")
        _check(not any(k in m for k in ("max_domain_auc", "min_domain_test_samples_per_class")), "a release limit is given twice")
        for k, top in RELEASE_LIMITS.items():
            _check(_share(p[k], top), f"{k} is out of range")
        _check(p["min_overall_realism_quality"] in ("moderate", "strong"), "min_overall_realism_quality is neither moderate nor strong")
        _check(_positive(p["min_domain_test_samples_per_class"]), "min_domain_test_samples_per_class is no positive number")


def _check_reproducible(name: str, spec: dict) -> None:
    """What a run needs so that it can be made again."""
    _check(spec.get("seed") is not None and spec.get("day") is not None, f"run {name} lacks seed or day")
    _check(isinstance(spec.get("attacks"), list) and bool(spec["attacks"]), f"run {name} has no plan")
    addresses = {}
    for k in ("target_ip", "attacker_ip"):
        try:
            addresses[k] = ipaddress.IPv4Address(str(spec.get(k) or "").strip())
        except ValueError:
            raise ManifestError(f"run {name}: {k} is no IPv4 address") from None
    _check(addresses["target_ip"] != addresses["attacker_ip"], f"run {name}: attacker and target are one")
    host = str(spec.get("target_host") or "").strip()
    _check(0 < len(host) <= 253 and all(re.fullmatch(r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?", x) for x in host.split(".")), f"run {name}: target_host is no host name")
    _check(_positive(spec.get("timeout")), f"run {name}: timeout is no positive number")
    if "DoS" in spec["attacks"]:
        _check(_positive(spec.get("dos_seconds")), f"run {name}: dos_seconds is no positive number")
    if "BruteForce" in spec["attacks"] and spec.get("wordlists_pinned") is not False:
        _check(all(re.fullmatch(r"[0-9a-fA-F]{64}", str(spec.get(k) or "")) for k in ("userlist_sha256", "passlist_sha256")), f"run {name}: word lists are not pinned")


def manifest_runs(spark: SparkSession, manifest: dict) -> DataFrame:
    """(run_id, config_id, split, seed, day, attacks, target_ip, attacker_ip): one row a run."""
    rows = [(int(k), r["config_id"], r["split"], r.get("seed"), r.get("day"), r.get("attacks") or [], r.get("target_ip"), r.get("attacker_ip")) for k, r in manifest["runs"].items()]
    return spark.createDataFrame(rows, "run_id int, config_id int, split string, seed long, day string, attacks array<string>, target_ip string, attacker_ip string")


def annotation_plan_gaps(annotations: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, label, side): attacks that are planned and not annotated, or the other way round, and rows that name other hosts."""
    plan = runs.select("run_id", F.explode("attacks").alias("label"), "target_ip", "attacker_ip")
    seen = annotations.select(F.col("run_id").try_cast("int").alias("run_id"), "label", F.col("target_ip").alias("t"), F.col("attacker_ip").alias("a"))
    j = plan.join(seen, ["run_id", "label"], "full_outer")
    side = F.when(F.col("t").isNull() & F.col("a").isNull(), "missing").when(F.col("target_ip").isNull() & F.col("attacker_ip").isNull(), "unplanned").when(~(F.col("t").eqNullSafe(F.col("target_ip")) & F.col("a").eqNullSafe(F.col("attacker_ip"))), "other hosts")
    return j.select("run_id", "label", side.alias("side")).filter("side is not null").distinct()


def annotation_campaign_gaps(annotations: DataFrame, runs: DataFrame, plan: DataFrame, campaign_id: str, campaign_sha256: str, complete: bool = True) -> DataFrame:
    """(event_id, field): cells of annotation rows that are not what the campaign says.

    Each row must name the campaign, its digest, and the run's config and split, and hit the hosts
    that the run pins. ``plan``: run_id, label, protocol, tool, target_port, argv (null where any
    path may stand), parameters (a map). The command's structured arguments must be there, be of
    the plan's tool and number, be no flag where any path may stand, and join to the written command
    as a shell would quote them; with ``complete`` they and the parameters must be the planned ones.
    """
    r = runs.select(F.col("run_id").alias("__run"), *[F.col(c).alias(f"__{c}") for c in ("config_id", "split", "target_ip", "target_host", "attacker_ip")])
    p = plan.select(F.col("run_id").alias("__prun"), F.col("label").alias("__plabel"), *[F.col(c).alias(f"__p_{c}") for c in ("protocol", "tool", "target_port", "argv", "parameters")])
    a = annotations.withColumn("__id", F.trim("run_id").try_cast("int"))
    d = a.join(r, F.col("__id") == F.col("__run"), "left").join(p, (F.col("__id") == F.col("__prun")) & (F.trim("label") == F.col("__plabel")), "left")
    cell = lambda c: F.coalesce(F.trim(c), F.lit(""))
    argv = F.from_json("command_argv", "array<string>")
    tool = lambda x: F.lower(F.regexp_extract(x, r"([^/]*)$", 1))
    known, planned = F.col("__run").isNotNull(), F.col("__p_argv").isNotNull()
    same_size = F.size(argv) == F.size("__p_argv")
    # A place of the plan that is null may hold any path: something that is there and is no flag.
    wild = F.exists(F.arrays_zip(argv.alias("a"), F.col("__p_argv").alias("b")), lambda z: z["b"].isNull() & ((F.coalesce(z["a"], F.lit("")) == "") | F.coalesce(z["a"], F.lit("")).startswith("-")))
    other = F.exists(F.arrays_zip(argv.alias("a"), F.col("__p_argv").alias("b")), lambda z: z["b"].isNotNull() & ~z["a"].eqNullSafe(z["b"]))
    pinned = lambda c, m: F.coalesce(F.col(f"__{m}"), F.lit("")).isin("") | (cell(c) == F.col(f"__{m}"))
    bad = [
        ("run_id", ~known), ("campaign_id", cell("campaign_id") != campaign_id), ("campaign_sha256", cell("campaign_sha256") != campaign_sha256),
        ("config_id", known & (cell("config_id") != F.col("__config_id").cast("string"))), ("split", known & (cell("split") != F.col("__split"))),
        ("target_ip", known & ~pinned("target_ip", "target_ip")), ("target_hostname", known & ~pinned("target_hostname", "target_host")), ("attacker_ip", known & ~pinned("attacker_ip", "attacker_ip")),
        *[(c, planned & (F.lower(cell(c)) != F.col(f"__p_{c}"))) for c in ("protocol", "target_port")], ("tool", planned & (tool(cell("tool")) != tool(F.col("__p_tool")))),
        ("command_argv", planned & (argv.isNull() | F.exists(argv, lambda x: x.isNull()) | ~same_size | (tool(F.get(argv, F.lit(0))) != tool(F.get("__p_argv", F.lit(0)))) | wild)),
        ("command", planned & (cell("command") != "") & (F.col("command") != shell_joined(argv))),
    ]
    if complete:
        bad += [("command_argv value", planned & argv.isNotNull() & F.coalesce(same_size & other, F.lit(False))), ("parameters", F.col("__p_parameters").isNotNull() & ~same_maps(key_values("parameters"), F.col("__p_parameters")))]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in bad]))
    return d.select(F.col("event_id"), F.explode(found).alias("field"))


def same_maps(a: Column, b: Column) -> Column:
    """Whether two maps hold the same entries; null is no map."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return F.coalesce(entries(a) == entries(b), F.lit(False))


def shell_joined(argv: Column) -> Column:
    """Arguments as one command line, quoted where a shell needs it."""
    quote = lambda x: F.when(x == "", "''").when(x.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    return F.array_join(F.transform(argv, quote), " ")


STATUS = (
    "attempt_id string, code_version string, status_schema_version string, status string, run_id int, split_ready_sha256 string, campaign_id string, campaign_sha256 string, config_id int, split string, "
    "labeling_policy struct<use_failed:boolean, allow_empty:boolean, ambiguous_policy:string, allow_overlapping_windows:boolean, ignore_annotation_campaign:boolean, min_matches_per_event:int, min_port_coverage:double, require_ip_bytes:boolean, require_ssl_log:boolean, require_quic_log:boolean, min_ssl_join_rate:double, min_quic_join_rate:double, window_padding_ms:int>, "
    "diagnostic boolean, diagnostic_reasons array<string>, min_window_overlap double, overlap_accounting struct<matched_flows:bigint, duration_fallback_flows:bigint>, "
    "ssl_join struct<records:bigint, records_matching_conn:bigint, orphan_records:bigint, missing_uid_records:bigint, join_rate:double>, quic_join struct<records:bigint, records_matching_conn:bigint, orphan_records:bigint, missing_uid_records:bigint, join_rate:double>, "
    "ip_bytes_fallback bigint, flows_written_ml bigint, flows_audit bigint, flows_dropped_ambiguous bigint, class_counts_split_ready map<string,bigint>, input_hashes map<string,string>, output_hashes map<string,string>, files map<string,string>, "
    "events map<string,struct<label:string, usable_flows:bigint, matched_flows:bigint, ambiguous_flows:bigint, unique_dst_ports:bigint, port_range_width:bigint, port_coverage:double, first_match:double, last_match:double, window_start:double, window_end:double>>, "
    "annotation_scenario_version string, annotation_orchestrator_version string"
)


def parse_statuses(texts: DataFrame) -> DataFrame:
    """Run statuses from their JSON texts (text); a text that is no such object is an error."""
    return texts.select(F.from_json("text", STATUS, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def status_events(statuses: DataFrame) -> DataFrame:
    """One row for each event of each run status (run_id, labeling_policy, events map)."""
    return statuses.select("run_id", F.col("labeling_policy.allow_overlapping_windows").alias("overlapping"), F.explode("events").alias("event_id", "e")).select("run_id", "overlapping", "event_id", "e.*")


def event_rules() -> list[Rule]:
    """What the counters of an event must fulfil among themselves."""
    c = F.col
    counters = ("usable_flows", "matched_flows", "ambiguous_flows", "unique_dst_ports", "port_range_width")
    both = c("usable_flows") + c("ambiguous_flows")
    ordered = (c("window_start") <= c("first_match")) & (c("first_match") <= c("last_match")) & (c("last_match") <= c("window_end"))
    return [
        *[Rule(f"{k}: missing or negative", c(k).isNull() | (c(k) < 0)) for k in counters],
        Rule("port_range_width: under 1", c("port_range_width") < 1), Rule("unique_dst_ports: none for matches", (c("matched_flows") > 0) & (c("unique_dst_ports") < 1)),
        Rule("usable and ambiguous: over matched", both > c("matched_flows")), Rule("usable and ambiguous: not matched", ~F.coalesce(c("overlapping"), F.lit(False)) & (both != c("matched_flows"))),
        Rule("unique_dst_ports: over matched or width", (c("unique_dst_ports") > c("matched_flows")) | (c("unique_dst_ports") > c("port_range_width"))),
        Rule("label: no attack", ~F.coalesce(c("label").isin(*[x for x in ft.LABELS if x != "BENIGN"]), F.lit(False))),
        Rule("port_coverage: not ports by width", ~F.coalesce(F.abs(c("port_coverage") - c("unique_dst_ports") / F.greatest("port_range_width", F.lit(1))) <= 1.5e-4, F.lit(False))),
        Rule("times: out of order", ~F.coalesce(ordered, F.lit(False))),
    ]


def status_rules(columns: list[str] | None = None, versions: dict[str, list[str]] | None = None) -> list[Rule]:
    """What a run status must fulfil as a whole: join blocks close, flows add up, reasons match the verdict.

    With the ``columns`` of a full status (and the ``versions`` that are supported, by field) the
    rules of an official one come too.
    """
    c = F.col
    rules = [Rule("status: not success", ~F.coalesce(c("status") == "success", F.lit(False))), Rule("split_ready_sha256: no digest", ~F.coalesce(c("split_ready_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))]
    for block in ("ssl_join", "quic_join"):
        b = lambda k, block=block: c(f"{block}.{k}")
        rate = F.when(b("records") > 0, b("records_matching_conn") / b("records")).otherwise(0.0)
        rules += [
            Rule(f"{block}: does not close", ~F.coalesce(b("records_matching_conn") + F.coalesce(b("orphan_records"), F.lit(0)) + F.coalesce(b("missing_uid_records"), F.lit(0)) == b("records"), F.lit(False))),
            Rule(f"{block}: rate is off", ~F.coalesce(F.abs(b("join_rate") - rate) <= 1.5e-4, F.lit(False))),
        ]
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x)
    rules += [
        Rule("flows: audit is not written plus dropped", ~F.coalesce(c("flows_audit") == c("flows_written_ml") + c("flows_dropped_ambiguous"), F.lit(False))),
        Rule("class counts: not what was written", ~F.coalesce(total("class_counts_split_ready") == c("flows_written_ml"), F.lit(False))),
        Rule("diagnostic: not what the reasons say", ~F.coalesce(c("diagnostic") == (F.size("diagnostic_reasons") > 0), F.lit(False))),
    ]
    return rules if columns is None else rules + official_status_rules(columns, versions or {})


def official_status_rules(columns: list[str], versions: dict[str, list[str]]) -> list[Rule]:
    """What an official status must fulfil beyond its sums: identity, digests, gates of its own policy, overlap accounting, evidence for each class."""
    c = F.col
    p = lambda k: c(f"labeling_policy.{k}")
    none = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    digest = lambda x: F.coalesce(x.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    of = lambda m, k: F.try_element_at(c(m), F.lit(k))
    keys = lambda m, names: F.coalesce(F.array_sort(F.map_keys(m)) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))
    events = F.map_values("events")
    flat = ~F.coalesce(p("allow_overlapping_windows"), F.lit(False))
    matched = F.aggregate(events, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["matched_flows"], F.lit(0)))
    most = F.coalesce(F.array_max(F.transform(events, lambda e: e["matched_flows"])), F.lit(0))
    mine, fell, overlap = c("overlap_accounting.matched_flows"), c("overlap_accounting.duration_fallback_flows"), c("min_window_overlap")
    attacks = F.map_filter("class_counts_split_ready", lambda k, v: k.isin(*[x for x in ft.LABELS if x != "BENIGN"]))
    usable = lambda k: F.aggregate(F.filter(events, lambda e: e["label"] == k), F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["usable_flows"], F.lit(0)))
    told = F.array_distinct(F.transform(events, lambda e: e["label"]))
    hidden = [F.when(loose, name) for name, loose in _loose(p).items()]
    rules = [
        *[Rule(f"{k}: blank", none(k)) for k in ("attempt_id", "code_version", "campaign_id")], Rule("campaign_sha256: no digest", ~digest(c("campaign_sha256"))),
        Rule("run_id: not whole", c("run_id").isNull() | (c("run_id") < 0)), Rule("config_id: not whole", c("config_id").isNull() | (c("config_id") < 0)), Rule("split: unknown", ~F.coalesce(c("split").isin(*SPLITS), F.lit(False))),
        Rule("input_hashes: not conn, ssl, quic and annotations", ~keys("input_hashes", ("conn", "ssl", "quic", "annotations")) | ~digest(of("input_hashes", "conn")) | ~digest(of("input_hashes", "annotations"))),
        Rule("output_hashes: not ml, split_ready and audit", ~keys("output_hashes", ("ml", "split_ready", "audit")) | F.exists(F.map_values("output_hashes"), lambda x: ~digest(x))),
        Rule("output_hashes: other split_ready", ~F.coalesce(of("output_hashes", "split_ready") == c("split_ready_sha256"), F.lit(False))),
        Rule("files: not ml, split_ready and audit", ~keys("files", ("ml", "split_ready", "audit")) | F.exists(F.map_values("files"), none)),
        Rule("class counts: empty or negative", F.coalesce((F.size("class_counts_split_ready") < 1) | F.exists(F.map_values("class_counts_split_ready"), lambda x: x.isNull() | (x < 0)), F.lit(True))),
        Rule("diagnostic_reasons: a loosened gate is hidden", F.size(F.array_except(F.array_compact(F.array(*hidden)), F.coalesce("diagnostic_reasons", F.array().cast("array<string>")))) > 0),
        Rule("ip_bytes_fallback: against the policy", p("require_ip_bytes") & (c("ip_bytes_fallback") != 0)), Rule("ip_bytes_fallback: missing or negative", c("ip_bytes_fallback").isNull() | (c("ip_bytes_fallback") < 0)),
        *[Rule(f"{k}_join: against the policy", p(f"require_{k}_log") & ((F.coalesce(c(f"{k}_join.records_matching_conn"), F.lit(0)) <= 0) | (F.coalesce(c(f"{k}_join.join_rate"), F.lit(-1.0)) < p(f"min_{k}_join_rate")) | ~digest(of("input_hashes", k)))) for k in ("ssl", "quic")],
        Rule("events: too few usable flows", F.exists(events, lambda e: F.coalesce(e["usable_flows"], F.lit(-1)) < p("min_matches_per_event"))),
        Rule("events: too few ports", F.exists(events, lambda e: (e["port_range_width"] > 1) & (F.coalesce(e["port_coverage"], F.lit(-1.0)) < p("min_port_coverage")))),
        Rule("min_window_overlap: no share", (overlap < 0) | (overlap > 1)), Rule("overlap_accounting: missing or negative", mine.isNull() | fell.isNull() | (mine < 0) | (fell < 0)),
        Rule("overlap_accounting: fallback over matched", fell > mine), Rule("overlap_accounting: matched over audit", mine > c("flows_audit")), Rule("overlap_accounting: matches without overlap", overlap.isNull() & (mine != 0)),
        Rule("overlap_accounting: not the events'", overlap.isNotNull() & F.when(flat, mine != matched).otherwise((mine < most) | (mine > matched))),
        Rule("overlap_accounting: all fell back", overlap.isNotNull() & (mine > 0) & (fell == mine) & ~F.array_contains(F.coalesce("diagnostic_reasons", F.array().cast("array<string>")), "overlap_duration_fallback")),
        Rule("events: not the classes of the file", flat & (p("ambiguous_policy") == "drop") & (F.array_sort(F.map_keys(attacks)) != F.array_sort(told))),
        Rule("events: other numbers than the file", flat & (p("ambiguous_policy") == "drop") & F.exists(F.map_entries(attacks), lambda e: usable(e["key"]) != e["value"])),
    ]
    rules += [Rule(f"{k}: unsupported", ~F.coalesce(c(k).isin(*known), F.lit(False))) for k, known in versions.items()]
    return [Rule(r.name, F.coalesce(r.broken, F.lit(False))) for r in rules]


def _loose(p) -> dict[str, Column]:
    """Of each policy field, whether its value is laxer than the strict profile."""
    out = {}
    for k, want in STRICT.items():
        if k in CEILINGS:
            out[k] = p(k) > want
        elif k in SHARES or k in COUNTS:
            out[k] = p(k) < want
        else:
            out[k] = p(k) != F.lit(want)
    return out


def validate_statuses(statuses: DataFrame, official: bool = False, versions: dict[str, list[str]] | None = None) -> DataFrame:
    """(rule, severity, violations) over all run statuses and their events; ``official`` adds the rules of an official status."""
    return contracts.evaluate(statuses, status_rules(statuses.columns if official else None, versions)).unionByName(contracts.evaluate(status_events(statuses), event_rules()))


def authenticate(files: DataFrame, statuses: DataFrame, rows: DataFrame, runs: DataFrame, required: dict, min_overlap: float | None = None) -> list[str]:
    """Reasons why a set of run files is not the campaign's; none if it is.

    ``files`` (run_id, sha256), ``rows`` the union of the files (run_id, label, ts, duration).
    Files and statuses must pair one to one by content, statuses hold together, policies be no laxer
    than required, class counts agree with the files, attack rows lie in windows of their class, and
    every planned run come exactly once.
    """
    out = []
    pairs = joins.bijection(files.select("sha256"), statuses.select(F.col("split_ready_sha256").alias("sha256")), "sha256").count()
    out += [f"{pairs} file(s) and status(es) don't pair"] if pairs else []
    out += [f"status: {r.rule} ({r.violations})" for r in validate_statuses(statuses).filter("violations > 0").collect()]
    for r in statuses.select("run_id", F.to_json("labeling_policy").alias("p")).collect():
        out += [f"run {r.run_id}: {k} is {have!r}, not {want}" for k, have, want in policy_violations(json.loads(r.p or "{}"), required)]
    claimed = statuses.select("run_id", F.explode("class_counts_split_ready").alias("label", "n")).select(F.concat_ws("/", "run_id", "label").alias("k"), "n").filter("n > 0")
    seen = rows.groupBy(F.concat_ws("/", "run_id", "label").alias("k")).agg(F.count("*").alias("n"))
    out += [f"{r.k}: {r.observed} rows, {r.claimed} claimed" for r in contracts.reconcile(seen, claimed, "k").collect()]
    e = status_events(statuses).select(F.col("run_id").alias("w_run"), F.col("label").alias("w_label"), F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    off = intervals.window_join(rows.filter("label <> 'BENIGN'"), e, [("run_id", "w_run"), ("label", "w_label")], min_overlap, "left_anti").count()
    out += [f"{off} attack row(s) lie in no window of their class"] if off else []
    planned = [r.run_id for r in runs.select("run_id").collect()]
    out += [f"run {r.value}: {r.side}" for r in splits.coverage(rows.sparkSession, planned, files.select("run_id"), "run_id").collect()]
    return out


@dataclass
class Build:
    """A merged campaign: the rows with their split, what was measured, and the reasons why it is only diagnostic."""

    rows: DataFrame
    manifest: DataFrame
    duplicates: dict
    reasons: list[str] = field(default_factory=list)

    @property
    def official(self) -> bool:
        return not self.reasons


def build(rows: DataFrame, plan: dict[int, str], features: list[str] | None = None, max_duplicate_rate: float = 0.0, diagnostic: bool = False) -> Build:
    """Merge checked runs (run_id, timestamp, features, label) into the planned splits.

    A broken contract, runs off the plan, conflicting labels, splits out of time order or too many
    duplicates across splits are errors; with ``diagnostic`` they are reasons instead.
    """
    features = features or [c for c in ft.EXTENDED if c in rows.columns]
    reasons = [f"contract: {r.rule}" for r in contracts.dataset_contract(rows).filter("violations > 0 and severity = 'error'").collect()]
    d = splits.by_plan(rows, plan)
    reasons += [f"run {r.value}: {r.side}" for r in splits.coverage(rows.sparkSession, list(plan), rows.select("run_id").distinct(), "run_id").collect()]
    stats = duplicates.statistics(d, features, "run_id", "split", "label").first().asDict()
    if stats["conflicting_label_groups"]:
        reasons.append(f"{stats['conflicting_label_groups']} vector(s) have several labels")
    if stats["cross_split_duplicate_rate_raw"] > max_duplicate_rate:
        reasons.append(f"cross-split duplicate rate {stats['cross_split_duplicate_rate_raw']:.6f}")
    named = d.withColumn("split", F.when(F.col("split") == "validation", "val").otherwise(F.col("split")))
    ordered = splits.chronology(named, "timestamp").first()["ordered"]
    if not ordered:
        reasons.append("the time order of the splits is unknown" if ordered is None else "splits are not in time order")
    if reasons and not diagnostic:
        raise ManifestError("; ".join(reasons))
    return Build(d, splits.manifest(d, "timestamp"), stats, reasons)


RANKS = ("poor", "moderate", "strong")


def axis(value: float | None, limit: float, higher: bool = False, also: bool = True) -> str:
    """strong within the limit, moderate within twice (or half) of it, else poor; ``also`` is a further need for strong."""
    if value is None or not math.isfinite(value):
        return "poor"
    good, fair = (value >= limit, value >= limit / 2) if higher else (value <= limit, value <= 2 * limit)
    return "strong" if good and also else "moderate" if fair else "poor"


def realism(measures: dict, limits: dict) -> dict[str, str]:
    """Five axes and ``overall``, the weakest of them."""
    out = {
        "numeric": axis(measures.get("mean_js"), limits["max_mean_js"]),
        "categorical": axis(measures.get("mean_cat_js"), limits["max_cat_js"]),
        "conditional": axis(measures.get("cond_js"), limits["max_cond_js"]),
        "missingness": axis(measures.get("missing_gap"), limits["max_missing_rate_difference"]),
        "transfer": axis(measures.get("tstr_ratio"), limits["min_tstr_reference_ratio"], True, (measures.get("reference_f1") or 0) >= limits["min_reference_f1"]),
    }
    return out | {"overall": min(out.values(), key=RANKS.index)}


def release_reasons(diagnostic: bool, policy_complete: bool, domain_gate: str | None, overall: str, least: str | None) -> list[str]:
    """Why a dataset may not be released; none if it may. A gate that was not run does not pass."""
    out = ["diagnostic"] if diagnostic else []
    out += [] if policy_complete else ["incomplete release policy"]
    out += [] if domain_gate == "pass" else [f"domain gate {domain_gate}"]
    return out + ([] if least is None or RANKS.index(overall) >= RANKS.index(least) else ["overall quality too low"])


def shortcut_verdict(best_column: float, tree: float) -> str:
    """shortcut, suspicious or clean, from the best single column and the shallow tree."""
    return "shortcut" if best_column >= 0.9 or tree >= 0.98 else "suspicious" if tree >= 0.9 else "clean"


@dataclass
class Step:
    name: str
    run: object
    required: bool = True
    always: bool = False


def run_steps(steps: list[Step]) -> dict[str, str]:
    """Run steps in order: after a required one failed the rest is skipped, but for those that always run."""
    out, failed = {}, False
    for s in steps:
        if failed and not s.always:
            out[s.name] = "skipped"
            continue
        try:
            s.run()
            out[s.name] = "ok"
        except Exception as e:  # a step's failure is its result
            out[s.name] = f"failed: {e}"
            failed = failed or s.required
    return out
