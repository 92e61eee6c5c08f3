"""Which columns a model may see: groups by name, and the feature regimes made of them."""

from __future__ import annotations

import re

# Exact names and patterns of normalised column names for each group; the first group that fits wins.
BOOKKEEPING = {
    "run_id", "runid", "attempt_id", "attemptid", "campaign_id", "campaignid", "config_id", "configid", "scenario_id", "scenarioid", "event_id", "eventid",
    "annotation_id", "annotationid", "flow_id", "flowid", "uid", "split", "_split", "dataset_split", "fold", "pcap", "pcap_path", "file", "filename", "file_name",
    "source_file", "capture_file", "timestamp", "ts", "time", "start_utc", "end_utc", "start_ts", "end_ts", "attack", "attack_type", "attack_name", "event_label",
    "label_source", "ground_truth", "groundtruth", "orchestrator_version",
}
PATTERNS = {
    "bookkeeping": (
        r"^(?:run|attempt|campaign|config|scenario|event|annotation|flow)[_-]?id$", r"^(?:pcap|capture|source)[_-]?(?:file|path|name)$", r"^(?:start|end)[_-]?(?:utc|ts|time|timestamp)$",
        r"^(?:absolute_)?timestamp$", r"^(?:split|fold|partition)$", r"^(?:attack|event)[_-]?(?:label|name|type)$",
    ),
    "sii": (
        r"^(?:src|source|orig|dst|dest|destination|resp)[_-]?mac(?:_addr(?:ess)?)?$", r"^(?:eth|ether)[._-]?(?:src|dst)$", r"^mac[._-]?(?:src|dst)$",
        r"^(?:src|source|orig|dst|dest|destination|resp)[_-]?(?:ip|ipaddr|ip_addr|address|addr)$", r"^id[._-]?(?:orig|resp)[._-]?h$",
        r"^(?:src|source|orig|dst|dest|destination|resp)[_-]?port$", r"^(?:sport|dport)$", r"^id[._-]?(?:orig|resp)[._-]?p$",
        r"^(?:src|dst|source|destination)[_-]?port[_-]?(?:class|category|bucket)$", r"^(?:service|service_port|port_service|port_class)$",
    ),
    "sni": (r"^sni$", r"^sni[_-]?(?:value|name|host|hostname|present|presence)$", r"^(?:tls|ssl)[_-]?(?:sni|server_name|servername)$", r"^server[_-]?name(?:[_-]?indication)?$"),
    "contextual_artifacts": (
        r"^(?:ip|ipv4)[_-]?(?:id|identification)$", r"^(?:ip|ipv4)[_-]?(?:header[_-]?)?checksum$", r"^(?:tcp[_-]?)?(?:seq|sequence|sequence_number)$",
        r"^(?:tcp[_-]?)?(?:ack|acknowledgment|acknowledgement|ack_number)$",
    ),
    "temporal_artifacts": (
        r"^(?:tcp[_-]?)?(?:tsval|tsecr|timestamp_option|option_timestamp)$", r"^(?:fwd|bwd|forward|backward)?[_-]?(?:init|initial|last)?[_-]?window(?:_size)?$", r"^(?:tcp[_-]?)?window(?:_size)?$",
    ),
    "protocol": (r"^(?:transport|protocol|proto|l4_protocol|l4_proto)$", r"^(?:is_)?(?:tcp|udp|quic)$"),
    "fingerprints": (r"^ja3$", r"^ja3s$", r"^ja4$", r"^ja4s$", r"^(?:tls|ssl)[_-]?(?:fingerprint|client_fingerprint|server_fingerprint)$"),
}
OTHER = "other_network_features"
# The eight volume features of the separability probe, and what its clean set leaves out.
VOLUME = ["flow_duration", "flow_pkts_s", "flow_bytes_s", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_bytes", "totlen_bwd_bytes", "down_up_ratio"]
UNCLEAN = ["dst_port_class", "sni_present", "transport", "ja3", "ja3s", "fwd_init_window_size", "bwd_init_window_size", "fwd_last_window_size", "bwd_last_window_size"]


def normalised(name: str) -> str:
    """Lower case, runs of other characters than letters and digits one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def group_of(name: str, label: str = "label") -> str:
    """The group of a column by its name; labels are bookkeeping."""
    n = normalised(name)
    if n == normalised(label) or n in BOOKKEEPING:
        return "bookkeeping"
    return next((group for group, patterns in PATTERNS.items() if any(re.fullmatch(p, n) for p in patterns)), OTHER)


def groups(columns: list[str], label: str = "label") -> dict[str, list[str]]:
    """Columns of each group, in their order."""
    out: dict[str, list[str]] = {g: [] for g in (*PATTERNS, OTHER)}
    for c in columns:
        out[group_of(c, label)].append(c)
    return out


def regimes(columns: list[str], label: str = "label", wanted: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Columns by regime: A1 all, D1 without endpoints and ports, D2 without names too; CTD, P and F are D2 without artifacts, protocol or fingerprints."""
    by = groups(columns, label)
    left_out = {"A1": (), "D1": ("sii",), "D2": ("sii", "sni"), "CTD": ("sii", "sni", "contextual_artifacts", "temporal_artifacts"), "P": ("sii", "sni", "protocol"), "F": ("sii", "sni", "fingerprints")}
    unknown = [w for w in wanted if w not in left_out]
    if unknown:
        raise ValueError(f"no regime {unknown}; there are {list(left_out)}")
    out = {}
    for name in wanted or left_out:
        gone = {c for g in ("bookkeeping", *left_out[name]) for c in by[g]}
        out[name] = [c for c in columns if c not in gone]
        if not out[name]:
            raise ValueError(f"regime {name} has no feature")
    return out
