"""The flow feature contract and the expressions that derive it from joined sensor logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.parse import number, whole

# Names of the published columns, value domains and version spellings.
NUMERIC = ["flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_bytes", "totlen_bwd_bytes", "down_up_ratio", "flow_bytes_s", "flow_pkts_s", "sni_present"]
CATEGORICAL = ["transport", "dst_port_class", "tls_version", "alpn", "ja3", "ja3s"]
COUNTS = ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_bytes", "totlen_bwd_bytes"]
LABELS = ["BENIGN", "BruteForce", "DoS", "PortScan"]
DOMAINS = {"transport": ["TCP", "UDP", "UNKNOWN"], "dst_port_class": ["well_known", "registered", "ephemeral", "unknown"], "tls_version": ["none", "1.0", "1.1", "1.2", "1.3"]}
# Identifiers that are never learned from, and what only tells rows apart.
IDENTIFIERS = ["uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "src_ip", "ttl", "flow_id", "dst_port", "matched_event_id", "ambiguity_reason"]
ALPN = ["h2", "h3", "http/1.1", "none"]
TLS = {"TLSv1": "1.0", "TLSv10": "1.0", "TLSv1.0": "1.0", "TLSv11": "1.1", "TLSv1.1": "1.1", "TLSv12": "1.2", "TLSv1.2": "1.2", "TLSv13": "1.3", "TLSv1.3": "1.3"}
COMMON = NUMERIC + CATEGORICAL


# Columns of the flow-meter log that are published, in file order.
METER_RAW = [
    "fwd_pkts_tot", "bwd_pkts_tot", "fwd_data_pkts_tot", "bwd_data_pkts_tot", "fwd_pkts_per_sec", "bwd_pkts_per_sec", "flow_pkts_per_sec",
    "fwd_header_size_tot", "fwd_header_size_min", "fwd_header_size_max", "bwd_header_size_tot", "bwd_header_size_min", "bwd_header_size_max",
    "flow_FIN_flag_count", "flow_SYN_flag_count", "flow_RST_flag_count", "fwd_PSH_flag_count", "bwd_PSH_flag_count", "flow_ACK_flag_count",
    "fwd_pkts_payload.min", "fwd_pkts_payload.max", "fwd_pkts_payload.tot", "fwd_pkts_payload.avg", "fwd_pkts_payload.std",
    "bwd_pkts_payload.min", "bwd_pkts_payload.max", "bwd_pkts_payload.tot", "bwd_pkts_payload.avg", "bwd_pkts_payload.std",
    "flow_pkts_payload.min", "flow_pkts_payload.max", "flow_pkts_payload.tot", "flow_pkts_payload.avg", "flow_pkts_payload.std",
    "fwd_iat.min", "fwd_iat.max", "fwd_iat.tot", "fwd_iat.avg", "fwd_iat.std", "bwd_iat.min", "bwd_iat.max", "bwd_iat.tot", "bwd_iat.avg", "bwd_iat.std",
    "flow_iat.min", "flow_iat.max", "flow_iat.tot", "flow_iat.avg", "flow_iat.std", "payload_bytes_per_second",
    "fwd_subflow_pkts", "bwd_subflow_pkts", "fwd_subflow_bytes", "bwd_subflow_bytes",
    "fwd_bulk_bytes", "bwd_bulk_bytes", "fwd_bulk_packets", "bwd_bulk_packets", "fwd_bulk_rate", "bwd_bulk_rate",
    "active.min", "active.max", "active.tot", "active.avg", "active.std", "idle.min", "idle.max", "idle.tot", "idle.avg", "idle.std",
    "fwd_init_window_size", "bwd_init_window_size", "fwd_last_window_size", "bwd_last_window_size",
]
METER_TCP_ONLY = [c for c in METER_RAW if c.endswith(("_flag_count", "_window_size"))]
METER = [c.replace(".", "_") for c in METER_RAW]
METER_COUNTS = [c for c in METER if c.endswith(("_flag_count", "_pkts_tot", "_header_size_tot", "_header_size_min", "_header_size_max", "_subflow_pkts", "_subflow_bytes", "_bulk_packets", "_bulk_bytes", "_window_size"))]
EXTENDED = COMMON + METER


def quoted(name: str) -> Column:
    """A column by a name that may hold dots."""
    return F.col(f"`{name}`")


def port_class(port: Column) -> Column:
    p = whole(port)
    return F.when(p < 1024, "well_known").when(p < 49152, "registered").when(p >= 49152, "ephemeral").otherwise("unknown")


def tls_version(c: Column) -> Column:
    """A version token in the feature's spelling; blank is none, an unknown token stays."""
    spelled = F.create_map(*[F.lit(x) for kv in TLS.items() for x in kv])
    text = F.trim(c)
    return F.when(c.isNull() | text.isin("", "-", "(empty)", "none"), "none").otherwise(F.coalesce(F.try_element_at(spelled, text), text))


def present(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns]).isNotNull().cast("int")


def rate(amount: Column, duration: Column, digits: int = 2) -> Column:
    """Amount by second; null without a positive duration."""
    return F.round(F.when(duration > 0, amount / duration), digits)


def common_features(joined: DataFrame, quic_joined: Column | None = None) -> dict[str, Column]:
    """The COMMON expressions over a connection row joined to ``ssl_*`` and ``quic_*`` columns.

    Missing measures stay null. Bytes are IP bytes, or payload bytes where those are missing.
    """
    c = lambda name: quoted(name) if name in joined.columns else F.lit(None).cast("string")
    duration, fwd, bwd = number(c("duration")), number(c("orig_pkts")), number(c("resp_pkts"))
    fwd_bytes = F.coalesce(number(c("orig_ip_bytes")), number(c("orig_bytes")))
    bwd_bytes = F.coalesce(number(c("resp_ip_bytes")), number(c("resp_bytes")))
    quic = quic_joined if quic_joined is not None else F.lit(False)
    ssl_version = F.nullif(c("ssl_version"), F.lit(""))
    return {
        "flow_duration": F.round(duration, 6),
        "tot_fwd_pkts": fwd,
        "tot_bwd_pkts": bwd,
        "totlen_fwd_bytes": fwd_bytes,
        "totlen_bwd_bytes": bwd_bytes,
        "down_up_ratio": F.round(F.when(fwd.isNotNull(), bwd / F.greatest(fwd, F.lit(1.0))), 4),
        "flow_bytes_s": rate(fwd_bytes + bwd_bytes, duration),
        "flow_pkts_s": rate(fwd + bwd, duration),
        "sni_present": present(c("ssl_server_name"), c("quic_server_name")),
        "transport": F.coalesce(F.nullif(F.upper(F.trim(c("proto"))), F.lit("")), F.lit("UNKNOWN")),
        "dst_port_class": port_class(c("id.resp_p")),
        "tls_version": F.when(ssl_version.isNotNull(), tls_version(ssl_version)).when(quic, "1.3").otherwise("none"),
        "alpn": F.coalesce(F.nullif(c("ssl_next_protocol"), F.lit("")), F.nullif(c("quic_client_protocol"), F.lit("")), F.lit("none")),
        "ja3": F.coalesce(F.nullif(c("ssl_ja3"), F.lit("")), F.lit("none")),
        "ja3s": F.coalesce(F.nullif(c("ssl_ja3s"), F.lit("")), F.lit("none")),
    }


def audit_features(audit: DataFrame) -> DataFrame:
    """COMMON columns beside an audit frame, from its connection, TLS and QUIC columns; a frame that has them already is returned as it is."""
    if all(c in audit.columns for c in COMMON):
        return audit
    named = {"version": "ssl_version", "server_name": "ssl_server_name", "next_protocol": "ssl_next_protocol", "ja3": "ssl_ja3", "ja3s": "ssl_ja3s", "quic_sni": "quic_server_name", "quic_alpn": "quic_client_protocol"}
    d = audit.select("*", *[quoted(a).alias(b) for a, b in named.items() if a in audit.columns and b not in audit.columns])
    quic = F.coalesce(F.trim("quic_version"), F.lit("")) != "" if "quic_version" in d.columns else F.lit(False)
    made = common_features(d, quic)
    return d.select(*[quoted(c) for c in audit.columns if c not in COMMON], *[made[c].alias(c) for c in COMMON])


def ml_columns(columns: list[str], drop_ids: bool = False) -> list[str]:
    """Columns that a model may read of a split-ready frame: no bookkeeping, and with ``drop_ids`` no identifiers either."""
    return [c for c in columns if c not in ("run_id", "timestamp", "ts") and not (drop_ids and c in IDENTIFIERS)]


def meter_features(columns: list[str], transport: Column, prefix: str = "fm_") -> dict[str, Column]:
    """The flow-meter columns; those that only TCP has are null for other transports."""
    out = {}
    for raw, name in zip(METER_RAW, METER, strict=True):
        value = number(quoted(prefix + raw)) if prefix + raw in columns else F.lit(None).cast("double")
        out[name] = F.when(transport == "TCP", value) if raw in METER_TCP_ONLY else value
    return out


def select_common(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """COMMON columns (and ``extra``); absent ones are null."""
    names = COMMON + list(extra or ())
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string" if c in CATEGORICAL else "double").alias(c) for c in names])


def binary_label(label: Column, benign: str = "BENIGN") -> Column:
    return F.when(F.lower(F.trim(label)) == benign.lower(), benign).otherwise("ATTACK")


def row_key(df: DataFrame, numeric: list[str], categorical: list[str]) -> Column:
    """A hash of a row's features: numbers to 8 digits, missing ones alike."""
    n = [F.coalesce(F.round(F.col(c).cast("double"), 8).cast("string"), F.lit("nan")) for c in numeric if c in df.columns]
    k = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in categorical if c in df.columns]
    return F.sha2(F.concat_ws("|", *n, *k), 256)
