"""A generator of labelled flows: the same distributions at any number of rows, from seeded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import features as ft

# Medians, means and spreads of each class, and of services that are no web traffic.
PROFILE = ("duration_median", "duration_sigma", "fwd_pkts_median", "fwd_pkts_sigma", "bwd_pkts_median", "bwd_pkts_sigma", "fwd_size_mean", "fwd_size_sd", "bwd_size_mean", "bwd_size_sd", "fin_p", "rst_p")
CLASSES = {
    "BENIGN": (4.0, 1.0, 12, 0.8, 14, 0.9, 210, 90, 900, 500, 0.70, 0.05),
    "PortScan": (0.02, 0.6, 1, 0.2, 1, 0.4, 40, 6, 44, 8, 0.02, 0.70),
    "BruteForce": (0.6, 0.9, 9, 0.7, 10, 0.8, 300, 140, 800, 450, 0.55, 0.12),
    "DoS": (60.0, 0.7, 6, 0.8, 3, 0.9, 70, 40, 120, 90, 0.10, 0.35),
}
SERVICES = {
    "DNS": (0.02, 0.5, 1, 0.8, 1, 0.9, 60, 15, 120, 60, 0.0, 0.0),
    "NTP": (0.01, 0.4, 1, 0.8, 1, 0.9, 76, 4, 76, 4, 0.0, 0.0),
    "HTTP-health": (0.05, 0.5, 3, 0.8, 2, 0.9, 120, 30, 200, 60, 0.8, 0.02),
    "TCP-refused": (0.005, 0.5, 1, 0.8, 1, 0.9, 44, 4, 40, 4, 0.0, 0.95),
}
# The protocols of each class, in the testbed and in a broader setting.
MIXES = {
    "testbed": {
        "BENIGN": (("HTTPS-TLS13", 0.66), ("HTTP3-QUIC", 0.18), ("DNS", 0.11), ("NTP", 0.05)), "PortScan": (("TCP-probe", 1.0),),
        "BruteForce": (("HTTPS-TLS13", 1.0),), "DoS": (("HTTPS-TLS13", 1.0),),
    },
    "broad": {
        "BENIGN": (("HTTPS-TLS13", 0.48), ("HTTP3-QUIC", 0.16), ("HTTPS-TLS12", 0.10), ("HTTP-plain", 0.06), ("DNS", 0.10), ("NTP", 0.04), ("HTTP-health", 0.04), ("TCP-refused", 0.02)),
        "PortScan": (("TCP-probe", 1.0),), "BruteForce": (("HTTPS-TLS13", 0.70), ("HTTPS-TLS12", 0.20), ("HTTP-plain", 0.10)), "DoS": (("HTTPS-TLS13", 0.50), ("HTTP3-QUIC", 0.30), ("HTTPS-TLS12", 0.20)),
    },
}
# Transport, port (a probe has any), TLS version and the application protocols of each.
WIRE = {
    "HTTPS-TLS13": ("TCP", 443, "1.3", (("h2", 0.7), ("http/1.1", 0.3))), "HTTPS-TLS12": ("TCP", 443, "1.2", (("h2", 0.5), ("http/1.1", 0.5))), "HTTP3-QUIC": ("UDP", 443, "1.3", (("h3", 1.0),)),
    "HTTP-plain": ("TCP", 80, "none", (("http/1.1", 1.0),)), "TCP-probe": ("TCP", None, "none", (("none", 1.0),)), "DNS": ("UDP", 53, "none", (("none", 1.0),)), "NTP": ("UDP", 123, "none", (("none", 1.0),)),
    "HTTP-health": ("TCP", 8080, "none", (("http/1.1", 1.0),)), "TCP-refused": ("TCP", 3306, "none", (("none", 1.0),)),
}
SNI = {"BENIGN": 0.98, "PortScan": 0.0, "BruteForce": 0.85, "DoS": 0.85}
CLIENTS = {"BENIGN": 50, "BruteForce": 3, "DoS": 2, "PortScan": 0}
SERVERS = 3
RUN_SECONDS = 2700


def choose(draw: Column, weighted: tuple[tuple[str, float], ...]) -> Column:
    """The item whose cumulative weight a uniform draw falls under."""
    out, upto = None, 0.0
    for name, w in weighted[:-1]:
        upto += w
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return F.lit(weighted[-1][0]) if out is None else out.otherwise(weighted[-1][0])


def by_name(column: Column, values: dict[str, object]) -> Column:
    out = None
    for k, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def generate(spark: SparkSession, rows: int, shares: dict[str, float], runs: int = 4, seed: int = 0, jitter: float = 0.35, start: float = 1.7e9, profile: str = "testbed") -> DataFrame:
    """``rows`` flows over ``runs`` runs in class shares, with times, protocols, fingerprints and statistics.

    Each run scales the medians and means of its classes by up to ``jitter``. Attacks lie in one
    window of each run, fingerprints of attack tools are among those of benign clients. ``profile``
    picks the mix of protocols: testbed or broad.
    """
    r = lambda i: F.rand(seed * 1000 + i)
    g = lambda i: F.randn(seed * 1000 + i)
    d = spark.range(rows).withColumn("run_id", (F.col("id") % runs).cast("int"))
    d = d.withColumn("label", choose(r(1), tuple(shares.items())))
    mixes = {k: choose(F.col("u"), m) for k, m in MIXES[profile].items()}
    d = d.withColumn("u", r(2))
    proto = None
    for k, c in mixes.items():
        proto = F.when(F.col("label") == k, c) if proto is None else proto.when(F.col("label") == k, c)
    d = d.withColumn("l7_protocol", proto)
    scaled = {p: by_name(F.col("label"), {k: float(v[i]) for k, v in CLASSES.items()}) for i, p in enumerate(PROFILE)}
    own = {p: by_name(F.col("l7_protocol"), {k: float(v[i]) for k, v in SERVICES.items()}) for i, p in enumerate(PROFILE)}
    d = d.withColumns({f"p_{p}": F.coalesce(own[p], scaled[p]) for p in PROFILE})
    # A factor for each run, class and profile entry, from a hash: the same on every row of the run.
    factor = lambda p: 1 - jitter + 2 * jitter * (F.pmod(F.xxhash64(F.lit(seed), "run_id", "label", F.lit(p)), F.lit(1 << 20)) / float(1 << 20))
    d = d.withColumns({f"p_{p}": F.col(f"p_{p}") * factor(p) for p in PROFILE if p.endswith(("_median", "_mean"))})
    c = F.col
    log_normal = lambda m, s, i: c(f"p_{m}") * F.exp(c(f"p_{s}") * g(i))
    wire = lambda i: by_name(c("l7_protocol"), {k: v[i] for k, v in WIRE.items() if v[i] is not None})
    alpn = by_name(c("l7_protocol"), {k: choose(r(15), v[3]) for k, v in WIRE.items()})
    d = d.withColumns({
        "flow_duration": F.round(F.greatest(log_normal("duration_median", "duration_sigma", 3), F.lit(1e-4)), 6),
        "tot_fwd_pkts": F.floor(F.greatest(log_normal("fwd_pkts_median", "fwd_pkts_sigma", 4), F.lit(1.0))).cast("double"),
        "tot_bwd_pkts": F.floor(F.greatest(log_normal("bwd_pkts_median", "bwd_pkts_sigma", 5), F.lit(0.0))).cast("double"),
        "fwd_size": F.least(F.greatest(c("p_fwd_size_mean") + c("p_fwd_size_sd") * g(6), F.lit(20.0)), F.lit(1500.0)),
        "bwd_size": F.least(F.greatest(c("p_bwd_size_mean") + c("p_bwd_size_sd") * g(7), F.lit(0.0)), F.lit(1500.0)),
        "transport": wire(0), "dst_port": F.coalesce(wire(1), F.floor(r(8) * 4096 + 1)).cast("int"), "tls_version": wire(2), "alpn": alpn,
    })
    tls = (c("tls_version") != "none")
    printed = tls & (c("l7_protocol") != "HTTP3-QUIC") & (by_name(c("label"), CLIENTS) > 0)
    d = d.withColumns({
        "totlen_fwd_bytes": F.floor(c("tot_fwd_pkts") * c("fwd_size")).cast("double"), "totlen_bwd_bytes": F.floor(c("tot_bwd_pkts") * c("bwd_size")).cast("double"),
        "sni_present": (tls & (r(9) < by_name(c("label"), SNI))).cast("int"),
        "ja3": F.when(printed, F.md5(F.concat(F.lit("client"), F.floor(r(10) * by_name(c("label"), CLIENTS)).cast("string")))).otherwise("none"),
        "ja3s": F.when(printed, F.md5(F.concat(F.lit("server"), F.floor(r(11) * SERVERS).cast("string")))).otherwise("none"),
        "timestamp": start + c("run_id") * 86400 + F.when(c("label") == "BENIGN", r(12) * RUN_SECONDS).otherwise(RUN_SECONDS * (0.2 + 0.2 * by_name(c("label"), {k: float(i) for i, k in enumerate(CLASSES)})) + r(12) * 120),
        "fin_flag_cnt": F.when(c("transport") == "TCP", (r(13) < c("p_fin_p")).cast("int")).otherwise(0), "rst_flag_cnt": F.when(c("transport") == "TCP", (r(14) < c("p_rst_p")).cast("int")).otherwise(0),
        "syn_flag_cnt": (c("transport") == "TCP").cast("int"),
        "dst_port_class": F.when(c("dst_port") < 1024, "well_known").when(c("dst_port") < 49152, "registered").otherwise("ephemeral"),
    })
    d = d.withColumns({
        "down_up_ratio": F.round(c("tot_bwd_pkts") / F.greatest("tot_fwd_pkts", F.lit(1.0)), 4),
        "flow_bytes_s": F.round((c("totlen_fwd_bytes") + c("totlen_bwd_bytes")) / c("flow_duration"), 2), "flow_pkts_s": F.round((c("tot_fwd_pkts") + c("tot_bwd_pkts")) / c("flow_duration"), 2),
    })
    return d.drop("id", "u", "fwd_size", "bwd_size", *[f"p_{p}" for p in PROFILE])


def summary(flows: DataFrame) -> DataFrame:
    """(label, flows, client_prints, median_duration): what a generated set holds."""
    return flows.groupBy("label").agg(F.count("*").alias("flows"), F.count_distinct(F.when(F.col("ja3") != "none", F.col("ja3"))).alias("client_prints"), F.median("flow_duration").alias("median_duration"))


def with_meter(flows: DataFrame, seed: int = 0) -> DataFrame:
    """``flows`` with the flow-meter columns, drawn to fit the flow's totals: each in its domain, those of TCP null for others.

    No model of traffic: sizes and gaps are averages with a spread, so that contracts hold.
    """
    c = F.col
    u = lambda lo, hi, i: lo + (hi - lo) * F.rand(seed * 1000 + 500 + i)
    count = {"fwd": c("tot_fwd_pkts"), "bwd": c("tot_bwd_pkts"), "flow": F.greatest(c("tot_fwd_pkts") + c("tot_bwd_pkts"), F.lit(1.0))}
    size = {"fwd": c("totlen_fwd_bytes"), "bwd": c("totlen_bwd_bytes"), "flow": c("totlen_fwd_bytes") + c("totlen_bwd_bytes")}
    seconds = c("flow_duration")
    by_second = lambda x: F.round(x / F.greatest(seconds, F.lit(1e-4)), 6)
    some = lambda side, x: F.when(count[side] > 0, x).otherwise(0.0)
    made: dict[str, Column] = {"payload_bytes_per_second": by_second(size["flow"])}
    for i, side in enumerate(("fwd", "bwd", "flow")):
        n, of = F.greatest(count[side], F.lit(1.0)), size[side]
        mean, gap = of / n, seconds / n
        made |= {
            f"{side}_pkts_per_sec": by_second(count[side]), f"{side}_pkts_payload_min": F.lit(0.0), f"{side}_pkts_payload_max": F.round(mean * 1.5, 6), f"{side}_pkts_payload_tot": of, f"{side}_pkts_payload_avg": F.round(mean, 6), f"{side}_pkts_payload_std": F.round(mean * u(0.1, 0.5, 10 * i), 6),
            f"{side}_iat_min": F.round(gap * u(0.1, 0.5, 10 * i + 1), 6), f"{side}_iat_max": F.round(gap * u(1.5, 3.0, 10 * i + 2), 6), f"{side}_iat_tot": seconds, f"{side}_iat_avg": F.round(gap, 6), f"{side}_iat_std": F.round(gap * u(0.2, 0.8, 10 * i + 3), 6),
        }
        if side != "flow":
            made |= {
                f"{side}_pkts_tot": count[side], f"{side}_data_pkts_tot": F.greatest(count[side] - 1, F.lit(0.0)), f"{side}_header_size_tot": 20 * count[side], f"{side}_header_size_min": some(side, 20.0), f"{side}_header_size_max": some(side, 20.0),
                f"{side}_PSH_flag_count": F.floor(count[side] * u(0.1, 0.3, 10 * i + 4)), f"{side}_subflow_pkts": count[side], f"{side}_subflow_bytes": of, f"{side}_bulk_bytes": F.lit(0.0), f"{side}_bulk_packets": F.lit(0.0), f"{side}_bulk_rate": F.lit(0.0),
                f"{side}_init_window_size": some(side, 64240.0 if side == "fwd" else 65535.0), f"{side}_last_window_size": some(side, 501.0),
            }
    for i, (part, lo, hi) in enumerate((("active", 0.1, 0.4), ("idle", 0.0, 0.2))):
        base = seconds * u(lo, hi, 40 + i)
        made |= {f"{part}_{k}": F.round(base * f, 6) for k, f in (("min", 0.5), ("max", 1.5), ("tot", 1.0), ("avg", 1.0), ("std", 0.3))}
    made |= {"flow_FIN_flag_count": c("fin_flag_cnt"), "flow_SYN_flag_count": c("syn_flag_cnt"), "flow_RST_flag_count": c("rst_flag_cnt"), "flow_ACK_flag_count": count["flow"] - 1}
    tcp_only = {x.replace(".", "_") for x in ft.METER_TCP_ONLY}
    return flows.select("*", *[(F.when(c("transport") == "TCP", made[n]) if n in tcp_only else made[n]).cast("double").alias(n) for n in ft.METER if n not in flows.columns])
