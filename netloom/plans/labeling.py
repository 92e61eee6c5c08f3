"""Labelling of one capture run: joins, window resolution, features and the three projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions.parse import number, whole
from netloom.operators import contracts, intervals, joins


def join_logs(conn: DataFrame, ssl: DataFrame, quic: DataFrame, meter: DataFrame | None = None) -> DataFrame:
    """Connections with the last TLS, QUIC and flow-meter row of their uid."""
    d = joins.attach(conn, ssl, "uid", "line_no", "ssl_")
    d = joins.attach(d, quic, "uid", "line_no", "quic_")
    return joins.attach(d, meter, "uid", "line_no", "fm_") if meter is not None else d


def as_flows(conn: DataFrame) -> DataFrame:
    """The columns that interval joins use, beside all of ``conn``; a flow is one line of the log."""
    q = ft.quoted
    duration = number("duration")
    return conn.withColumns({
        "flow_id": F.col("line_no"), "src": q("id.orig_h"), "dst": q("id.resp_h"), "port": whole(q("id.resp_p")), "ts": number("ts"),
        "flow_seconds": F.when(duration >= 0, duration),
    })


def label_run(conn: DataFrame, ssl: DataFrame, quic: DataFrame, meter: DataFrame | None, windows: DataFrame, min_overlap: float | None = None) -> DataFrame:
    """Every connection with label, event, ambiguity, and all EXTENDED features."""
    contracts.require(conn, contracts.conn_rules(conn.columns))
    flows = as_flows(conn)
    slim = flows.select("flow_id", "src", "dst", "proto", "port", "ts", F.col("flow_seconds").alias("duration"))
    verdict = intervals.resolve(intervals.candidates(slim, windows, min_overlap))
    d = join_logs(flows, ssl, quic, meter).join(verdict, "flow_id", "left")
    d = d.fillna({"label": "BENIGN", "matched_event_id": "", "ambiguous": 0, "ambiguity_reason": "", "n_matches": 0, "n_labels": 0})
    features = ft.common_features(d, F.col("quic_joined"))
    transport = features["transport"]
    return d.select("*", *[c.alias(f"f_{n}") for n, c in {**features, **ft.meter_features(d.columns, transport)}.items()])


def projections(labelled: DataFrame, run_id: int, keep_ambiguous: bool = False) -> dict[str, DataFrame]:
    """The ML table, the split-ready table and the audit table of a labelled run.

    Ambiguous flows are only in the audit table, unless they are kept.
    """
    features = [F.col(f"f_{c}").alias(c) for c in ft.EXTENDED]
    clean = labelled if keep_ambiguous else labelled.filter("ambiguous = 0")
    audit = [c for c in labelled.columns if not c.startswith(("f_", "fm_")) and c not in ("flow_id", "src", "dst", "port", "flow_seconds", "n_matches", "n_labels", "line_no")]
    return {
        "ml": clean.select(*features, "label"),
        "split_ready": clean.select(F.lit(run_id).alias("run_id"), F.col("ts").alias("timestamp"), *features, "label"),
        "audit": labelled.select(*[ft.quoted(c) for c in audit]),
    }


def coverage_gates(evidence: DataFrame, min_matches: int = 1, min_port_coverage: float | None = None) -> DataFrame:
    """Events that are matched by too few usable flows, or cover too little of their port range."""
    bad = F.col("usable_flows") < min_matches
    if min_port_coverage is not None:
        bad = bad | ((F.col("span") > 1) & (F.col("port_coverage") < min_port_coverage))
    return evidence.filter(bad)
