"""Interval joins: flows against declared windows, windows against each other, points in windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows up to this many rows are broadcast; more are joined by time buckets.
BROADCAST_ROWS = 20_000


def overlap(ts: Column, duration: Column, start: Column, end: Column) -> Column:
    return F.least(ts + duration, end) - F.greatest(ts, start)


def in_window(ts: Column, duration: Column, start: Column, end: Column, min_overlap: float | None) -> Column:
    """Whether a flow falls in a window: by its start, or by the fraction of it that lies inside.

    A flow without a positive duration falls by its start in either mode.
    """
    point = ts.between(start, end)
    if min_overlap is None:
        return F.coalesce(point, F.lit(False))
    inside = F.when(ts.isNotNull() & start.isNotNull() & end.isNotNull(), overlap(ts, duration, start, end))
    return F.coalesce(F.when(F.coalesce(duration, F.lit(0.0)) > 0, (inside > 0) & (inside / duration >= min_overlap)).otherwise(point), F.lit(False))


def window_join(flows: DataFrame, windows: DataFrame, keys: list[tuple[str, str]], min_overlap: float | None, how: str = "inner", bucket_s: float = 3600.0) -> DataFrame:
    """Flows (ts, duration) joined to windows (start, end) on key pairs and time.

    Few windows are broadcast, so flows aren't shuffled. Beyond BROADCAST_ROWS both sides are dealt
    by key and time bucket; a pair meets in the first bucket that both touch, so it comes once.
    ``how`` is "inner" or, for flows without a window, "left_anti" there.
    """
    timed = in_window(flows["ts"], flows["duration"], windows["start"], windows["end"], min_overlap)
    on = [flows[a] == windows[b] for a, b in keys]
    if windows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        condition = timed
        for c in on:
            condition = condition & c
        return flows.join(F.broadcast(windows), condition, how)
    if how == "left_anti":
        # Flows alike in time and keys match alike, so they need no id.
        same = list(dict.fromkeys(["ts", "duration", *[a for a, _ in keys]]))
        alike = flows.select(*same).distinct()
        found = window_join(alike, windows, keys, min_overlap, bucket_s=bucket_s).select(*[F.col(c).alias(f"__m_{c}") for c in same]).distinct()
        return flows.join(found, reduce(lambda x, y: x & y, [flows[c].eqNullSafe(F.col(f"__m_{c}")) for c in same]), "left_anti")
    if how != "inner":
        raise ValueError(f"many windows: no {how} join")
    first = lambda t: F.floor(t / bucket_s)
    late = flows["ts"] + F.greatest(F.coalesce(flows["duration"], F.lit(0.0)), F.lit(0.0)) if min_overlap is not None else flows["ts"]
    f = flows.withColumn("__fb", F.explode(F.sequence(first(flows["ts"]), first(late))))
    w = windows.withColumn("__wb", F.explode(F.sequence(first(windows["start"]), first(windows["end"]))))
    condition = in_window(F.col("ts"), F.col("duration"), F.col("start"), F.col("end"), min_overlap) & (f["__fb"] == w["__wb"])
    condition = condition & (f["__fb"] == F.greatest(first(F.col("ts")), first(F.col("start"))))
    for a, b in keys:
        condition = condition & (f[a] == w[b])
    return f.join(w, condition).drop("__fb", "__wb")


ENDPOINTS = [("src", "attacker"), ("dst", "target")]


def matched(pair_proto: Column | None = None) -> Column:
    """Whether a candidate pair agrees in protocol and port."""
    return F.coalesce((F.lower(F.col("proto")) == F.col("w_proto")) & F.col("port").between(F.col("port_lo"), F.col("port_hi")), F.lit(False))


def candidates(flows: DataFrame, windows: DataFrame, min_overlap: float | None = None) -> DataFrame:
    """Pairs of a flow and a window that agree in endpoints and time, with ``is_match``.

    Flows: flow_id, src, dst, proto, port, ts, duration. Windows: event_id, w_label, attacker,
    target, w_proto, port_lo, port_hi, span, start, end, ord.
    """
    return window_join(flows, windows, ENDPOINTS, min_overlap).withColumn("is_match", matched())


def resolve(pairs: DataFrame) -> DataFrame:
    """One row for each flow of ``candidates``: label, matched event, ambiguity, counts.

    The narrowest matching port range wins, then file order; several labels among the narrowest
    make the flow ambiguous. Candidates without a match make it benign and ambiguous.
    """
    hit = F.when(F.col("is_match"), F.struct("span", "ord", "w_label", "event_id"))
    one = pairs.groupBy("flow_id").agg(
        F.min(hit).alias("best"),
        F.collect_set(F.when(F.col("is_match"), F.struct("span", "w_label"))).alias("kinds"),
        F.count_if("is_match").alias("n_matches"),
        F.min(F.struct("ord", "event_id"))["event_id"].alias("first_candidate"),
    )
    narrow = F.filter("kinds", lambda k: k["span"] == F.col("best.span"))
    return one.select(
        "flow_id",
        F.coalesce(F.col("best.w_label"), F.lit("BENIGN")).alias("label"),
        F.coalesce(F.col("best.event_id").cast("string"), F.lit("")).alias("matched_event_id"),
        F.when(F.col("best").isNull() | (F.size(narrow) > 1), 1).otherwise(0).alias("ambiguous"),
        F.when(F.col("best").isNull(), "mismatch").when(F.size(narrow) > 1, "tie").otherwise("").alias("ambiguity_reason"),
        F.col("n_matches").cast("long").alias("n_matches"),
        F.size(F.array_distinct(F.transform("kinds", lambda k: k["w_label"]))).alias("n_labels"),
    )


def classify(flows: DataFrame, windows: DataFrame, min_overlap: float | None = None) -> DataFrame:
    """``flows`` with label, matched_event_id, ambiguous, ambiguity_reason, n_matches, n_labels."""
    found = resolve(candidates(flows, windows, min_overlap))
    out = flows.join(found, "flow_id", "left")
    return out.fillna({"label": "BENIGN", "matched_event_id": "", "ambiguous": 0, "ambiguity_reason": "", "n_matches": 0, "n_labels": 0})


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """Pairs (first_event, second_event) of windows that meet in endpoints, protocol, time and ports."""
    a = windows.select(*[F.col(c).alias(f"a_{c}") for c in windows.columns])
    b = windows
    on = (
        (F.col("a_attacker") == F.col("attacker")) & (F.col("a_target") == F.col("target")) & (F.col("a_w_proto") == F.col("w_proto"))
        & (F.col("a_ord") < F.col("ord")) & (F.col("a_start") <= F.col("end")) & (F.col("start") <= F.col("a_end"))
        & (F.col("a_port_lo") <= F.col("port_hi")) & (F.col("port_lo") <= F.col("a_port_hi"))
    )
    return a.join(b, on).select(F.col("a_event_id").alias("first_event"), F.col("event_id").alias("second_event"))


def event_evidence(flows: DataFrame, windows: DataFrame, min_overlap: float | None = None) -> DataFrame:
    """One row for each window, matched or not: matched, usable and ambiguous flows, ports, times, coverage.

    Match times are clamped into the window. A flow is usable for the one event that resolved it.
    """
    pairs = candidates(flows, windows, min_overlap)
    verdict = resolve(pairs).select("flow_id", "matched_event_id", "ambiguous", "n_labels")
    hits = pairs.filter("is_match").join(verdict, "flow_id")
    point = F.least(F.greatest("ts", "start"), F.col("end"))
    whole = F.lit(min_overlap is not None) & (F.coalesce("duration", F.lit(0.0)) > 0)
    hits = hits.withColumns({"first": F.when(whole, F.greatest("ts", "start")).otherwise(point), "last": F.when(whole, F.least(F.col("ts") + F.col("duration"), F.col("end"))).otherwise(point)})
    found = hits.groupBy("event_id").agg(
        F.count("*").alias("matched_flows"),
        F.count_if((F.col("ambiguous") == 0) & (F.col("matched_event_id") == F.col("event_id").cast("string"))).alias("usable_flows"),
        F.count_if(F.col("n_labels") > 1).alias("ambiguous_flows"),
        F.count_distinct("port").alias("unique_dst_ports"),
        F.min("first").alias("first_match"),
        F.max("last").alias("last_match"),
    )
    out = windows.join(found, "event_id", "left").fillna({"matched_flows": 0, "usable_flows": 0, "ambiguous_flows": 0, "unique_dst_ports": 0})
    return out.withColumn("port_coverage", F.round(F.col("unique_dst_ports") / F.col("span"), 4))


def overlap_accounting(flows: DataFrame, windows: DataFrame, min_overlap: float) -> DataFrame:
    """(matched_flows, duration_fallback_flows): flows with a match, and those judged by their start."""
    hit = candidates(flows, windows, min_overlap).filter("is_match").select("flow_id", "duration").distinct()
    return hit.agg(F.count("*").alias("matched_flows"), F.count_if(F.coalesce("duration", F.lit(0.0)) <= 0).alias("duration_fallback_flows"))


def counters(classified: DataFrame, benign: str = "BENIGN") -> DataFrame:
    """(flows, attacks, ambiguous, without_duration) of classified flows."""
    return classified.agg(F.count("*").alias("flows"), F.count_if(F.col("label") != benign).alias("attacks"), F.sum("ambiguous").alias("ambiguous"), F.count_if(F.coalesce("duration", F.lit(0.0)) <= 0).alias("without_duration"))


def off_window(rows: DataFrame, windows: DataFrame, min_overlap: float | None = None, benign: str = "BENIGN") -> DataFrame:
    """Attack rows (label, ts, duration) that lie in no window of their own class."""
    attacks = rows.filter(F.col("label") != benign)
    return window_join(attacks, windows, [("label", "w_label")], min_overlap, "left_anti")


def merged_windows(windows: DataFrame, bucket_s: float) -> DataFrame:
    """(__wb, start, end): disjoint unions of the windows that touch each time bucket."""
    first = lambda t: F.floor(t / bucket_s)
    w = windows.filter("start <= end").groupBy("start").agg(F.max("end").alias("end"))
    w = w.withColumn("__wb", F.explode(F.sequence(first(F.col("start")), first(F.col("end")))))
    order = Window.partitionBy("__wb").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("__new", F.coalesce(F.col("start") > before, F.lit(True)).cast("long")).withColumn("__union", F.sum("__new").over(order))
    return w.groupBy("__wb", "__union").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__union")


def in_any_window(points: DataFrame, windows: DataFrame, bucket_s: float = 3600.0) -> DataFrame:
    """``points`` (ts) with ``inside``: whether a point lies in one of the windows (closed), of which there may be any number.

    A point meets the unions of its time bucket only; these are disjoint, so it comes once.
    """
    merged = merged_windows(windows, bucket_s).select("__wb", F.col("start").alias("__from"), F.col("end").alias("__to"))
    on = (F.floor(points["ts"] / bucket_s) == F.col("__wb")) & points["ts"].between(F.col("__from"), F.col("__to"))
    found = points.join(merged, on, "left")
    return found.withColumn("inside", F.col("__wb").isNotNull()).drop("__wb", "__from", "__to")
