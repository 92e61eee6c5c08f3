"""Service effects and layered ground truth: probes, requests and sessions against windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.intervals import in_any_window
from netloom.operators.splits import running_ranges
from netloom.operators.statistics import nearest_rank
from netloom.sources.shared import stored


def monitor_summary(probes: DataFrame) -> DataFrame:
    """(url, probes, availability, p50_ms, p95_ms, errors, worst_code) of probes (url, ok, latency_ms, error, http_code)."""
    base = probes.groupBy("url").agg(F.count("*").alias("probes"), F.avg("ok").alias("availability"), F.count_if(F.coalesce(F.trim("error"), F.lit("")) != "").alias("errors"), F.max(F.when(F.col("http_code") != 0, F.col("http_code"))).alias("worst_code"))
    for q, name in ((0.5, "p50_ms"), (0.95, "p95_ms")):
        base = base.join(nearest_rank(probes, ["url"], "latency_ms", q, name), "url", "left")
    return base


def effects(probes: DataFrame, windows: DataFrame, drop: float = 0.2, factor: float = 2.0, rise: float = 0.2) -> DataFrame:
    """By url: probes, availability, p95 latency and error rate inside and outside the windows, and effect_confirmed.

    Confirmed if availability drops, p95 grows by the factor (both there and not 0) or the error rate rises enough.
    """
    d = in_any_window(probes, windows).withColumn("bucket", F.when(F.col("inside"), "attack").otherwise("baseline"))
    p95 = nearest_rank(d, ["url", "bucket"], "latency_ms", 0.95, "p95")
    failed = F.coalesce(F.trim("error"), F.lit("")) != ""
    base = d.groupBy("url", "bucket").agg(F.count("*").alias("probes"), F.avg("ok").alias("availability"), (F.count_if(failed) / F.count("*")).alias("error_rate")).join(p95, ["url", "bucket"], "left")
    parts = ("probes", "availability", "error_rate", "p95")
    wide = base.groupBy("url").agg(*[F.max(F.when(F.col("bucket") == b, F.col(p))).alias(f"{p}_{b}") for b in ("attack", "baseline") for p in parts])
    c = F.col
    confirmed = F.coalesce(c("availability_baseline") - c("availability_attack") >= drop, F.lit(False))
    grew = (c("p95_attack") > 0) & (c("p95_baseline") > 0) & (c("p95_attack") / F.nullif(c("p95_baseline"), F.lit(0.0)) >= factor)
    confirmed = confirmed | F.coalesce(grew, F.lit(False)) | F.coalesce(c("error_rate_attack") - c("error_rate_baseline") >= rise, F.lit(False))
    return wide.fillna({"probes_attack": 0, "probes_baseline": 0}).withColumn("effect_confirmed", confirmed)


def evidence_levels(events: DataFrame) -> DataFrame:
    """``events`` (usable_flows, requests_attacker) with an array of the levels of evidence reached.

    An event stands for a tool that ran with success; traffic is observed if flows could be used,
    the application if requests came from the attacker.
    """
    levels = F.array(
        F.lit("tool_executed"), F.when(F.coalesce("usable_flows", F.lit(0)) > 0, "traffic_observed"), F.when(F.coalesce("requests_attacker", F.lit(0)) > 0, "application_observed"),
    )
    return events.withColumn("evidence", F.array_compact(levels))


def attributed_requests(events: DataFrame, requests: DataFrame, bucket_s: float = 3600.0, others: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(event_id, carry, requests_attacker, requests_other): requests in an event's closed time that fit its class.

    Events: event_id, label, attacker, target, start, end, path. BruteForce asks for a POST whose uri
    holds the path, DoS for a GET that starts with it; hosts must agree where both are known. Without
    ``others``, only the attacker's requests are counted and requests_other is left out. ``carry``:
    further columns of the events.

    Requests are counted, not paired with events. What an event asks for (label, path, target) is the
    same for many: each such pattern gets a number, and a request meets the patterns that some event
    has in its time bucket. They are written first, so that Spark knows their size and broadcasts
    few. The requests of a pattern, and those of each of its clients, are put in order of time with
    the starts and ends of its events among them: an event's number is the running count at its end
    less that at its start.
    """
    asks = F.create_map(*[F.lit(x) for x in ("BruteForce", "POST", "DoS", "GET")])
    first = lambda t: F.floor(t / bucket_s)
    r = requests.select("ts", "client", F.upper("method").alias("__method"), F.coalesce("uri", F.lit("")).alias("uri"), F.nullif(F.split_part("host", F.lit(":"), F.lit(1)), F.lit("")).alias("host"), first(F.col("ts")).alias("__bucket"))
    e = events.select("event_id", "attacker", F.nullif(F.trim("target"), F.lit("")).alias("target"), "start", "end", "path", "label").filter(F.try_element_at(asks, F.col("label")).isNotNull() & (F.col("start") <= F.col("end")) & F.col("path").isNotNull())
    spans = e.select("label", "path", "target", first(F.col("start")).alias("__from"), first(F.col("end")).alias("__to")).distinct()
    asked = spans.select("label", "path", "target", F.explode(F.sequence("__from", "__to")).alias("__wb")).distinct()
    asked = stored(asked.withColumn("__asked", F.try_element_at(asks, F.col("label"))).withColumn("__id", F.monotonically_increasing_id()), "asked")
    kinds = asked.groupBy(F.col("label").alias("__label"), F.col("path").alias("__path"), F.col("target").alias("__target")).agg(F.min("__id").alias("pattern"))
    same = (F.col("label") == F.col("__label")) & (F.col("path") == F.col("__path")) & F.col("target").eqNullSafe(F.col("__target"))
    e = e.join(kinds, same)
    fits = F.when(F.col("label") == "BruteForce", F.col("uri").contains(F.col("path"))).otherwise(F.col("uri").startswith(F.col("path")))
    agree = F.col("host").isNull() | F.col("target").isNull() | (F.col("host") == F.col("target"))
    seen = r.join(asked, (F.col("__bucket") == F.col("__wb")) & (F.col("__method") == F.col("__asked")) & fits & agree).join(kinds, same).groupBy("pattern", "client", F.col("ts").alias("t")).agg(F.count("*").alias("n"))

    def counted_for(d: DataFrame, *rest: str) -> DataFrame:
        """The rows of ``d`` for their own clients and, with others, for all clients together."""
        d = d.withColumn("own", F.explode(F.array(F.lit(False), F.lit(True))) if others else F.lit(True))
        return d.select("pattern", "own", F.when(F.col("own"), F.col("client")).alias("client"), *rest)

    # At one time, starts (side 0) come before requests (1), and ends (2) behind them.
    points = counted_for(seen, "t", "n").select("*", F.lit(1).alias("side"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"))
    edges = e.withColumn("at", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(0).alias("side")), F.struct(F.col("end").alias("t"), F.lit(2).alias("side")))))
    edges = counted_for(edges.select("*", F.col("attacker").alias("client"), F.col("at.t").alias("t"), F.col("at.side").alias("side"), F.lit(0).cast("long").alias("n")), "t", "n", "side", "event_id")
    counted = running_ranges(points.unionByName(edges), ["client", "own", "pattern", "t", "side"], "n", "event_id", ["own", "side"])
    here = F.when(F.col("side") == 2, F.col("n_upto")).otherwise(-F.col("n_upto"))
    found = counted.groupBy("event_id").agg(F.sum(F.when(F.col("own"), here)).alias("a"), F.sum(F.when(~F.col("own"), here)).alias("all"))
    out = events.select("event_id", *carry).join(found, "event_id", "left")
    a = F.coalesce("a", F.lit(0).cast("long"))
    out = out.select("event_id", *carry, a.alias("requests_attacker"), (F.coalesce("all", F.lit(0).cast("long")) - a).alias("requests_other"))
    return out if others else out.drop("requests_other")


def ground_truth(events: DataFrame, evidence: DataFrame, requests: DataFrame) -> DataFrame:
    """The layered report: one row an event with flows, requests, levels of evidence and a note.

    Events as for ``attributed_requests``; ``evidence``: event_id, usable_flows, port_coverage, span.
    """
    d = attributed_requests(events.filter("event_id is not null"), requests, carry=("label",)).join(evidence.select("event_id", "usable_flows", "port_coverage", "span"), "event_id", "left")
    scan = (F.col("label") == "PortScan") & F.col("port_coverage").isNotNull()
    others = (F.col("label") == "BruteForce") & (F.col("requests_attacker") == 0) & (F.col("requests_other") > 0)
    note = F.when(others, F.concat(F.col("requests_other").cast("string"), F.lit(" request(s) of others, none of the attacker: not to be credited")))
    note = note.when(F.col("label") == "DoS", "effect not measured here").when(scan, F.concat(F.lit("port coverage "), F.col("port_coverage").cast("string"), F.lit(" of "), F.col("span").cast("string"))).otherwise("")
    return evidence_levels(d).select("event_id", "label", "usable_flows", "requests_attacker", "requests_other", "evidence", note.alias("note"))


def session_gates(sessions: DataFrame, start: float, end: float, min_ok: int, min_rate: float) -> DataFrame:
    """One row: sessions, succeeded, success_rate, outside the capture, overlapping it, repeated ids, and the verdict."""
    ids = sessions.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))
    d = sessions.agg(
        F.count("*").alias("sessions"), F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(~((F.col("start") >= start) & (F.col("end") <= end))).alias("not_inside"), F.count_if((F.col("start") < end) & (F.col("end") > start)).alias("overlapping"),
    ).join(ids)
    rate = F.when(F.col("sessions") > 0, F.col("succeeded") / F.col("sessions")).otherwise(F.lit(0.0))
    return d.withColumn("success_rate", rate).withColumn("passed", (F.col("succeeded") >= min_ok) & (F.col("success_rate") >= min_rate) & (F.col("repeated") == 0) & (F.col("not_inside") == 0))
