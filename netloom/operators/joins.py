"""Key joins with last-wins builds, join accounting, referential checks and manifest diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in ``order``; keys that are null have no row."""
    others = [c for c in df.columns if c not in keys]
    some = df.dropna(subset=keys)
    return some.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.col(order)).alias("__r")).select(*keys, "__r.*")


def attach(left: DataFrame, right: DataFrame, key: str, order: str, prefix: str) -> DataFrame:
    """``left`` with the columns of the last ``right`` row of its key, prefixed; ``<prefix>joined`` tells if there was one."""
    build = last_by_key(right, [key], order)
    build = build.select(F.col(key), *[F.col(f"`{c}`").alias(prefix + c) for c in build.columns if c not in (key, order)], F.lit(True).alias(f"{prefix}joined"))
    return left.join(build, key, "left").withColumn(f"{prefix}joined", F.coalesce(f"{prefix}joined", F.lit(False)))


def join_accounting(records: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(records, matching, orphan, missing_key, join_rate) of ``records`` against the keys of ``known``."""
    keys = known.select(F.col(key).alias("__k")).filter("__k is not null").distinct().withColumn("__hit", F.lit(1))
    joined = records.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("__t"), F.col(key).alias("__r")).join(keys, F.col("__r") == F.col("__k"), "left")
    out = joined.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("__t").isNotNull() & F.col("__hit").isNotNull()).alias("matching"),
        F.count_if(F.col("__t").isNotNull() & F.col("__hit").isNull()).alias("orphan"),
        F.count_if(F.col("__t").isNull()).alias("missing_key"),
    )
    return out.withColumn("join_rate", F.when(F.col("records") > 0, F.round(F.col("matching") / F.col("records"), 4)).otherwise(F.lit(0.0)))


def orphans(records: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows of ``records`` whose key ``known`` lacks."""
    keys = known.select(F.col(known_key or key).alias("__k"))
    return records.join(keys, F.col(key) == F.col("__k"), "left_anti")


def row_identity(audit: DataFrame, source: DataFrame, key: str, same: list[str], near: dict[str, float]) -> DataFrame:
    """(rows, missing, mismatched) of ``audit`` against ``source`` by key.

    ``same`` columns must agree as text whatever their case, ``near`` ones within a tolerance; nulls never agree.
    """
    s = source.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in [*same, *near]])
    j = audit.join(s, F.col(key) == F.col("__k"), "left")
    agree = F.lit(True)
    for c in same:
        agree = agree & (F.lower(F.col(c).cast("string")) == F.lower(F.col(f"__{c}").cast("string")))
    for c, tolerance in near.items():
        agree = agree & (F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance)
    found = F.col("__k").isNotNull()
    return j.agg(F.count("*").alias("rows"), F.count_if(~found).alias("missing"), F.count_if(found & ~F.coalesce(agree, F.lit(False))).alias("mismatched"))


def manifest_diff(reference: DataFrame, target: DataFrame, key: str = "path", value: str = "sha256", extras: bool = True) -> DataFrame:
    """(key, status): missing and mismatched entries of ``target``, and extra ones if wanted."""
    r = reference.select(F.col(key).alias("rk"), F.col(value).alias("rv"), F.lit(True).alias("in_r"))
    t = target.select(F.col(key).alias("tk"), F.col(value).alias("tv"), F.lit(True).alias("in_t"))
    j = r.join(t, F.col("rk") == F.col("tk"), "full_outer" if extras else "left")
    status = F.when(F.col("in_t").isNull(), "missing").when(F.col("in_r").isNull(), "extra").when(~F.col("rv").eqNullSafe(F.col("tv")), "mismatched")
    return j.select(F.coalesce("rk", "tk").alias(key), status.alias("status")).filter("status is not null")


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right) of keys that are not exactly once on both sides."""
    a = left.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n_left"))
    b = right.groupBy(F.col(key).alias("k2")).agg(F.count("*").alias("n_right"))
    j = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    j = j.select(F.coalesce("k", "k2").alias(key), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    return j.filter("n_left <> 1 or n_right <> 1")


def same_projection(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(only_a, only_b): rows of each side, with repeats, that the other side lacks, compared as text."""
    text = lambda d: d.select(*[F.col(c).cast("string") for c in columns])
    x, y = text(a), text(b)
    extra_a = x.exceptAll(y).agg(F.count("*").alias("only_a"))
    extra_b = y.exceptAll(x).agg(F.count("*").alias("only_b"))
    return extra_a.join(extra_b)


def unknown_values(df: DataFrame, column: str, domain: DataFrame, domain_column: str, ignore: tuple[str, ...] = ("none",)) -> DataFrame:
    """Distinct values of a column that the domain lacks."""
    mine = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin(*ignore))
    return mine.distinct().join(domain.select(F.col(domain_column).alias("__d")), F.col("value") == F.col("__d"), "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice or more, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def overlaps_predecessor(df: DataFrame, by: list[str], start: str, end: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows that start before the one before them (by start, end) has ended."""
    w = Window.partitionBy(*by).orderBy(start, end)
    return df.withColumn("previous_end", F.lag(end).over(w)).filter(F.col(start) < F.col("previous_end") - tolerance)


def mirrored(flows: DataFrame, client: str, victim: str, tcp_port: int | None = None, udp_port: int | None = None) -> DataFrame:
    """One row: what a sensor saw of flows (src, dst, proto, port, resp_pkts) between two hosts, problems, and confirmed.

    A flow alone may be one-sided; only packets of the response show that both directions are
    mirrored, on the expected ports where such are given.
    """
    forth = (F.col("src") == client) & (F.col("dst") == victim)
    answered = forth & (F.coalesce("resp_pkts", F.lit(0)) > 0)
    at = lambda proto, port: answered & (F.lower("proto") == proto) & (F.col("port") == port) if port is not None else F.lit(False)
    seen = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    d = flows.agg(
        seen(forth).alias("client_to_victim"), seen(answered).alias("victim_responded"), seen((F.col("src") == victim) & (F.col("dst") == client)).alias("victim_to_client"),
        seen(at("tcp", tcp_port)).alias("tcp_answered"), seen(at("udp", udp_port)).alias("udp_answered"),
    )
    problems = [F.when(~F.col("client_to_victim"), "no flow from client to victim").when(~F.col("victim_responded"), "no response was mirrored")]
    problems += [F.when(~F.col(f"{k}_answered"), f"no answered {k} flow on port {p}") for k, p in (("tcp", tcp_port), ("udp", udp_port)) if p is not None]
    d = d.withColumn("problems", F.array_compact(F.array(*problems)))
    return d.withColumn("confirmed", F.size("problems") == 0)


def audit_events(audit: DataFrame, events: DataFrame, padding: float = 1.0) -> DataFrame:
    """(event_id, usable, ambiguous, wrong_label, off_window, unknown) of audit rows (matched_event_id, label, ambiguous, ts, duration) against events.

    Events: event_id, label, start, end. A row that names an event must have its label and touch its
    window, give or take the padding; rows that name an event nobody declared are ``unknown``.
    """
    e = events.select(F.col("event_id").cast("string").alias("__e"), F.col("label").alias("__label"), "start", "end")
    rows = audit.filter(F.coalesce(F.trim(F.col("matched_event_id")), F.lit("")) != "")
    j = rows.join(e, F.trim(F.col("matched_event_id")) == F.col("__e"), "full_outer")
    named, known = F.col("matched_event_id").isNotNull(), F.col("__e").isNotNull()
    last = F.col("ts") + F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0))
    inside = (F.col("ts") <= F.col("end") + padding) & (last >= F.col("start") - padding)
    clear = F.coalesce(F.col("ambiguous"), F.lit(0)) == 0
    return j.groupBy(F.coalesce("__e", F.trim("matched_event_id")).alias("event_id")).agg(
        F.count_if(named & clear).alias("usable"), F.count_if(named & ~clear).alias("ambiguous"),
        F.count_if(named & known & ~F.col("label").eqNullSafe(F.col("__label"))).alias("wrong_label"),
        F.count_if(named & known & ~F.coalesce(inside, F.lit(False))).alias("off_window"), F.count_if(named & ~known).alias("unknown"),
    )


def event_bijection(claimed: DataFrame, declared: DataFrame, slack: float = 1.0) -> DataFrame:
    """(event_id, problem) of events (event_id, label, start, end) that two sides don't agree on: ids, labels, windows within ``slack`` seconds."""
    a = claimed.select(F.col("event_id").cast("string").alias("a"), F.col("label").alias("la"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = declared.select(F.col("event_id").cast("string").alias("b"), F.col("label").alias("lb"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    near = F.coalesce((F.abs(F.col("sa") - F.col("sb")) <= slack) & (F.abs(F.col("ea") - F.col("eb")) <= slack), F.lit(False))
    problem = F.when(F.col("b").isNull(), "not declared").when(F.col("a").isNull(), "not claimed").when(~F.col("la").eqNullSafe(F.col("lb")), "other label").when(~near, "other window")
    return j.select(F.coalesce("a", "b").alias("event_id"), problem.alias("problem")).filter("problem is not null")


def label_sides(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """(label, side): every label of either frame, and whether ``both`` or only ``a`` or ``b`` has it."""
    x = a.select(F.col(label).alias("x")).distinct()
    y = b.select(F.col(label).alias("y")).distinct()
    j = x.join(y, F.col("x").eqNullSafe(F.col("y")) , "full_outer").withColumns({"ix": F.col("x").isNotNull(), "iy": F.col("y").isNotNull()})
    return j.select(F.coalesce("x", "y").alias("label"), F.when(F.col("ix") & F.col("iy"), "both").when(F.col("ix"), "a").otherwise("b").alias("side")).filter("label is not null")


def without(df: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key the held-out rows lack."""
    return df.join(held_out.select(F.col(key).alias("__h")), F.col(key).eqNullSafe(F.col("__h")), "left_anti")


def members(df: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The rows of ``df`` that belong to one of ``runs`` (run_id); their number is the plan's, so they are broadcast when Spark finds them small."""
    return df.join(runs.select(F.col("run_id").alias("__run")).distinct(), F.col(run) == F.col("__run"), "left_semi")


def fallback_rows(df: DataFrame, label: str = "label", duration: str = "duration", benign: str = "BENIGN") -> DataFrame:
    """(attack_rows, fallback_rows, fallback_rate): attack rows, and those of them that have no positive duration."""
    attack = F.coalesce(F.col(label) != benign, F.lit(False))
    d = df.agg(F.count_if(attack).alias("attack_rows"), F.count_if(attack & (F.coalesce(F.col(duration), F.lit(0.0)) <= 0)).alias("fallback_rows"))
    return d.withColumn("fallback_rate", F.when(F.col("attack_rows") > 0, F.col("fallback_rows") / F.col("attack_rows")).otherwise(F.lit(0.0)))


def absent_digests(wanted: DataFrame, found: DataFrame, digest: str = "sha256") -> DataFrame:
    """Rows of ``wanted`` (a word list each, say) whose digest no found file has, whatever its case."""
    f = found.select(F.lower(F.col(digest)).alias("__d"))
    return wanted.join(f, F.lower(F.col(digest)) == F.col("__d"), "left_anti")
