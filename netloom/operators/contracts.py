"""Data-quality rules, declared once and evaluated together in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import features as ft
from netloom.functions.parse import blank, number


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``broken`` is true; warnings don't fail a contract.

    ``parsed`` names the text columns that the rule reads as numbers, by ``num`` and ``raw``.
    """

    name: str
    broken: Column
    severity: str = "error"
    parsed: tuple[str, ...] = ()


def num(column: str) -> Column:
    """The number in a cell, parsed once for all rules."""
    return F.col(f"`__num_{column}`")


def raw(column: str) -> Column:
    """The trimmed text of a cell."""
    return F.col(f"`__raw_{column}`")


def prepared(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with each column that rules parse, parsed once."""
    names = list(dict.fromkeys(c for r in rules for c in r.parsed))
    return df.select("*", *[number(ft.quoted(c)).alias(f"__num_{c}") for c in names], *[F.trim(ft.quoted(c).cast("string")).alias(f"__raw_{c}") for c in names])


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, violations) of every rule, from a single pass over ``df``."""
    counts = prepared(df, rules).agg(*[F.count_if(r.broken).alias(f"r_{i}") for i, r in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r_{i}").alias("violations")) for i, r in enumerate(rules)])
    return counts.select(F.explode(cells).alias("v")).select("v.*")


def examples(df: DataFrame, rule: Rule, n: int = 5) -> DataFrame:
    """A few rows that break a rule, for a message."""
    return prepared(df, [rule]).filter(F.coalesce(rule.broken, F.lit(False))).select(*[ft.quoted(c) for c in df.columns]).limit(n)


def require(df: DataFrame, rules: list[Rule]) -> None:
    """Raise an error that names every broken rule of severity error."""
    bad = evaluate(df, rules).filter("violations > 0 and severity = 'error'").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations} row(s)" for r in bad))


def numeric_rules(columns: list[str], counts: list[str]) -> list[Rule]:
    """No infinities, no negatives, whole counts; missing is allowed."""
    rules = []
    for c in columns:
        v = num(c)
        rules += [Rule(f"{c}: inf", F.abs(v) == float("inf"), parsed=(c,)), Rule(f"{c}: negative", (v < 0) & (F.abs(v) < float("inf")), parsed=(c,))]
        if c in counts:
            rules.append(Rule(f"{c}: fractional", (F.abs(v) < float("inf")) & (v != F.floor(v)), parsed=(c,)))
    return rules


def domain_rules(domains: dict[str, list[str]], severity: str = "error") -> list[Rule]:
    return [Rule(f"{c}: out of domain", F.col(c).isNotNull() & ~F.col(c).isin(*values), severity) for c, values in domains.items()]


def common_rules(columns: list[str]) -> list[Rule]:
    """The value domains of the flow features that ``columns`` has."""
    rules = numeric_rules([c for c in ft.NUMERIC if c in columns], ft.COUNTS)
    if "sni_present" in columns:
        rules.append(Rule("sni_present: not 0 or 1", ~num("sni_present").isin(0.0, 1.0), parsed=("sni_present",)))
    rules += domain_rules({c: v for c, v in ft.DOMAINS.items() if c in columns})
    return rules + (domain_rules({"alpn": ft.ALPN}, "warning") if "alpn" in columns else [])


def off_by(stored: Column, expected: Column, absolute: float = 0.02, relative: float = 0.02) -> Column:
    """Whether two finite numbers differ by more than the tolerance."""
    fine = (F.abs(stored) < float("inf")) & (F.abs(expected) < float("inf"))
    return fine & (F.abs(stored - expected) > absolute + relative * F.abs(expected))


def relational_rules() -> list[Rule]:
    """Derived features must agree with what they derive from; a rate needs a positive duration."""
    v = {c: num(c) for c in ft.NUMERIC}
    dur = F.when(v["flow_duration"] > 0, v["flow_duration"])
    idle = v["flow_duration"] <= 0
    rules = [
        *[(f"{c}: finite without duration", idle & (F.abs(v[c]) < float("inf"))) for c in ("flow_bytes_s", "flow_pkts_s")],
        ("down_up_ratio: inconsistent", off_by(v["down_up_ratio"], F.when(v["tot_fwd_pkts"].isNotNull(), v["tot_bwd_pkts"] / F.greatest(v["tot_fwd_pkts"], F.lit(1.0))))),
        ("flow_bytes_s: inconsistent", off_by(v["flow_bytes_s"], (v["totlen_fwd_bytes"] + v["totlen_bwd_bytes"]) / dur)),
        ("flow_pkts_s: inconsistent", off_by(v["flow_pkts_s"], (v["tot_fwd_pkts"] + v["tot_bwd_pkts"]) / dur)),
    ]
    return [Rule(name, broken, parsed=tuple(ft.NUMERIC)) for name, broken in rules]


def junk_rules(columns: list[str]) -> list[Rule]:
    """Cells that are neither missing nor a number."""
    return [Rule(f"{c}: not a number", raw(c).isNotNull() & ~raw(c).isin("", "nan", "NaN", "None", "-", "(empty)") & num(c).isNull(), parsed=(c,)) for c in columns]


def label_rules(column: str = "label", allowed: list[str] | None = None) -> list[Rule]:
    known = ft.LABELS if allowed is None else allowed
    return [Rule(f"{column}: blank", blank(column)), Rule(f"{column}: unknown", ~blank(column) & ~F.trim(F.col(column).cast("string")).isin(*known))]


def unknown_labels(df: DataFrame, column: str = "label", allowed: list[str] | None = None) -> DataFrame:
    """Distinct labels that are not allowed, blanks left out."""
    known = ft.LABELS if allowed is None else allowed
    return df.filter(~blank(column)).select(F.col(column).cast("string").alias("label")).distinct().filter(~F.col("label").isin(*known)).orderBy("label")


def meter_rules(columns: list[str]) -> list[Rule]:
    return numeric_rules([c for c in ft.METER if c in columns], ft.METER_COUNTS)


#: Connection-log columns with numbers, those that are counts or ports, and the essentials.
CONN_NUMBERS = ["duration", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts"]
CONN_COUNTS = ["orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts"]
CONN_ESSENTIALS = ["uid", "id.orig_h", "id.resp_h", "proto", "id.resp_p"]


def conn_rules(columns: list[str]) -> list[Rule]:
    """Raw connection rows: numbers finite, not negative, counts whole, ports 1 to 65535, essentials and time there."""
    here = [c for c in CONN_NUMBERS if c in columns]
    rules = junk_rules(here) + numeric_rules(here, CONN_COUNTS)
    for c in ("id.orig_p", "id.resp_p"):
        if c in columns:
            p = num(c)
            rules.append(Rule(f"{c}: not a port", p.isNotNull() & ((p < 1) | (p > 65535) | (p != F.floor(p))), parsed=(c,)))
    rules += [Rule(f"{c}: blank", F.coalesce(raw(c).isin("", "-"), F.lit(True)), parsed=(c,)) for c in CONN_ESSENTIALS if c in columns]
    return [*rules, Rule("ts: not finite", ~F.coalesce(F.abs(num("ts")) < float("inf"), F.lit(False)), parsed=("ts",))]


def official_columns(df: DataFrame, with_time: bool = True) -> list[str]:
    """Official columns that a split-ready frame lacks."""
    needed = (["run_id", "timestamp"] if with_time else []) + ft.COMMON + ["label"]
    return [c for c in needed if c not in df.columns]


def dataset_contract(df: DataFrame, with_time: bool = True) -> DataFrame:
    """(rule, severity, violations) of the whole contract of a split-ready frame."""
    rules = common_rules(df.columns) + junk_rules([c for c in ft.NUMERIC if c in df.columns]) + meter_rules(df.columns)
    if all(c in df.columns for c in ft.NUMERIC):
        rules += relational_rules()
    if "label" in df.columns:
        rules += label_rules()
    out = evaluate(df, rules)
    lacking = official_columns(df, with_time)
    if lacking:
        rows = [(f"{c}: missing column", "error", 1) for c in lacking]
        out = out.unionByName(df.sparkSession.createDataFrame(rows, "rule string, severity string, violations long"))
    return out


def reconcile(observed: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """(key, observed, claimed) of the keys whose numbers differ; an absent one counts as 0."""
    a = observed.select(F.col(key).alias("k"), F.col("n").alias("o"))
    b = claimed.select(F.col(key).alias("k2"), F.col("n").alias("c"))
    j = a.join(b, F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    j = j.select(F.coalesce("k", "k2").alias(key), F.coalesce("o", F.lit(0)).alias("observed"), F.coalesce("c", F.lit(0)).alias("claimed"))
    return j.filter("observed <> claimed")


def temporal_coherence(rows: DataFrame, ts: str, start: float, end: float, slack: float = 5.0) -> DataFrame:
    """(rows, unreadable, outside): times that are no finite number, and those beyond the capture and its slack."""
    v = number(ts)
    fine = F.coalesce(F.abs(v) < float("inf"), F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(~fine).alias("unreadable"), F.count_if(fine & ~v.between(start - slack, end + slack)).alias("outside"))
