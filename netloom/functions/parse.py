"""Parsing of text cells into typed columns; what cannot be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "-", "(empty)", "nan", "None")
WIDE = 10**9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """A double; missing markers, junk and NaN are null, infinities stay for the contract to find."""
    text = F.trim(_col(c).cast("string"))
    value = F.when(~text.isin(*MISSING), text).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(c: Column | str) -> Column:
    """Whether a cell parses to a finite number (null counts as no)."""
    v = number(c)
    return F.coalesce(F.abs(v) < float("inf"), F.lit(False))


def whole(c: Column | str) -> Column:
    return F.trim(_col(c).cast("string")).try_cast("int")


def blank(c: Column | str) -> Column:
    """Whether a label cell is empty: null, blank, ``nan`` or ``None``."""
    c = _col(c)
    return c.isNull() | F.trim(c.cast("string")).isin("", "nan", "None")


def epoch(c: Column | str, naive: str = "reject") -> Column:
    """ISO-8601 text as seconds since 1970; a time without zone is null, or UTC if ``naive`` is "utc"."""
    text = F.trim(_col(c))
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    whole_text = F.when(zoned, text)
    if naive == "utc":
        whole_text = whole_text.otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(whole_text)) / 1e6


def seconds(c: Column | str) -> Column:
    """A timestamp without zone as seconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(c).cast("timestamp_ntz")) / 1e6


def port_low(spec: Column | str) -> Column:
    return F.split_part(_col(spec), F.lit("-"), F.lit(1)).try_cast("int")


def port_high(spec: Column | str) -> Column:
    spec = _col(spec)
    return F.when(spec.contains("-"), F.split_part(spec, F.lit("-"), F.lit(2))).otherwise(spec).try_cast("int")


def port_span(spec: Column | str) -> Column:
    """Ports in a spec (``443`` or ``1-1024``); a range that can't be parsed is wider than any."""
    return F.coalesce(port_high(spec) - port_low(spec) + 1, F.lit(WIDE))


def port_matches(port: Column | str, spec: Column | str) -> Column:
    p = whole(port)
    return F.coalesce(p.between(port_low(spec), port_high(spec)), F.lit(False))


def key_values(c: Column | str) -> Column:
    """``k=v;k=v`` as a map; null if a fragment has no ``=``, a key is empty or one comes twice."""
    parts = F.filter(F.transform(F.split(_col(c), ";"), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(parts, lambda x: F.trim(F.substring_index(x, "=", 1)))
    values = F.transform(parts, lambda x: F.trim(F.substr(x, F.instr(x, "=") + 1)))
    good = F.forall(parts, lambda x: x.contains("=")) & F.forall(keys, lambda k: k != "") & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(good, F.map_from_arrays(keys, values))


def safe_id(c: Column | str) -> Column:
    return _col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$")


def hostname(c: Column | str) -> Column:
    """DNS rule: labels of letters, digits and inner hyphens, 253 characters at most."""
    c = _col(c)
    return c.rlike(r"^(?=.{1,253}$)([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$")


def ipv4(c: Column | str) -> Column:
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(_col(c).rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))
