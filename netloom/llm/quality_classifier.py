"""Quality classifier: a sparse ensemble of rules over text statistics, run as Spark expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import BLANKS, free, words

#: Labelled documents that the rules are learned on, those with the smallest hash of their id.
SAMPLE = 6000
TREES, DEPTH, LEAST_ROWS, CUTS, RATE = 40, 3, 10, 32, 0.2
#: Weight of the lasso penalty beside the mean logistic loss, and steps of the solver.
PENALTY, STEPS = 0.002, 600
CLASSES = {"lower": r"\p{Ll}+", "blank": f"[{BLANKS}]+", "upper": r"\p{Lu}+", "digit": r"\p{N}+", "bang": r"[!]+", "stop": r"[.,;:?]+", "bar": r"[|]+"}
STATISTICS = ("n_words", "mean_word", "upper_share", "digit_share", "bang_share", "stop_share", "bar_share", "other_share", "distinct_share", "same_line_share", "line_words")

#: A rule: conditions (statistic, True for "at most" or False for "above", bound), all of which hold.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) with the STATISTICS of each whole text, as doubles.

    Null and empty texts have 0 for each of them.
    """
    held = [f"c__{c}" for c in carry]
    df = docs.select(*[F.col(c).alias(f"c__{c}") for c in carry], F.coalesce("text", F.lit("")).alias("__t0"), words(F.col("text")).alias("__words"))
    for i, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"__t{i + 1}", F.regexp_replace(f"__t{i}", pattern, ""))
        df = df.withColumn(f"__n{i}", F.length(f"__t{i}") - F.length(f"__t{i + 1}"))
    lines = F.filter(F.split("__t0", "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    counts = [F.col(f"__n{i}").cast("double").alias(f"__{name}") for i, name in enumerate(CLASSES)]
    df = df.select(*held, *counts, F.length(f"__t{len(CLASSES)}").cast("double").alias("__other"), F.size("__words").cast("double").alias("__n"), F.size(F.array_distinct("__words")).cast("double").alias("__distinct"), lines.alias("__lines"))
    df = df.withColumns({"__n_lines": F.size("__lines").cast("double"), "__n_kinds": F.size(F.array_distinct("__lines")).cast("double")})
    signs = reduce(lambda a, b: a + b, [F.col(f"__{name}") for name in (*CLASSES, "other") if name != "blank"])
    of = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    made = {
        "n_words": c("__n"), "mean_word": of(signs, c("__n")), "upper_share": of(c("__upper"), c("__upper") + c("__lower")),
        "digit_share": of(c("__digit"), signs), "bang_share": of(c("__bang"), signs), "stop_share": of(c("__stop"), signs), "bar_share": of(c("__bar"), signs), "other_share": of(c("__other"), signs),
        "distinct_share": of(c("__distinct"), c("__n")), "same_line_share": of(c("__n_lines") - c("__n_kinds"), c("__n_lines")), "line_words": of(c("__n"), c("__n_lines")),
    }
    return df.select(*held, *[made[s].alias(s) for s in STATISTICS])


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, paths: list[Rule], out: np.ndarray) -> None:
    """Grow a tree of DEPTH levels on gradients; add the path to each node to ``paths`` and its step to ``out``."""
    g, h = gradient[rows], hessian[rows]
    out[rows] = -g.sum() / (h.sum() + 1.0)
    if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
        return
    gain = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, -1, 0.0)
    for j, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        k = np.searchsorted(bounds, x[rows, j], side="left")
        n, gs, hs = (np.cumsum(np.bincount(k, w, minlength=len(bounds) + 1))[:-1] for w in (None, g, h))
        ok = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS)
        if ok.any():
            gains = np.where(ok, gain(gs, hs) + gain(g.sum() - gs, h.sum() - hs) - gain(g.sum(), h.sum()), -1.0)
            if gains.max() > best[0]:
                best = (gains.max(), j, float(bounds[gains.argmax()]))
    _, j, bound = best
    if j < 0:
        return
    for low in (True, False):
        side = rows[(x[rows, j] <= bound) == low]
        longer = (*path, (STATISTICS[j], low, bound))
        paths.append(longer)
        grow(x, gradient, hessian, cuts, side, longer, paths, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` the rule is true for."""
    return np.logical_and.reduce([(x[:, STATISTICS.index(s)] <= b) == low for s, low, b in rule])


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss and PENALTY times the weights' sum (FISTA)."""
    w, at, t = np.zeros(r.shape[1] + 1), np.zeros(r.shape[1] + 1), 1.0
    design = np.hstack([np.ones((len(r), 1)), r])
    step = 4.0 * len(r) / max(np.linalg.norm(design, 2) ** 2, 1e-9)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -35, 35)))
        new = at - step * (design.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / faster * (new - w), new, faster
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from statistics and labels 0 or 1.

    Boosted trees give the rules: each path from a root to a node. Rules that hold for the same
    rows count once (the shortest stays); the lasso keeps few. No rows: intercept 0. One label
    only: that label's smoothed log odds.
    """
    if not len(y):
        return 0.0, []
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if y.min() == y.max():
        return base, []
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1]))
        cuts.append(values[values < x[:, j].max()])
    margin, paths = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), paths, out)
        margin += RATE * out
    different: dict[bytes, Rule] = {}
    for rule in sorted(set(paths), key=lambda r: (len(r), r)):
        true = holds(rule, x)
        if true.any() and not true.all():
            different.setdefault(np.packbits(true).tobytes(), rule)
    rules = list(different.values())
    if not rules:
        return base, []
    bias, w = lasso(np.column_stack([holds(r, x) for r in rules]).astype(np.float64), y)
    return bias, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v != 0]


def fit(labelled: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """``learn`` from ``labelled`` (doc_id, text, label), which the caller bounds by SAMPLE rows.

    Only the statistics come to the driver. Null labels are left out.
    """
    rows = statistics(labelled.filter("label is not null"), ["label"]).collect()
    data = sorted([float(v) for v in r] for r in rows)  # in one order on every run
    found = np.array(data).reshape(len(data), len(STATISTICS) + 1)
    return learn(found[:, 1:], found[:, 0])


def expression(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The score (0 to 1) as an expression over the STATISTICS columns."""
    bias, rules = model
    total = F.lit(bias)
    for rule, weight in rules:
        true = reduce(lambda a, b: a & b, [F.col(s) <= b if low else F.col(s) > b for s, low, b in rule])
        total = total + F.when(true, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: tuple[float, list[tuple[Rule, float]]], carry: list[str], threshold: float = 0.3) -> DataFrame:
    """The ``carry`` columns of ``docs`` (text) with score and predicted (score >= threshold).

    A result whose name is also carried gets the ending ``_found``. Null and empty texts are scored
    by their statistics, which are 0; texts of any length count whole. Equal rows, and texts with
    the same statistics, score alike. No rows give none.
    """
    judged = statistics(docs, carry).withColumn("__score", expression(model))
    return judged.select(*[F.col(f"c__{c}").alias(c) for c in carry], F.col("__score").alias(free("score", carry)), (F.col("__score") >= threshold).cast("int").alias(free("predicted", carry)))
