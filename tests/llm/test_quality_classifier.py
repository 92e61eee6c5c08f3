import math

import numpy as np
from pyspark.sql import functions as F

from netloom.llm import quality_classifier as qc
from netloom.llm.queries import op4_quality_classifier

SCHEMA = "doc_id long, text string, score string, label int"


def plain_statistics(text):
    import regex

    text = text or ""
    ws = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    n = {k: sum(map(len, regex.findall(p, text))) for k, p in qc.CLASSES.items()}
    n["other"] = len(text) - sum(n.values())
    signs = sum(v for k, v in n.items() if k != "blank")
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    of = lambda a, b: a / b if b else 0.0
    return [len(ws), of(signs, len(ws)), of(n["upper"], n["upper"] + n["lower"]), *[of(n[k], signs) for k in ("digit", "bang", "stop", "bar", "other")],
            of(len(set(ws)), len(ws)), of(len(lines) - len(set(lines)), len(lines)), of(len(ws), len(lines))]


TEXTS = [None, "", "  \n ", "Plain words, here.\nAnd more.", "SHOUT!! NOW!!", "a | b | c 12 ½", "x\nx\nx\n\ny", "Été ñ ß 日本 🙂", "same " * 60000]


def test_statistics_against_plain_version(spark):
    df = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r["c__doc_id"]: list(r)[1:] for r in qc.statistics(df, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], plain_statistics(t)), t


def test_expression_agrees_with_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(qc.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 8] <= 0.5)).astype(float)
    bias, rules = qc.learn(x, y)
    margin = bias + sum(w * qc.holds(r, x) for r, w in rules)
    assert ((margin > 0) == (y == 1)).mean() > 0.97 and len(rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(qc.STATISTICS))
    got = [r[0] for r in df.select(qc.expression((bias, rules))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
    assert qc.learn(x, y) == (bias, rules)


def plain_paths(x, gradient, hessian, cuts, rows, path=()):
    """All splits of a tree, each found by trying every column and cut."""
    step = lambda r: sum(gradient[i] for i in r) ** 2 / (sum(hessian[i] for i in r) + 1.0)
    if len(path) == qc.DEPTH or len(rows) < 2 * qc.LEAST_ROWS:
        return []
    best = (1e-6, None)
    for j, bounds in enumerate(cuts):
        for b in bounds:
            low = [i for i in rows if x[i, j] <= b]
            high = [i for i in rows if x[i, j] > b]
            gain = step(low) + step(high) - step(rows) if min(len(low), len(high)) >= qc.LEAST_ROWS else -1.0
            if gain > best[0] + 1e-12:
                best = (gain, (j, float(b), low, high))
    if best[1] is None:
        return []
    j, b, low, high = best[1]
    out = []
    for is_low, side in ((True, low), (False, high)):
        longer = (*path, (qc.STATISTICS[j], is_low, b))
        out += [longer, *plain_paths(x, gradient, hessian, cuts, side, longer)]
    return out


def test_a_tree_against_brute_force():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((120, len(qc.STATISTICS))), 2)
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 8)[1:-1])) for j in range(x.shape[1])]
    p = np.full(120, y.mean())
    paths, out = [], np.zeros(120)
    qc.grow(x, p - y, p * (1 - p), cuts, np.arange(120), (), paths, out)
    assert len(paths) > 4 and paths == plain_paths(x, p - y, p * (1 - p), cuts, list(range(120)))
    for leaf in {tuple(sorted(r for r in paths if qc.holds(r, x)[i])) for i in range(120)}:
        deepest = max(leaf, key=len)
        rows = qc.holds(deepest, x)
        if not any(len(r) > len(deepest) and r[: len(deepest)] == deepest for r in paths):
            assert np.allclose(out[rows], -(p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + 1))


def test_lasso_is_at_its_minimum():
    rng = np.random.default_rng(6)
    r = (rng.random((800, 12)) < 0.4).astype(float)
    y = (rng.random(800) < 1 / (1 + np.exp(-(2.5 * r[:, 0] - 2 * r[:, 3] - 0.2)))).astype(float)
    bias, w = qc.lasso(r, y)
    p = 1 / (1 + np.exp(-(bias + r @ w)))
    slope = r.T @ (p - y) / len(y)
    # The conditions that hold at the minimum only: no slope of the intercept, PENALTY against each weight, at most that where there is none.
    assert abs((p - y).mean()) < 1e-4 and 0 < (w != 0).sum() < 12
    assert np.allclose(slope[w != 0], -np.sign(w[w != 0]) * qc.PENALTY, atol=2e-4) and (np.abs(slope[w == 0]) <= qc.PENALTY + 2e-4).all()


def test_ties_and_clashing_names(spark):
    rows = spark.createDataFrame([(i, f"word{i % 2} here", "s", i % 2) for i in range(40)], SCHEMA)
    model = qc.fit(rows)
    got = qc.score(rows, model, ["score", "text"])
    assert got.columns == ["score", "text", "score_found", "predicted"]
    by = {}
    for r in got.collect():
        by.setdefault(r.text, set()).add(r.score_found)
    assert len(by) == 2 and all(len(v) == 1 for v in by.values())  # same statistics, same score


def test_few_labels_and_empty_tables(spark):
    assert qc.learn(np.empty((0, 11)), np.empty(0)) == (0.0, [])
    assert qc.learn(np.ones((3, 11)), np.ones(3)) == (math.log(4), [])
    empty = spark.createDataFrame([], SCHEMA)
    model = qc.fit(empty)
    assert model == (0.0, []) and qc.score(empty, model, ["doc_id"]).count() == 0
    rows = spark.createDataFrame([(1, "a b", "s", 1), (1, "a b", "s", 1), (None, None, None, None)], SCHEMA)
    got = qc.score(rows, qc.fit(rows), ["doc_id"]).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op4_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
