import math

import numpy as np
import pytest

from netloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, cls string"


def plain(rows):
    n = len(rows)
    good = [r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], dtype=np.float32).astype(np.float64) if g else None for r, g in zip(rows, good, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    near = [[j for j in range(n) if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                if group[j] < group[i]:
                    group[i], changed = group[j], True
    least = {}
    for i, g in enumerate(group):
        known = [x for x in (least.get(g), rows[i][0]) if x is not None]
        least[g] = min(known, default=None)
    return [(r[0], len(near[i]), least[group[i]], r[0] is not None and r[0] == least[group[i]]) for i, r in enumerate(rows)]


def check(spark, rows):
    got = [tuple(r) for r in ed.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def clusters(seed, n, spread, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12 + 1, size))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + spread * rng.standard_normal(size) / math.sqrt(size)
        out.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(2)), "c"))
    return out


@pytest.mark.parametrize("few,block", [(16, 4096), (16, 16), (1, 16)])
def test_clusters_against_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(ed, "FEW_BLOCKS", few)
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "AT_ONCE", 7)
    rows = clusters(2, 300, 0.14)
    rows += [(1000 + i, r[1], r[2], "c") for i, r in enumerate(rows[:20])] + [(2000, [2 * x for x in rows[0][1]], rows[0][2], "c")]
    assert sum(r[1] for r in plain(rows)) > 100
    check(spark, rows)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [(1, a, 1, None), (2, b, 1, "x"), (3, a, None, "x"), (4, None, 1, "x"), (5, [0.0, 0.0, 0.0], 1, "x"), (6, [1.0, None, 0.0], 1, "x"),
            (7, [1.0, float("nan"), 0.0], 1, "x"), (8, [float("inf"), 0.0, 0.0], 1, "x"), (9, a, 2, "x"), (9, a, 2, "x"), (None, a, 2, "x"), (None, a, 3, "x"),
            (11, [1.0, 0.0], 1, "x"), (12, [3e38, 3e38, 0.0], 4, "x"), (13, [1e-38, 1e-38, 0.0], 4, "x"), (14, [], 1, "x"), (15, [2.0], 5, "x"), (16, [3.0], 5, "x")]
    check(spark, rows)
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_codes_lose_no_pair():
    rng = np.random.default_rng(4)
    x = ed.units(rng.standard_normal((400, 64)))
    away = rng.standard_normal((400, 64))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    angle = np.arccos(rng.uniform(0.975, 1, 400))[:, None]
    y = np.cos(angle) * x + np.sin(angle) * ed.units(away)
    near = x @ y.T >= 0.98
    codes, factor, small, scales = ed.coded(np.vstack([x, y]))
    hope = ed.hopeful(codes[:400], factor[:400], small[400:], scales[400:])
    assert near.sum() > 100 and not (near & ~hope).any() and hope.sum() < near.size / 4
    bits, tables = ed.plan(4096 * 4096)
    assert bits == 12 and (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6
    assert ed.plan(16 * 4096) == (0, 1) == ed.plan(0) and ed.plan(16 * 4096 + 1)[0] == 5


def test_estimates_have_no_bias():
    rng = np.random.default_rng(6)
    a, b = ed.units(rng.standard_normal((2, 64)))
    b = ed.units((a + 0.3 * b)[None])[0]
    got = []
    for _ in range(400):  # turning both vectors alike is turning the rotation
        q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        codes, factor, small, scales = ed.coded(np.array([a @ q, b @ q]))
        got.append(float(ed.vertices(codes[:1], 64)[0] @ (small[1] * scales[1, 0]) / factor[0]))
    assert abs(np.mean(got) - a @ b) < 4 * np.std(got) / 20
