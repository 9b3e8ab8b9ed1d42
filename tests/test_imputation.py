"""Imputation against plain versions of each method, and planted values against the column mean."""

import math

import numpy as np
import pytest

from panelweave.operators import imputation as m

NAMES = ["a", "b", "c", "d"]


def planted(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(n, 4))
    x = x * [1.0, 20.0, 300.0, 4.0] + [5.0, 0.0, -100.0, 1.0]
    return x, rng.random((n, 4)) < [0.2, 0.3, 0.2, 0.0]


def rows_of(spark, x, hole, extra=""):
    rows = [(k % 7, k, "kept", *[None if h else float(v) for v, h in zip(a, b)]) for k, (a, b) in enumerate(zip(x, hole))]
    return spark.createDataFrame(rows, "entity_id int, t int, _feature_0 string, a double, b double, c double, d double").repartition(5)


def read(out, names, n):
    got = {r["t"]: r for r in out.collect()}
    assert len(got) == n
    return np.array([[np.nan if got[t][f"{v}_estimated"] is None else got[t][f"{v}_estimated"] for v in names] for t in range(n)]), got


def better(made, x, hole, by=0.1):
    for j in range(3):
        mean = x[~hole[:, j], j].mean()
        assert np.mean((made[hole[:, j], j] - x[hole[:, j], j]) ** 2) < by * np.mean((mean - x[hole[:, j], j]) ** 2)


def plain_chained(x, hole, rounds):
    seen = np.where(hole, np.nan, x)
    mean, spread = np.nanmean(seen, 0), np.nanstd(seen, 0, ddof=1)
    y = np.where(hole, 0, (x - mean) / spread)
    for _ in range(rounds):
        start, weights = y.copy(), []
        for j in range(3):
            keep = ~hole[:, j]
            d = np.column_stack((np.ones(keep.sum()), np.delete(start[keep], j, 1)))
            weights.append(np.linalg.solve(d.T @ d + np.diag([0, 1, 1, 1]) * m.RIDGE * keep.sum(), d.T @ start[keep, j]))
        for j in range(3):
            at = hole[:, j]
            y[at, j] = np.column_stack((np.ones(at.sum()), np.delete(y[at], j, 1))) @ weights[j]
    return y * spread + mean


def test_chained(spark):
    x, hole = planted()
    made, got = read(m.chained(rows_of(spark, x, hole), NAMES[:3], ["d"], "entity_id", "t", rounds=4, tolerance=0), NAMES[:3], len(x))
    assert np.array_equal(np.isnan(made), ~hole[:, :3])
    assert np.allclose(made[hole[:, :3]], plain_chained(x, hole, 4)[:, :3][hole[:, :3]], rtol=1e-8)
    better(made, x, hole)
    for t, r in got.items():  # what was observed stays, other columns too
        assert r["_feature_0"] == "kept" and all(r[v] is None if h else r[v] == float(w) for v, w, h in zip(NAMES, x[t], hole[t]))
    share = 1 - hole[:, 0].mean()
    assert {round(r["a_confidence"], 9) for r in got.values() if r["a_confidence"]} == {round(min(0.85, 0.4 + 0.5 * share), 9)}


def plain_completion(x, hole, rounds=3000):
    """Singular values shrunk again and again."""
    seen = np.where(hole, np.nan, x)
    mean, spread = np.nanmean(seen, 0), np.nanstd(seen, 0, ddof=1)
    z = np.where(hole, 0, (x - mean) / spread)
    shrink, y = 0.1 * np.linalg.svd(z)[1][0], z
    for _ in range(rounds):
        u, s, v = np.linalg.svd(y, full_matrices=False)
        low = u * np.maximum(s - shrink, 0) @ v
        y = np.where(hole, low, z)
    return low * spread + mean


def test_low_rank(spark):
    x, hole = planted()
    made, got = read(m.low_rank(rows_of(spark, x, hole), NAMES[:3], ["d"], "entity_id", "t", tolerance=1e-8), NAMES[:3], len(x))
    want = plain_completion(x, hole)
    assert np.array_equal(np.isnan(made), ~hole[:, :3])
    for j in range(3):
        assert np.allclose(made[hole[:, j], j], want[hole[:, j], j], atol=1e-3 * x[:, j].std())
    better(made, x, hole, 0.2)  # the penalty pulls estimates to the mean
    seen = x[~hole[:, 1], 1]
    error = np.abs(want[~hole[:, 1], 1] - seen).mean() / (seen.max() - seen.min())
    assert abs(next(r["b_confidence"] for r in got.values() if r["b_confidence"]) - max(0.1, min(0.9, 1 - 2 * error))) < 1e-3


def test_edges(spark):
    none = np.ones(4, bool)
    cases = [([], []), ([[1.0, 2, 3, 4]], [none]), ([[1.0, 2, 3, 4]] * 3, [none & False] * 3), ([[1.0, 2, 3, 4], [1.0, 2, 3, 4], [9.0, np.inf, np.nan, 4]], [[0, 1, 0, 0], [0, 1, 0, 1], [1, 0, 0, 0]])]
    for x, hole in cases:
        df = rows_of(spark, x, hole)
        for of in (m.chained, m.low_rank):
            made, _ = read(of(df, NAMES[:3], ["d"], "entity_id", "t", rounds=3), NAMES[:3], len(x))
            if len(x) == 3 and np.any(hole):
                assert abs(made[2, 0] - 1) < 1e-9 and np.isnan(made[:, 1]).all() and abs(made[2, 2] - 3) < 1e-9
            else:
                assert np.isnan(made).all()
        assert all(r["a_estimated"] is None for r in m.selection_corrected(df, "a", ["b"], ["b", "c", "d"], "entity_id", "t").collect())


def test_normal():
    at = np.array([-6, -3.3, -1, -0.2, 0, 0.7, 2, 5.5])
    f, p = m.normal(at)
    assert np.allclose(p, [0.5 * math.erfc(-v / 2**0.5) for v in at], atol=1e-14)
    assert abs(m.tail(2.228, 10) - 0.05) < 1e-4 and abs(m.tail(12.706, 1) - 0.05) < 1e-4 and abs(m.tail(-1.96, 1e6) - 0.05) < 1e-4


def plain_correction(y, seen, feature, z):
    """The two stages by Newton's method and least squares, on raw columns."""
    phi, cdf = (lambda e: np.exp(-e * e / 2) / (2 * np.pi) ** 0.5), np.vectorize(lambda e: 0.5 * math.erfc(-e / 2**0.5))
    d, w = np.column_stack((np.ones(len(z)), z)), np.zeros(z.shape[1] + 1)
    for _ in range(40):
        e = d @ w
        g = np.where(seen, phi(e) / cdf(e), -phi(e) / (1 - cdf(e)))
        w = w + np.linalg.solve((d * (g * (g + e))[:, None]).T @ d, d.T @ g)
    e = np.clip(d @ w, -m.PROBABILITY_BOUND, m.PROBABILITY_BOUND)
    x = np.column_stack((np.ones(len(y)), feature, phi(e) / cdf(e)))
    b, *_ = np.linalg.lstsq(x[seen], y[seen], rcond=None)
    left = ((y[seen] - x[seen] @ b) ** 2).sum()
    r2 = 1 - left / ((y[seen] - y[seen].mean()) ** 2).sum()
    t = b[-1] / (np.linalg.inv(x[seen].T @ x[seen])[-1, -1] * left / (seen.sum() - 3)) ** 0.5
    right = np.mean((cdf(d @ w) > 0.5) == seen)
    return x @ b, min(0.8, 0.3 + 0.2 * right + 0.2 * r2 + 0.1 * (math.erfc(abs(t) / 2**0.5) < 0.1))


@pytest.mark.parametrize("strength", [0.0, 2.0])
def test_selection(spark, strength):
    rng = np.random.default_rng(5)
    n = 600
    feature, z, u = rng.normal(size=n), rng.normal(size=(n, 3)) * [1, 50, 0.1], rng.normal(size=n)
    y = 10 + 3 * feature + strength * u + 0.3 * rng.normal(size=n)
    seen = 0.4 + z @ [1, 0.01, 3] + u > 0
    rows = [(0, k, float(y[k]) if seen[k] else None, float(feature[k]), *map(float, z[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "entity_id int, t int, y double, f double, z1 double, z2 double, z3 double").repartition(4)
    got = {r["t"]: r for r in m.selection_corrected(df, "y", ["f"], ["z1", "z2", "z3"], "entity_id", "t").collect()}
    want, confidence = plain_correction(y, seen, feature, z)
    for k in range(n):
        r = got[k]
        if seen[k]:
            assert r["y"] == float(y[k]) and r["y_estimated"] is None and r["y_confidence"] is None
        else:
            assert abs(r["y_estimated"] - want[k]) < 1e-6 and abs(r["y_confidence"] - confidence) < 1e-9
    out = {r["t"]: r["y_estimated"] for r in m.selection_corrected(df, "y", ["f"], ["z1", "z2", "z3"], "entity_id", "t", as_missing=True).collect()}
    made, true = np.array([out[k] for k in np.flatnonzero(~seen)]), y[~seen]
    assert np.mean((made - true) ** 2) < 0.5 * np.mean((y[seen].mean() - true) ** 2)


def test_selection_columns(spark):
    df = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, 2.0), (1, 3, 4.0, None), (2, 1, None, 1.0)], "e int, t int, v double, s double")
    out, names = m.selection_columns(df, "v", ["s", "v"], ["v", "s"], "e", "t")
    assert names == ["_size_0", "_rate", "_full", "_trend"]
    assert [tuple(r[n] for n in names) for r in out.orderBy("e", "t").collect()] == [(None, None, 0.0, 0.0), (2.0, 1.0, 1.0, 1 / 3), (2.0, 0.5, 0.0, 2 / 3), (1.0, None, 1.0, 0.0)]
