"""Stacking, residual adjustment and feature choice against plain solves."""

import datetime as dt
import math

import numpy as np

from panelweave.operators import selection as s

DAY = dt.date(2020, 1, 1)


def plain_ridge(x, y):
    x = np.asarray(x, float)
    d, e = x - x.mean(0), y - np.mean(y)
    w = np.linalg.solve(d.T @ d + np.eye(x.shape[1]), d.T @ e)
    return w, np.mean(y) - w @ x.mean(0)


def test_stack(spark):
    rng = np.random.default_rng(2)
    rows, data = [], {}
    for key, n in (("a", 200), ("b", 60), ("few", 25), (None, 120)):
        y = 1000 + np.cumsum(rng.normal(size=n))
        x = np.column_stack((y + rng.normal(size=n), y + 5 * rng.normal(size=n), -y))
        days = np.sort(rng.choice(3 * n, n, replace=False))
        x[3, 1] = np.nan
        data[key] = days, x, y
        rows += [(key, DAY + dt.timedelta(int(d)), *[None if np.isnan(v) else float(v) for v in a], float(b), -1) for d, a, b in zip(days, x, y)]
    df = spark.createDataFrame(rows, "key string, date date, m0 double, m1 double, m2 double, actual double, fold int").repartition(5)
    weights, made = s.stack(df, "key", "date", ["m0", "m1", "m2"], "actual", folds=4)
    got = {(r["key"], r["fold"]): r for r in weights.collect()}
    stacked = {(r["key"], (r["date"] - DAY).days): r for r in made.collect()}
    assert len(stacked) == len(rows) and all(r["fold"] == -1 for r in stacked.values())
    for key, (days, x, y) in data.items():
        fold = np.minimum(3, (days - days.min()) * 4 // (days.max() - days.min() + 1))
        whole = ~np.isnan(x).any(1)
        for until in range(5):
            use = whole & (fold < until)
            if use.sum() < 30 or until == 4 and len(y) < 50:
                assert (key, until) not in got
                w = None
            else:
                w, start = plain_ridge(x[use], y[use])
                r, share = got[key, until], np.maximum(w, 0)
                assert r["n"] == use.sum() and np.allclose(r["coefficients"], w, atol=1e-8) and abs(r["intercept"] - start) < 1e-5
                assert np.allclose(r["weights"], share / share.sum())
            for i in np.flatnonzero(fold == until):
                value = stacked[key, days[i]]["stacked"]
                assert value is None if w is None or not whole[i] else abs(value - (start + x[i] @ w)) < 1e-5
    assert s.stack(df.where("false"), "key", "date", ["m0"], "actual")[0].collect() == []


def test_adjusted(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key, n, forecast in (("a", 80, 400.0), ("b", 29, 10.0), ("zero", 60, 0.0), ("last", 50, 8.0)):
        x = rng.normal(size=(n, 3)) * [1, 4, 1]
        y = 0.8 * x[:, 0] - 0.2 * x[:, 1] + 0.1 * rng.normal(size=n)
        x[:-15, 2] = np.nan  # too few values: not used
        x[5, 0] = np.nan
        if key == "last":
            x[-1, 1] = np.nan
        rows += [(key, t, float(y[t] + 3), 3.0, forecast if t == n - 1 else -1.0, *[None if np.isnan(v) else float(v) for v in x[t]]) for t in range(n)]
        use, move = ~np.isnan(x[:, :2]).any(1), 0.0
        if use.sum() >= 30:
            w, start = plain_ridge(x[use, :2], y[use])
            bound = 0.05 * forecast if forecast else 1.0
            move = max(-bound, min(bound, start + np.nan_to_num(x[-1, :2]) @ w))
        want[key] = forecast + move
    df = spark.createDataFrame(rows, "key string, t int, v double, fit double, fc double, x0 double, x1 double, x2 double").repartition(4)
    got = {r["key"]: r["adjusted"] for r in s.adjusted(df, "key", "t", "v", "fit", "fc", ["x0", "x1", "x2"]).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r["key"]: r["adjusted"] for r in s.adjusted(df, "key", "t", "v", "fit", "fc", ["x2"]).collect()}["a"] == 400.0


def test_choice(spark):
    rng = np.random.default_rng(7)
    n = 900
    a, b, noise = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = a + 0.6 * b + 0.2 * rng.normal(size=n)
    x = np.column_stack((noise, a + 0.05 * rng.normal(size=n), a, b, np.full(n, 2.0)))
    rows = [(*map(float, r), None, float(v)) for r, v in zip(x, y)] + [(1.0, None, 1.0, 1.0, 2.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "noise double, near double, a double, b double, flat double, rare double, y double").repartition(5)
    got = s.choose_features(df, "y", ["noise", "near", "a", "b", "flat", "rare"], most=4).collect()
    edge = [np.sort(c)[[math.ceil(n * k / 10) - 1 for k in range(1, 10)]] for c in (*x.T, y)]
    place = [np.searchsorted(e, c, "left") for e, c in zip(edge, (*x.T, y))]
    relevance = []
    for p in place[:-1]:
        joint = np.histogram2d(p, place[-1], bins=[range(11), range(11)])[0] / n
        relevance.append(sum(joint[i, j] * math.log(joint[i, j] / joint[i].sum() / joint[:, j].sum()) for i in range(10) for j in range(10) if joint[i, j]))
    with np.errstate(all="ignore"):
        alike = np.nan_to_num(np.abs(np.corrcoef(x.T)))
    left, chosen = [0, 1, 2, 3, 4], []
    while len(chosen) < 4:
        score = {i: relevance[i] - (np.mean([alike[i, j] for j, _ in chosen]) if chosen else 0) for i in left}
        best = max(left, key=score.get)
        chosen.append((best, score[best]))
        left.remove(best)
    names = ["noise", "near", "a", "b", "flat"]
    assert [r["feature"] for r in got] == [names[i] for i, _ in chosen] and got[1]["feature"] == "b"
    assert np.allclose([r["score"] for r in got], [v for _, v in chosen]) and np.allclose([r["relevance"] for r in got], [relevance[i] for i, _ in chosen])
    few = s.choose_features(df.limit(20), "y", ["a", "b"]).collect()
    assert [(r["feature"], r["score"]) for r in few] == [("a", None), ("b", None)]
