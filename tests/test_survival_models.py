"""Fitted survival models and bootstraps against plain versions."""

import datetime as dt
import math
import tracemalloc

import numpy as np
import pyarrow as pa

from panelweave import registry
from panelweave.operators import survival_models as sm

SF = "/root/testdata/sf0.001"
SCHEMA = "entity_id long, date date, cr double, de double, fy double, drawdown double, flag int"


def panel(seed=1, entities=20, days=120):
    """Events come sooner with a low current ratio and a deep drawdown."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        for t in range(days):
            x = rng.normal(size=4)
            flag = int(rng.random() < 0.08 * math.exp(-0.8 * x[0] - 0.5 * x[3]))
            rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(t), *map(float, x), flag))
    return rows


def test_survival_regression(spark):
    rows = panel()
    score, fit = sm.survival_regression(spark.createDataFrame(rows + [(99, dt.date(2024, 1, 1), None, 1.0, 1.0, 1.0, None)], SCHEMA))
    # the same durations, and the slope of the Weibull log likelihood at the solution
    made, run = [], {}
    for r in sorted(rows):
        run[r[0]] = run.get(r[0], 0) + 1
        made.append((run[r[0]], r[6], r[2:6]))
        if r[6]:
            run[r[0]] = 0
    t, d, x = np.array([m[0] for m in made], float), np.array([m[1] for m in made]), np.array([m[2] for m in made])
    z = (x - x.mean(0)) / x.std(0)

    def loss(p):
        e = (np.log(t) - p[0] - z @ p[1:5]) / p[5]
        return -(d * (e - np.log(p[5])) - np.exp(e)).mean()

    at = np.array([fit["intercept"], *fit["coefficients"], fit["scale"]])
    slopes = [(loss(at + h) - loss(at - h)) / 2e-5 for h in 1e-5 * np.eye(6)]
    assert np.abs(slopes).max() < 1e-4
    assert fit["log_hazard_ratios"]["cr"] < -0.4 and fit["log_hazard_ratios"]["drawdown"] < -0.2 and abs(fit["log_hazard_ratios"]["de"]) < 0.2
    got = {(r["entity_id"], r["date"]): r["hazard"] for r in score.collect()}
    for r in rows[:50]:
        h = sum(b * (v - m) / s for b, v, (m, s) in zip(fit["log_hazard_ratios"].values(), r[2:6], fit["moments"]))
        assert abs(got[r[0], r[1]] - 1 / (1 + math.exp(-h))) < 1e-9
    assert got[99, dt.date(2024, 1, 1)] is None
    none, fit = sm.survival_regression(spark.createDataFrame(rows[:40], SCHEMA))
    assert fit is None and none.where("hazard IS NOT NULL").count() == 0


def test_later_rows_do_not_change_durations(spark):
    rows = panel(2, 3, 30)
    early = [r for r in rows if r[1] < dt.date(2024, 1, 20)]
    of = lambda part: {(r["entity_id"], r["date"]): r["duration"] for r in sm.durations(spark.createDataFrame(part, SCHEMA), "flag").collect()}
    whole = of(rows)
    assert all(whole[k] == v for k, v in of(early).items())


def test_discrete_survival(spark):
    rows = panel(3)
    score, fit = sm.discrete_survival(spark.createDataFrame(rows, SCHEMA))
    x, y = np.array([r[2:5] for r in rows]), np.array([r[6] for r in rows])
    z, n = (x - x.mean(0)) / x.std(0), len(rows)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    b, a = np.zeros(3), 0.0
    for _ in range(50):  # Newton's method on the same loss
        p = 1 / (1 + np.exp(-(a + z @ b)))
        g = np.append((w * (p - y)) @ z + b, (w * (p - y)).sum())
        full = np.column_stack((z, np.ones(n)))
        hess = (full * (w * p * (1 - p))[:, None]).T @ full + np.diag([1, 1, 1, 0])
        step = np.linalg.solve(hess, g)
        b, a = b - step[:3], a - step[3]
    assert np.allclose(fit["coefficients"], b, atol=1e-4) and abs(fit["intercept"] - a) < 1e-4
    assert all(0 <= r["probability"] <= 1 for r in score.collect())


def test_probability_is_that_of_the_panel(spark):
    """Without noise the bands' formula is the one of the survival probability."""
    want = {(r["entity_id"], r["date"]): r["survival_probability"] for r in registry.queries()["anal02_survival_probability"](spark, SF).collect()}
    rows = sm.flagged(spark, SF).collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in sm.RATIOS] for r in rows])
    for r, p in zip(rows, sm.probability(x)):
        assert abs(want[r["entity_id"], r["date"]] - p) < 2e-6


def test_uncertainty(spark):
    df = spark.createDataFrame(panel(4, 3, 100), SCHEMA)
    a, b = (sorted(map(tuple, sm.uncertainty(d).collect())) for d in (df, df.repartition(9)))
    assert a == b  # the same on every run, wherever a row lies
    many = {(r["entity_id"], r["date"]): r for r in sm.uncertainty(df, 4000).collect()}
    assert all(p10 <= p90 and spread >= 0 for *_, p10, p90, spread in a)
    assert np.mean([abs(p90 - many[e, d]["p90"]) for e, d, _, p90, _ in a]) < 0.02
    assert sm.uncertainty(df.limit(0)).collect() == []


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, float(rng.random() < 0.7), float(0.5 + rng.random())) for k in ("a", "b") for t in range(400)] + [("c", 0, 1.0, 1.0), (None, 0, 0.0, 1.0), ("a", 999, None, 1.0)]
    df = spark.createDataFrame(rows, "key string, t long, flag double, weight double")
    got = {r["key"]: r for r in sm.bootstrap(df, "key", ["key", "t"], "flag", "weight").collect()}
    for k in ("a", "b"):
        f, w = np.array([r[2:] for r in rows if r[0] == k and r[2] is not None]).T
        plain = [(lambda i: (w[i] * f[i]).sum() / w[i].sum())(rng.integers(0, len(f), len(f))) for _ in range(4000)]
        assert abs(got[k]["mean"] - (w * f).sum() / w.sum()) < 0.004
        assert all(abs(got[k][n] - np.percentile(plain, p)) < 0.01 for n, p in (("p5", 5), ("p25", 25), ("median", 50), ("p75", 75), ("p95", 95)))
        assert abs(got[k]["std"] - np.std(plain)) < 0.003
    assert got["c"]["mean"] == 1.0 and got["c"]["std"] == 0.0 and got[None]["p95"] == 0.0
    again = {r["key"]: r for r in sm.bootstrap(df.repartition(7), "key", ["key", "t"], "flag", "weight").collect()}
    assert all(abs(again[k][n] - r[n]) < 1e-12 for k, r in got.items() for n in ("mean", "std", "p5", "p95"))


def test_draws():
    seed = np.arange(200_000)
    u, z, p = sm.uniform(seed, np.array(3)), sm.normal(seed, np.array(3)), sm.poisson(seed, np.array(3))
    assert abs(u.mean() - 0.5) < 3e-3 and abs(u.std() - 12**-0.5) < 3e-3
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01
    assert abs(p.mean() - 1) < 0.01 and abs(p.var() - 1) < 0.02
    assert abs(np.corrcoef(sm.uniform(seed, np.array(3)), sm.uniform(seed, np.array(4)))[0, 1]) < 0.01


def test_fits_make_their_frame_once(spark):
    """A fit passes over its rows many times; the frame before it is computed once."""
    rows = panel(3, entities=4, days=60)
    for fit in (sm.survival_regression, sm.discrete_survival):
        seen = spark.sparkContext.accumulator(0)

        def look(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        score, found = fit(spark.createDataFrame(rows, SCHEMA).mapInArrow(look, SCHEMA))
        assert found and score.count() == len(rows)
        assert seen.value == len(rows)


def test_bands_hold_few_rows_at_a_time():
    """Percentiles of all draws' probabilities, ratios missing, far below every trigger and far above; memory doesn't grow with a batch's draws."""
    rng, n = np.random.default_rng(7), 3000
    x, scale, seed = rng.normal(size=(n, 4)) * 3, np.abs(rng.normal(size=(n, 4))), rng.integers(-(2**63), 2**63 - 1, n)
    x[rng.random((n, 4)) < 0.3] = np.nan
    x[:4], x[4], scale[5] = [np.inf, -np.inf, np.inf, np.inf], np.nan, np.nan
    cols = {"entity_id": np.arange(n), "seed": seed} | {r: x[:, k] for k, r in enumerate(sm.RATIOS)} | {f"{r}_scale": scale[:, k] for k, r in enumerate(sm.RATIOS)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, from_pandas=True) for k, v in cols.items()})
    tracemalloc.start()
    out = pa.Table.from_batches(sm._bands(iter([batch]), 100, ["entity_id"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    for row in (*range(8), 77, 2999):
        drawn = x[row] + np.array([[sm.normal(seed[row : row + 1], np.array([4 * d + k]))[0] for k in range(4)] for d in range(100)]) * 0.5 * np.nan_to_num(scale[row])
        plain = []
        for r in drawn:
            far = [float(np.clip((level - v if below else v - level) / max(abs(level), 0.01), -5, 5)) for v, (level, below) in zip(r, sm.LEVELS) if v == v]
            plain.append(1 / (1 + math.exp(-max(*far, math.prod(1 + max(-0.99, f) for f in far) ** (1 / len(far)) - 1))) if far else 0.5)
        assert abs(out["p10"][row].as_py() - np.percentile(plain, 10)) < 1e-12 and abs(out["p90"][row].as_py() - np.percentile(plain, 90)) < 1e-12


def test_trailing_deviations_by_batch(spark):
    """Across small batches and many keys: the last 63 rows of the key, missing values left out, ten at least; before that the whole series'."""
    rng = np.random.default_rng(8)
    x = [np.where(rng.random((n, 4)) < 0.2, np.nan, rng.normal(size=(n, 4)).cumsum(0)) for n in (1, 9, 40, 150, 64)]
    x[3][:, 1] = 0.1
    day = dt.date(2024, 1, 1)
    names = ["entity_id", "date", *sm.RATIOS, *[f"{r}_scale" for r in sm.RATIOS]]
    cols = [(k, day + dt.timedelta(t), *map(float, r), 7.0, 7.0, 7.0, None) for k, rows in enumerate(x) for t, r in enumerate(rows)]
    table = pa.table({c: pa.array([r[k] for r in cols], from_pandas=True) for k, c in enumerate(names)})
    table = table.set_column(len(names) - 1, names[-1], pa.nulls(len(cols), pa.float64()))
    out = pa.Table.from_batches(sm._scaled(iter(table.to_batches(max_chunksize=13)))).to_pylist()
    assert len(out) == len(cols)
    for r in out:
        t = (r["date"] - day).days
        for k, c in enumerate(sm.RATIOS):
            seen = x[r["entity_id"]][max(0, t - 62) : t + 1, k]
            seen = seen[~np.isnan(seen)]
            want = seen.std(ddof=1) if len(seen) >= 10 else 7.0 if k < 3 else math.nan
            assert (math.isnan(r[f"{c}_scale"]) and math.isnan(want)) or abs(r[f"{c}_scale"] - want) < 1e-12
