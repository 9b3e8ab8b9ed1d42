"""Mixtures against a plain EM; breaks against plain means."""

import datetime as dt

import numpy as np

from panelweave.operators import mixtures


def plain_em(x, k, rounds, tolerance=1e-6):
    m, v = x.mean(), x.var()
    w, mean, var = np.full(k, 1 / k), m + np.sqrt(v) * np.linspace(-1, 1, k), np.full(k, v)
    last = -np.inf
    for _ in range(rounds):
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = logs.max(1, keepdims=True)
        raw = np.exp(logs - top)
        now = (top[:, 0] + np.log(raw.sum(1))).mean()
        share = raw / raw.sum(1, keepdims=True)
        n = share.sum(0)
        new = (share * x[:, None]).sum(0) / n
        w, var, mean = n / len(x), np.maximum((share * (x[:, None] - new) ** 2).sum(0) / n, 1e-6 * v), new
        if now - last <= tolerance:
            break
        last = now
    order = np.argsort(mean)
    return w[order], mean[order], var[order]


def rows_of():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(-3, 0.5, 300), rng.normal(0, 0.3, 500), rng.normal(2, 0.4, 200)))
    rng.shuffle(x)
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(t), float(v)) for t, v in enumerate(x)]
    rows += [("few", day + dt.timedelta(t), float(t)) for t in range(10)] + [("flat", day + dt.timedelta(t), 1.0) for t in range(80)]
    rows += [(None, day + dt.timedelta(t), float(v)) for t, v in enumerate(rng.normal(size=100))] + [("a", day + dt.timedelta(5000), None)]
    return rows


def test_mixture(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "entity_id string, date date, ret double")
    got = {r["entity_id"]: r for r in mixtures.mixture(df, "entity_id", "ret", rounds=25).collect()}
    assert set(got) == {"a", None}
    r = got["a"]
    assert np.allclose(r["mean"], [-3, 0, 2], atol=0.12) and np.allclose(r["weight"], [0.3, 0.5, 0.2], atol=0.02)
    x = np.array([v for k, _, v in rows if k == "a" and v is not None])
    for name, want in zip(("weight", "mean", "variance"), plain_em(x, 3, r["rounds"], -np.inf)):
        assert np.allclose(r[name], want, rtol=1e-8)
    assert mixtures.mixture(df.limit(0), "entity_id", "ret", rounds=2).collect() == []


def test_keys_of_any_size_end_together(spark):
    """Groups, rounds of aggregations, and both in one frame: the same fits after the same number of rounds."""
    df = spark.createDataFrame(rows_of(), "entity_id string, date date, ret double")
    for rounds in (1, 3, 30):
        found = [sorted(mixtures.mixture(df, "entity_id", "ret", rounds=rounds, tolerance=0.005, most=most).collect(), key=repr) for most in (10**6, 500, 1)]
        for got in found[1:]:
            assert [(r["entity_id"], r["n"], r["rounds"]) for r in got] == [(r["entity_id"], r["n"], r["rounds"]) for r in found[0]] and len(got) == 2
            for r, want in zip(got, found[0]):
                assert np.allclose([*r["weight"], *r["mean"], *r["variance"], r["likelihood"]], [*want["weight"], *want["mean"], *want["variance"], want["likelihood"]], rtol=1e-9)
        assert rounds < 30 or found[0][0]["rounds"] < 30


def test_small_keys_take_no_job_a_round(spark):
    df = spark.createDataFrame(rows_of(), "entity_id string, date date, ret double")
    spark.sparkContext.setJobGroup("mixture", "")
    mixtures.mixture(df, "entity_id", "ret", rounds=40, tolerance=-1.0).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixture")) < 30  # two a round before


def test_regimes(spark):
    rows = rows_of()
    found = mixtures.regimes(spark.createDataFrame(rows, "entity_id string, date date, ret double"), "entity_id", "ret", rounds=25).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["entity_id"] in ("few", "flat") or r["ret"] is None:
            assert r["regime"] is None
        else:
            assert abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 and r["confidence"] == max(r["p0"], r["p1"], r["p2"])
        if r["entity_id"] == "a" and r["ret"] is not None and abs(r["ret"]) > 1.5:
            assert r["regime"] == (0 if r["ret"] < 0 else 2)


def test_breaks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, 100), rng.normal(4, 1, 60)))
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(t), float(v)) for t, v in enumerate(x)], "entity_id string, date date, ret double")
    score = [r["break_score"] for r in mixtures.breaks(df, "ret").orderBy("date").collect()]
    assert all(s is None for s in score[:41]) and max(score[41:95]) < 3 < max(score[100:125])
    for t in (41, 80, 120):
        a, b = x[t - 20 : t + 1], x[t - 41 : t - 20]
        assert abs(score[t] - abs(a.mean() - b.mean()) / np.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 21)) < 1e-9
