"""Scans against plain loops, with keys over many tasks and a long one."""

from itertools import accumulate

import numpy as np
import pytest

from panelweave import scans
from panelweave.sources.files import scratch


def panel(n_hot=5000, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("hot", t, float(100 + v)) for t, v in enumerate(rng.normal(size=n_hot).cumsum())]
    rows += [(f"k{k}", t, float(v)) for k in range(7) for t, v in enumerate(rng.normal(size=40 + k).cumsum())]
    rows += [("one", 0, 5.0), (None, 1, 2.0), (None, 0, 1.0)]
    return rows


def loops(rows, f):
    """{(key, t): outputs} by ``f``, a function of a key's values in order."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        out |= {(key, r[1]): v for r, v in zip(own, f([r[2] for r in own]))}
    return out


def run(spark, rows, family):
    df = spark.createDataFrame(rows, "entity_id string, t long, x double").repartition(7)
    got = scans.scan(df, "entity_id", ["t"], ["x"], family, scratch(spark, "scan")).collect()
    assert len(got) == len(rows)
    return {(r["entity_id"], r["t"]): r for r in got}


@pytest.mark.parametrize("least", [4096, 200])
def test_clamped(spark, least, monkeypatch):
    monkeypatch.setattr(scans, "LEAST_ROWS", least)
    rows = [(k, t, None if t % 11 == 5 else (0.05 if int(x * 7) % 3 else -0.04)) for k, t, x in panel()]

    def plain(values):
        a = 0.1
        for v in values:
            a = a if v is None else max(0.01, min(0.5, a + v))
            yield a

    got, want = run(spark, rows, scans.Clamped(0.1, 0.01, 0.5)), loops(rows, plain)
    assert all(abs(got[k]["state"] - v) < 1e-9 for k, v in want.items())
    assert {v for v in want.values()} & {0.5} and {v for v in want.values()} & {0.01}


@pytest.mark.parametrize("least", [4096, 300])
def test_smoothed(spark, least, monkeypatch):
    monkeypatch.setattr(scans, "LEAST_ROWS", least)
    rows = panel()
    family = scans.Smoothed([0.1, 0.5, 1.0], [0.0, 0.2])

    def plain(values):
        level, trend = [values[0]] * 6, [0.0] * 6
        for n, v in enumerate(values):
            before = [None if not n else a + b for a, b in zip(level, trend)]
            for g, (a, b) in enumerate(family.grid):
                new = a * v + (1 - a) * (level[g] + trend[g])
                level[g], trend[g] = new, b * (new - level[g]) + (1 - b) * trend[g]
            yield before + [a + b for a, b in zip(level, trend)]

    got, want = run(spark, rows, family), loops(rows, plain)
    for k, v in want.items():
        for name, x in zip(family.outputs, v):
            assert (got[k][name] is None) == (x is None)
            assert x is None or abs(got[k][name] - x) < 1e-9 * max(1, abs(x))


@pytest.mark.parametrize("least", [4096, 300])
def test_local_level(spark, least, monkeypatch):
    monkeypatch.setattr(scans, "LEAST_ROWS", least)
    rows = [(k, t, None if t and t % 13 == 4 else x) for k, t, x in panel()]

    def plain(values):
        level, p, q, r = values[0], 0.3, 0.2, 0.3
        for n, v in enumerate(values):
            predicted, p = level if n else None, p + q
            if v is not None:
                gain = p / (p + r)
                level, p = level + gain * (v - level), (1 - gain) * p
            yield predicted, level, p

    rows = [(k, t, x) for k, t, x in rows if x is not None or t]
    df = spark.createDataFrame(rows, "entity_id string, t long, x double").repartition(7).selectExpr("*", "0.2D AS q", "0.3D AS r")
    got = {(r["entity_id"], r["t"]): r for r in scans.scan(df, "entity_id", ["t"], ["x", "q", "r"], scans.LocalLevel(), scratch(spark, "scan")).collect()}
    for k, (predicted, level, p) in loops(rows, plain).items():
        r = got[k]
        assert (r["predicted"] is None) == (predicted is None) and (predicted is None or abs(r["predicted"] - predicted) < 1e-9 * max(1, abs(predicted)))
        assert abs(r["level"] - level) < 1e-9 * max(1, abs(level)) and abs(r["variance"] - p) < 1e-9


def test_long_key_and_empty(spark):
    """100,000 rows of one key."""
    n = 100_000
    x = np.where(np.random.default_rng(5).random(n) < 0.12, 0.05 * (0.1 - 1), 0.05 * 0.1)
    rows = [("a", t, float(v)) for t, v in enumerate(x)]
    got = run(spark, rows, scans.Clamped(0.1, 0.01, 0.5))
    a = 0.1
    for t, v in enumerate(x):
        a = max(0.01, min(0.5, a + v))
        assert abs(got["a", t]["state"] - a) < 1e-9 and got["a", t]["place"] == t + 1
    assert run(spark, [], scans.Clamped(0.1, 0.01, 0.5)) == {}


def test_smoothed_where_a_batch_lacks_the_carried_key(spark, monkeypatch):
    """Small batches: later ones of a task hold other keys than the one that began in the task before."""
    monkeypatch.setattr(scans, "LEAST_ROWS", 300)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rows = panel(900)
        got = run(spark, rows, scans.Smoothed([0.5, 0.9], [0.0, 0.2]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert all(abs(got[k]["after_0"] - v) < 1e-9 * max(1, abs(v)) for k, v in loops(rows, lambda values: accumulate(values, lambda a, v: (a + v) / 2)).items())
