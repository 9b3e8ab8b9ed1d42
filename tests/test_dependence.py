"""Tau against the plain pair count, breaks against all partitions."""

import itertools

import numpy as np

from panelweave.operators import dependence as d


def plain_tau(x, y):
    s = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i)]
    c, w = sum(a * b > 0 for a, b in s), sum(a * b < 0 for a, b in s)
    below = sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s)
    return c, w, (c - w) / below**0.5 if below else None


def cases():
    rng = np.random.default_rng(1)
    x = rng.normal(size=150)
    yield "noise", x, rng.normal(size=150)
    yield "near", x, x + rng.normal(size=150) * 0.3
    yield "ties", rng.integers(0, 6, 150).astype(float), rng.integers(0, 4, 150).astype(float)
    yield "hot", np.where(rng.random(150) < 0.5, 0.0, x), np.where(rng.random(150) < 0.4, 1.0, rng.normal(size=150))
    yield "flat", np.zeros(20), np.arange(20.0)
    yield "back", np.arange(60.0), -np.arange(60.0)
    yield None, np.array([1.0, 2.0]), np.array([5.0, 6.0])
    yield "one", np.array([1.0]), np.array([1.0])


def test_kendall(spark):
    rows = [(k, float(a), float(b)) for k, x, y in cases() for a, b in zip(x, y)] + [("noise", None, 1.0), ("noise", 1.0, None)]
    got = {r["k"]: r for r in d.kendall(spark.createDataFrame(rows, "k string, x double, y double").repartition(5), "k", "x", "y", blocks=8, block_rows=9).collect()}
    for k, x, y in cases():
        c, w, tau = plain_tau(x, y)
        assert (got[k]["n"], got[k]["concordant"], got[k]["discordant"]) == (len(x), c, w), k
        assert (tau is None and got[k]["tau"] is None) or abs(got[k]["tau"] - tau) < 1e-12
    assert d.kendall(spark.createDataFrame([], "k string, x double, y double"), "k", "x", "y").collect() == []


def test_kendall_cuts_only_large_keys(spark, monkeypatch):
    """Counted as a whole, by ranges, and both in one frame: the same; ranges are made for keys of more rows than a block alone."""
    ranged, seen = d._ranged, []
    monkeypatch.setattr(d, "_ranged", lambda rows, *given: seen.append({r["k"] for r in rows.select("k").distinct().collect()}) or ranged(rows, *given))
    rows = [(k, float(a), float(b)) for k, x, y in cases() for a, b in zip(x, y)] + [("nan", float("nan"), 1.0), ("nan", float("nan"), 2.0), ("nan", 1.0, float("nan")), ("nan", 1.0, 0.0), ("nan", -0.0, 5.0), ("nan", 0.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = [sorted(map(repr, d.kendall(df, "k", "x", "y", blocks=8, block_rows=size).collect())) for size in (1, 100, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 9
    assert seen == [{k for k, *_ in cases()} - {"one"} | {"nan"}, {"noise", "near", "ties", "hot"}]


def test_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 100):
        for values in (3, 1000):
            y = rng.integers(0, values, n)
            assert d.inversions(y) == sum(y[i] > y[j] for j in range(n) for i in range(j))


def spread(groups):
    return sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups)


def test_natural_breaks(spark):
    rng = np.random.default_rng(3)
    data = {"a": np.round(rng.normal(size=14), 2), "b": np.repeat([1.0, 2.0, 9.0, 10.0, 30.0], [5, 1, 3, 3, 2]), "few": np.arange(5.0), "same": np.zeros(40), None: 1e6 + np.arange(12.0) ** 2}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("a", None)]
    got = {r["k"]: r["breaks"] for r in d.natural_breaks(spark.createDataFrame(rows, "k string, x double"), "k", "x", classes=3).collect()}
    assert set(got) == {"a", "b", None}
    for k, found in got.items():
        v = np.unique(data[k])
        cost = lambda cuts: spread([data[k][(data[k] > lo) & (data[k] <= hi)] for lo, hi in zip([-np.inf, *cuts], [*cuts, np.inf])])  # noqa: B023, E731
        best = min(cost(c) for c in itertools.combinations(v[:-1], 2))
        assert abs(cost(found) - best) <= 1e-9 * max(best, 1)


def test_breaks_in_bins(spark):
    """More values than bins: within a bin of the planted gaps."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(lo, lo + 1, 300) for lo in (0, 5, 9)])
    r = d.natural_breaks(spark.createDataFrame([("a", float(v)) for v in x], "k string, x double"), "k", "x", classes=3, bins=50).first()
    assert r["bins"] <= 50 and 0.8 < r["breaks"][0] <= 1 and 5.8 < r["breaks"][1] <= 6
