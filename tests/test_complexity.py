"""Measures of windows against plain loops."""

import datetime as dt
import math
import tracemalloc

import numpy as np
import pytest

from panelweave.operators import complexity as c


def plain_matches(x, m, r, strict):
    n = len(x) - m + 1
    return [[max(abs(x[i + k] - x[j + k]) for k in range(m)) < r if strict else max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r for j in range(n)] for i in range(n)]


def plain_sample(x):
    r = 0.2 * np.std(x)
    if r < 1e-12:
        return math.nan
    a, b = (sum(m[i][j] for i in range(len(m)) for j in range(i + 1, len(m))) for m in (plain_matches(x, 3, r, True), plain_matches(x, 2, r, True)))
    return -math.log(a / b) if a and b else math.nan


def plain_approximate(x):
    r = 0.2 * np.std(x)
    if r < 1e-12:
        return math.nan
    phi = [np.mean([math.log(sum(row) / len(m)) for row in m]) for m in (plain_matches(x, 2, r, False), plain_matches(x, 3, r, False))]
    return abs(phi[0] - phi[1])


def plain_phrases(x):
    seen, word, n = set(), "", 0
    for v in x:
        word += "1" if v > 0 else "0"
        if word not in seen:
            seen.add(word)
            n, word = n + 1, ""
    return (n + bool(word)) / (len(x) / math.log2(len(x)))


def plain_permutations(x):
    kinds = {}
    for k in range(len(x) - 2):
        t = tuple(sorted(range(3), key=lambda j: (x[k + j], j)))
        kinds[t] = kinds.get(t, 0) + 1
    p = np.array(list(kinds.values())) / (len(x) - 2)
    return -(p * np.log2(p)).sum() / math.log2(6)


def plain_hurst(x):
    u, v = [], []
    for n in range(2, len(x) + 1):
        part = np.array(x[:n])
        s, walk = part.std(), np.cumsum(part - part.mean())
        if s > 1e-7 * max(map(abs, x)) and np.ptp(walk) > 0:
            u.append(math.log(n))
            v.append(math.log(np.ptp(walk) / s))
    return float(np.clip(np.polyfit(u, v, 1)[0], 0, 1)) if len(u) >= 5 else math.nan


PLAIN = [(c.sample_entropy, plain_sample), (c.approximate_entropy, plain_approximate), (c.phrase_complexity, plain_phrases), (c.permutation_entropy, plain_permutations), (c.hurst, plain_hurst)]


def series(n=160):
    rng = np.random.default_rng(3)
    return {"noise": rng.normal(size=n), "ties": rng.integers(-1, 2, n).astype(float), "flat": np.full(n, 0.1), "step": np.repeat([0.0, 1.0], n // 2), "wave": np.sin(np.arange(n) / 3), "walk": rng.normal(size=n).cumsum(), "up": np.arange(float(n)), "one": np.append(np.zeros(n - 1), 5.0)}


@pytest.mark.parametrize("fast, plain", PLAIN, ids=lambda f: f.__name__)
@pytest.mark.parametrize("window", [20, 63])
def test_measure(fast, plain, window):
    for name, x in series().items():
        frames = np.array([x[k : k + window] for k in range(0, len(x) - window, 7)])
        for got, frame in zip(fast(frames), frames):
            want = plain(frame)
            assert (math.isnan(got) and math.isnan(want)) or abs(got - want) < 1e-7, (name, got, want)


def test_windows_leave_out_the_row(spark, monkeypatch):
    """Many keys over small batches; the value of the row itself and later ones change nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        day = dt.date(2024, 1, 1)
        rows = [(k, day + dt.timedelta(t), float(v)) for k, x in series(70).items() for t, v in enumerate(x)] + [(None, day, 1.0)]
        measures = [("a", "x", 20, c.phrase_complexity), ("b", "x", 25, c.sample_entropy)]
        df = spark.createDataFrame(rows, "k string, date date, x double").repartition(5)
        got = {(r["k"], r["date"]): (r["a"], r["b"]) for r in c.windows(df, "k", ["date"], measures).collect()}
        assert len(got) == len(rows)
        for k, x in series(70).items():
            for t in range(70):
                a, b = got[k, day + dt.timedelta(t)]
                assert (a is None) == (t < 20) and (a is None or abs(a - plain_phrases(x[t - 20 : t])) < 1e-12)
                want = plain_sample(x[t - 25 : t]) if t >= 25 else math.nan
                assert (b is None and math.isnan(want)) or abs(b - want) < 1e-9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("fast, plain", PLAIN[:2], ids=lambda f: f.__name__)
def test_entropy_holds_no_pairs(fast, plain):
    """Words of more than one length, gaps and infinite values; memory grows with the values, not with their pairs."""
    rng = np.random.default_rng(5)
    for window in (63, 64, 65, 126, 130):
        frames = np.array([rng.integers(0, 9, window) * 0.1, rng.normal(size=window).cumsum(), np.full(window, np.nan), np.append(np.inf, np.zeros(window - 1))])
        got = fast(frames)
        assert np.isnan(got[2:]).all() and all(abs(g - plain(x)) < 1e-9 for g, x in zip(got, frames[:2]))
    frames = rng.normal(size=(100, 126))
    tracemalloc.start()
    fast(frames)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3e6  # the pairs of one window after the other would be 100 * 126 * 126 flags, and as many differences
