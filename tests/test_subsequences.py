"""Motifs, discords and analogs against all pairs, one at a time."""

import numpy as np

from panelweave.operators import subsequences as s

M = 8


def series(n, seed):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=n)) + 50
    v[10 : 10 + M] = v[70 : 70 + M] * 3 + 2  # one shape at two places
    v[30 : 30 + M + 2] = 7.0
    return v


def plain_distance(a, b):
    if np.isnan(a).any() or np.isnan(b).any():
        return np.inf
    flat = [np.ptp(x) == 0 for x in (a, b)]
    if any(flat):
        return 0.0 if all(flat) else M**0.5
    return float(np.linalg.norm((a - a.mean()) / a.std() - (b - b.mean()) / b.std()))


def plain_profile(v):
    n, out = len(v) - M + 1, {}
    for i in range(n):
        d = [(round(plain_distance(v[i : i + M], v[j : j + M]), s.DIGITS), j) for j in range(n) if abs(i - j) > M / 4]
        best = min(d)
        if np.isfinite(best[0]):
            out[i] = best
    return out


def plain_picks(found, motif, top):
    taken, out = [], []
    for d, i in sorted(((d if motif else -d), i) for i, (d, _) in found.items()):
        near = found[i][1]
        inside = any(a <= x < a + M for a in taken for x in ((i, near) if motif else (i,)))
        if len(out) < top and not inside and not (motif and abs(i - near) < M):
            out.append((i, near))
            taken += [i, near] if motif else [i]
    return out


def test_motifs(spark):
    data = {"one": series(120, 1), "gap": series(101, 2), "short": series(120, 3)[: 3 * M - 1], None: series(90, 4)}
    data["gap"][55] = np.nan
    rows = [(k, t, None if k == "gap" and np.isnan(x) else float(x)) for k, v in data.items() for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "key string, day int, value double").repartition(6)
    found = s.profile(df, "key", "day", "value", window=M, block=32)
    got, picks = found.collect(), s.motifs(found, 3, M).collect()
    for k, v in data.items():
        mine = {r["t"]: r for r in got if r["k"] == k}
        if k == "short":
            assert not mine
            continue
        want = plain_profile(v)
        assert set(mine) == set(want)
        for t, (d, near) in want.items():
            assert abs(mine[t]["distance"] - d) < 3e-5
            assert mine[t]["near"] == near or abs(plain_distance(v[t : t + M], v[mine[t]["near"] : mine[t]["near"] + M]) - d) < 3e-5
        as_found = {t: (r["distance"], r["near"]) for t, r in mine.items()}
        for kind in ("motif", "discord"):
            chosen = sorted((r["place"], r["t"], r["near"]) for r in picks if r["k"] == k and r["kind"] == kind)
            assert [c[1:] for c in chosen] == plain_picks(as_found, kind == "motif", 3)
    assert s.motifs(s.profile(df.where("false"), "key", "day", "value", window=M)).collect() == []


def plain_warp(x, y, band):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            if abs(i - j) <= band:
                d[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1] ** 0.5


def test_bound():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 9)), rng.normal(size=9)
    for band in (0, 2, 9):
        d = s.warped(x, y, band)
        assert np.allclose(d, [plain_warp(a, y, band) for a in x])
        assert (s.bounded(x, y, band) <= d + 1e-12).all()


def test_dimensions_are_warped_together():
    """Each as alone, in a step a diagonal for all of them."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(30, 7, 3)), rng.normal(size=(7, 3))
    for band in (0, 1, 4, 7):
        d = s.warped(x, y, band)
        assert d.shape == (30, 3)
        assert np.allclose(d, [[plain_warp(a[:, f], y[:, f], band) for f in range(3)] for a in x])
    assert s.warped(x[:0], y, 7).shape == (0, 3)


def test_analogs(spark):
    rng = np.random.default_rng(6)
    sizes, data = {1: 210, 2: 100, 3: 99, 4: 140}, {}
    for k, n in sizes.items():
        data[k] = np.column_stack((np.exp(np.cumsum(0.02 * rng.normal(size=n))) * 10, rng.normal(size=n), np.full(n, 3.0)))
    data[4][5, 1] = np.nan
    data[4][60:] = data[4][20:100]  # copies give ties
    rows = [(k, t, *[None if np.isnan(x) else float(x) for x in r]) for k, v in data.items() for t, r in enumerate(v)]
    df = spark.createDataFrame(rows, "key int, day int, close double, other double, flat double").repartition(6)
    for band in (None, 3):
        got = s.analogs(df, "key", "day", "close", ["close", "other", "flat"], window=12, k=4, horizon=9, gap=5, band=band, block=32).collect()
        assert {r["key"] for r in got} == {1, 2, 4}
        for k in (1, 2, 4):
            v = data[k]
            z = np.nan_to_num((v - np.nanmean(v, 0)) / np.where(np.nanstd(v, 0) < 1e-8, 1, np.nanstd(v, 0)))
            n, last = len(v), z[-12:]
            d = sorted((round(sum(plain_warp(z[a : a + 12, f], last[:, f], 12 if band is None else band) for f in range(3)), s.DIGITS), a) for a in range(n - 12 - 5))
            mine, returns, falls = sorted((r for r in got if r["key"] == k), key=lambda r: r["place"]), [], []
            assert [(r["place"], r["start_at"], r["end_at"]) for r in mine] == [(p + 1, a, a + 11) for p, (_, a) in enumerate(d[:4])]
            for r, (far, a) in zip(mine, d):
                price = v[a + 12 : min(a + 21, n), 0]
                step = price / v[a + 11 : a + 11 + len(price), 0] - 1
                falls.append((price / np.maximum.accumulate(price) - 1).min())
                returns.append(price[-1] / price[0] - 1)
                assert np.allclose([r["distance"], r["outcome_return"], r["max_drawdown"], r["volatility"]], [far, returns[-1], falls[-1], step.std(ddof=1) * 252**0.5])
            told = [np.mean(returns), np.median(returns), *np.percentile(returns, [5, 95]), min(falls)]
            assert np.allclose([mine[0][c] for c in ("mean_return", "median_return", "p5_return", "p95_return", "worst_drawdown")], told)
    assert s.analogs(df.where("false"), "key", "day", "close", ["close"]).collect() == []
