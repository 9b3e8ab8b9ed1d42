"""Whitening against plain linear algebra in whole numbers and numpy."""

import numpy as np
import pytest

from panelweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, x string, part string, whitened string"


def plain(rows):
    """The contract, from ``rows`` of (vec_id, list)."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        far = [n * a - int(s) for a, s in zip(x, sums)]
        for k in range(min(4, len(e))):
            white = float(np.array(far) / n @ vectors[:, k] / np.sqrt(e[k])) if e[k] > 1e-9 * e[0] else None
            out.append((i, k + 1, n, sum(f * f for f in far), white, e[k] / e.sum()))
    return out


def compare(got, want):
    """Equal up to one sign for each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-12)
    for k in {r[1] for r in want}:
        a, b = [r[4] for r in got if r[1] == k], [r[4] for r in want if r[1] == k]
        assert [x is None for x in a] == [x is None for x in b]
        if None not in a:
            a, b = np.array(a), np.array(b)
            assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
    assert len({r[6] for r in got}) <= 1
    assert all(0 <= r[6] < 1e-9 for r in got)


def rows_of(seed, n, dims):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, dims)) * rng.uniform(0.05, 1, dims)).tolist()
    rows = list(enumerate(x))
    rows += [(1000 + k, x[0]) for k in range(n)]  # a hot vector
    odd = [None, [], [None] + x[1][1:], [float("nan")] + x[1][1:], [float("inf")] + x[1][1:], x[1][:-1], x[2]]
    return rows, [(None if k % 2 else 2000 + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize("dims", [1, 2, 6, 33])
def test_whitening(spark, dims):
    rows, odd = rows_of(dims, 90, dims)
    frame = spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows + odd], SCHEMA).repartition(11)
    compare(whitening.report(frame).collect(), plain(rows + [(i, v) for i, v in odd if v and len(v) == dims]))


def test_one_update_a_row(spark):
    """Blocks of one row, hence an update for each row, give the same transform."""
    rows, _ = rows_of(7, 60, 9)
    frame = spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], SCHEMA).repartition(5)
    a, b = whitening.fit(frame, block=1), whitening.fit(frame)
    assert np.allclose(a.values, b.values, rtol=1e-12)
    assert np.allclose(np.abs((a.components * b.components).sum(0)), 1, atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, [-0.5, 1.0])], [(1, [-0.0, 1e30]), (2, [0.5, -1e30])]])
def test_few_rows(spark, rows):
    got = whitening.report(spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], SCHEMA)).collect()
    if any(v and max(v) > 1e20 for _, v in rows):
        assert [(r["vec_id"], r["component"], r["deviation"]) for r in got] == [(1, 1, None), (1, 2, None), (2, 1, None), (2, 2, None)]
    elif len({tuple(v) for _, v in rows if v}) < 2:
        assert [(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"]) for r in got] == [(i, k, 0, None, 0.0) for i, v in rows if v for k in (1, 2)]
    else:
        compare(got, plain(rows))


def test_spectra():
    """Updates and merges of equal, close, dependent and constant columns keep the scatter and orthogonal vectors."""
    rng = np.random.default_rng(3)
    base = rng.integers(-200, 200, (300, 12))
    cases = [base, base * 0 + 5, np.repeat(base[:, :3], 4, 1), np.kron(np.eye(12, dtype=np.int64), np.ones((4, 1), np.int64)), np.vstack([base] * 4), (base // 150) * 10**6, np.eye(12, dtype=np.int64) * 2**40]
    for x in cases:
        parts = []
        for part in np.array_split(x, 4):
            parts.append(whitening.Spectrum(12))
            for at in range(0, len(part), 5):
                parts[-1].add(part[at : at + 5])
        first = whitening.Spectrum.of(parts[0].row(0))
        for part in parts[1:]:
            first.merge(part)
        centred = x - x.mean(0)
        scatter = centred.T @ centred
        assert first.n == len(x) and first.sums.tolist() == x.sum(0).tolist()
        assert np.abs(first.vectors * first.values @ first.vectors.T - scatter).max() <= 1e-12 * max(1, np.abs(scatter).max())
        assert np.abs(first.vectors.T @ first.vectors - np.eye(len(first.values))).max(initial=0) < 1e-12


def test_secular_roots():
    rng = np.random.default_rng(4)
    for d in (np.sort(rng.normal(size=30)), np.arange(8.0), np.array([0, 1e-9, 1, 1 + 1e-12, 5]), np.logspace(-12, 3, 20)):
        for scale in (1e-6, 1.0, 1e3):
            z = rng.normal(size=len(d)) * scale
            values, vectors = whitening.solved(d, z)
            whole = np.diag(d) + np.outer(z, z)
            assert np.allclose(values, np.linalg.eigvalsh(whole), rtol=1e-12, atol=1e-13 * np.abs(whole).max())
            assert np.abs(vectors.T @ vectors - np.eye(len(d))).max() < 1e-12


def test_large_whole_numbers():
    x = np.array([[2**40, -(2**62)], [3, 2**62]], np.int64)
    sums = whitening.exact_sums(x)
    assert sums.tolist() == [2**40 + 3, 0]
    far = whitening.differences(x, 2, sums)
    assert far.tolist() == [[2**40 - 3, -(2**63)], [3 - 2**40, 2**63]]
    assert whitening.deviations(far) == [None, None]
    assert whitening.deviations(np.array([[3, 4]])) == [25]
