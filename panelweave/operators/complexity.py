"""Entropies, phrase counts and Hurst exponents of trailing windows, the current row left out.

Rows come sorted by key; an Arrow batch and the last values of the batch before
make all its windows by a strided view, and each measure is one numpy pass over
a matrix of windows, not a call a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import forward_fill, ordered, rounded, ship
from panelweave.plans.views import prices
from panelweave.registry import query
from panelweave.scans import numbers

WINDOW, PRICE_WINDOW, CELLS = 63, 126, 1 << 20
Measure = Callable[[np.ndarray], np.ndarray]


def _near(x: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which values of a window lie within a fifth of its deviation of each other, as bits of 64-bit words (by word, window, value), and whether that is a distance at all.

    Near a value is a run of the sorted window, whose end is found by halving
    steps on the differences themselves, so no pair is compared by itself. A
    run's bits are the sum of those up to its end less those before it.
    """
    rows, n = x.shape
    ok = np.isfinite(x).all(1) & (n >= 10)
    x = np.where(ok[:, None], x, 0)
    r = 0.2 * x.std(1)
    ok &= r >= 1e-12
    r, order, steps = np.where(ok, r, 1)[:, None], np.argsort(x, 1), [1 << b for b in reversed(range(n.bit_length()))]
    wide, row = n + 2 * steps[0], np.arange(rows)[:, None]
    s = np.full((rows, wide), np.inf)
    s[:, :n] = np.take_along_axis(x, order, 1)
    flat, low, at = s.reshape(-1), s[:, :n].copy(), row * wide + np.arange(n)
    for step in steps:
        gap = flat.take(at + step) - low
        at += step * ((gap < r) if strict else (gap <= r))
    end = at - row * wide + 1
    # the run of the k-th value begins after the values whose runs have ended by then
    begin = np.bincount((row * (n + 1) + end).reshape(-1), minlength=rows * (n + 1)).reshape(rows, n + 1).cumsum(1)[:, :n]
    end, begin, own = ((row * width + of).reshape(-1) for width, of in ((n + 1, end), (n + 1, begin), (n, order)))
    near, upto = np.empty((-(-n // 64), rows * n), np.uint64), np.zeros((rows, n + 1), np.uint64)
    bit = np.uint64(1) << (order & 63).astype(np.uint64)
    for k, word in enumerate(near):
        np.cumsum(np.where(order >> 6 == k, bit, np.uint64(0)), 1, out=upto[:, 1:])
        word[own] = upto.take(end) - upto.take(begin)
    return near.reshape(-1, rows, n), ok


def _longer(near: np.ndarray, by: int) -> np.ndarray:
    """For each place from how many places ``by`` values in a row are near."""
    n = near.shape[2] - by + 1
    out = near[:, :, :n].copy()
    for k in range(1, by):
        later = near[:, :, k : k + n]
        moved = later >> np.uint64(k)
        moved[:-1] |= later[1:] << np.uint64(64 - k)
        out &= moved
    return np.bitwise_count(out).sum(0, dtype=np.int64)


def sample_entropy(x: np.ndarray, order: int = 2) -> np.ndarray:
    """Minus the log of how often templates that match for ``order`` values match for one more; null where none does."""
    near, ok = _near(x, True)
    pairs = [(_longer(near, m).sum(1) - (x.shape[1] - m + 1)) // 2 for m in (order + 1, order)]
    ok &= (pairs[0] > 0) & (pairs[1] > 0)
    return np.where(ok, -np.log(np.where(ok, pairs[0], 1) / np.where(ok, pairs[1], 1)), np.nan)


def approximate_entropy(x: np.ndarray, order: int = 2) -> np.ndarray:
    """The variant in which a template matches itself."""
    near, ok = _near(x, False)
    logs = lambda m: np.log(np.maximum(np.arange(m.shape[1] + 1), 1) / m.shape[1])[m]
    phi = [logs(m).mean(1) for m in (_longer(near, order), _longer(near, order + 1))]
    return np.where(ok, np.abs(phi[0] - phi[1]), np.nan)


def permutation_entropy(x: np.ndarray, order: int = 3) -> np.ndarray:
    """Entropy of the order types of ``order`` values in a row, over its maximum; earlier of equal values first, missing ones last."""
    n = x.shape[1] - order + 1
    if n < 5:
        return np.full(len(x), np.nan)
    at, gap, types = [x[:, k : k + n] for k in range(order)], np.isnan(x).any(), np.zeros((len(x), n), np.int64)
    for bit, (a, b) in enumerate(combinations(at, 2)):
        types |= ((a > b) | (np.isnan(a) & ~np.isnan(b)) if gap else a > b).astype(np.int64) << bit
    share = np.stack([(types == t).sum(1) for t in np.unique(types)], 1) / n if len(x) else np.zeros((0, 1))
    return -(share * np.log2(share + 1e-15)).sum(1) / np.log2(factorial(order))


def phrase_complexity(x: np.ndarray) -> np.ndarray:
    """Distinct phrases of the string of rises, read from the left, over what a random string of the length has.

    A phrase is a number with its length as leading bit. The k-th longest takes
    k letters and all shorter ones came before, which bounds their length.
    """
    n = x.shape[1]
    if n < 2:
        return np.full(len(x), np.nan)
    bits = int((8 * n + 1) ** 0.5 / 2) + 2
    known, word, count, at = np.zeros((len(x), 2 << bits), bool), np.ones(len(x), np.int64), np.zeros(len(x)), np.arange(len(x))
    for k in range(n):
        longer = 2 * word + (x[:, k] > 0)
        old = known[at, longer]
        known[at, longer] = True
        count += ~old
        word = np.where(old, longer, 1)
    return (count + (word > 1)) / (n / max(np.log2(n), 1e-12))


def hurst(x: np.ndarray) -> np.ndarray:
    """Slope of log rescaled range on log length over all beginnings of the window, within 0 and 1; null with fewer than 5 of them."""
    n = x.shape[1]
    if n < 20:
        return np.full(len(x), np.nan)
    size, x = np.abs(x).max(1, keepdims=True), x - x.mean(1, keepdims=True)
    t, y = np.arange(1, n + 1), x.cumsum(1)
    mean = y / t
    spread = np.sqrt(np.maximum((x * x).cumsum(1) / t - mean * mean, 0))
    path, inside = y[:, None, :] - t * mean[:, :, None], np.tri(n, dtype=bool)
    span = np.where(inside, path, -np.inf).max(2) - np.where(inside, path, np.inf).min(2)
    with np.errstate(all="ignore"):
        v = np.log(span / np.where(spread > 1e-7 * size, spread, np.nan))[:, 1:]
        u, ok = np.broadcast_to(np.log(t)[1:], v.shape), np.isfinite(v)
        m = ok.sum(1)
        u0, v0 = (np.where(ok, w, 0).sum(1) / np.maximum(m, 1) for w in (u, v))
        du, dv = np.where(ok, u - u0[:, None], 0), np.where(ok, v - v0[:, None], 0)
        slope = (du * dv).sum(1) / (du * du).sum(1)
    return np.where(m >= 5, np.clip(slope, 0, 1), np.nan)


def _windows(batches: Iterator[pa.RecordBatch], key: str, measures: Sequence[tuple[str, str, int, Measure]]) -> Iterator[pa.RecordBatch]:
    columns = list(dict.fromkeys(c for _, c, _, _ in measures))
    most = max(w for *_, w, _ in measures)
    now, kept = (), np.zeros((0, len(columns)))
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, x = batch.column(batch.schema.get_field_index(key)).to_pylist(), numbers(batch, columns)
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        out = {name: np.full(len(keys), np.nan) for name, *_ in measures}
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            kept = np.concatenate((kept if (keys[a],) == now else kept[:0], x[a:b]))
            now, first = (keys[a],), len(kept) - (b - a)
            for name, column, window, measure in measures:
                series = kept[:, columns.index(column)]
                begin = max(first, window)  # the first row with a whole window before it
                if begin < len(series):
                    frames = sliding_window_view(series[begin - window : -1], window)
                    step = max(1, CELLS // window**2)
                    out[name][a + begin - first : b] = np.concatenate([measure(frames[k : k + step]) for k in range(0, len(frames), step)])
            kept = kept[-most:]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, pa.float64(), from_pandas=True) for v in out.values()]], names=[*batch.schema.names, *out])


def windows(df: DataFrame, key: str, order: Sequence[str], measures: Sequence[tuple[str, str, int, Measure]]) -> DataFrame:
    """``df`` with measures (name, column, window, function of a matrix of windows) of the rows before each row; null without a whole window.

    A key's rows pass through one task in order, a batch at a time.
    """
    ship(df.sparkSession)
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"{name} double" for name, *_ in measures]])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(partial(_windows, key=key, measures=measures), ddl)


MEASURES = [("sample_entropy", "ret", WINDOW, sample_entropy), ("perm_entropy", "ret", WINDOW, permutation_entropy), ("lz_complexity", "ret", WINDOW, phrase_complexity), ("approx_entropy_price", "close", PRICE_WINDOW, approximate_entropy)]


def panel(spark, sf_dir) -> DataFrame:
    """Closes carried forward, and returns, missing ones as 0."""
    back = F.col("close") / F.lag("close").over(ordered()) - 1
    return prices(spark, sf_dir).select("entity_id", "date", F.coalesce(back, F.lit(0.0)).alias("ret"), forward_fill("close").alias("close"))


def measured(spark, sf_dir, *names: str) -> DataFrame:
    wanted = [m for m in [*MEASURES, ("hurst", "ret", WINDOW, hurst)] if m[0] in names]
    found = windows(panel(spark, sf_dir), "entity_id", ["date"], wanted)
    return found.select("entity_id", "date", *[rounded(F.col(n)).alias(n) for n in names])


@query("win13_rolling_hurst")
def win13(spark, sf_dir):
    return measured(spark, sf_dir, "hurst")


@query("win67_sample_entropy")
def win67(spark, sf_dir):
    return measured(spark, sf_dir, "sample_entropy")


@query("win68_approximate_entropy")
def win68(spark, sf_dir):
    return measured(spark, sf_dir, "approx_entropy_price")


@query(
    "win69_phrase_complexity",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT entity_id, date, row_number() OVER w AS t, CASE WHEN close > lag(close) OVER w THEN '1' ELSE '0' END AS bit FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
    f AS MATERIALIZED (SELECT entity_id, date, t, CASE WHEN t > 63 THEN string_agg(bit, '') OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) END AS word FROM s),
    r AS (SELECT entity_id, date, word, 0 AS k, '' AS phrase, []::VARCHAR[] AS known FROM f WHERE word IS NOT NULL
     UNION ALL SELECT entity_id, date, word, k + 1, CASE WHEN list_contains(known, phrase || substr(word, k + 1, 1)) THEN phrase || substr(word, k + 1, 1) ELSE '' END, CASE WHEN list_contains(known, phrase || substr(word, k + 1, 1)) THEN known ELSE list_append(known, phrase || substr(word, k + 1, 1)) END FROM r WHERE k < 63)
    SELECT f.entity_id, f.date, round((len(known) + CASE WHEN phrase <> '' THEN 1 ELSE 0 END) / (63 / log2(63)) + 1e-9, 6) AS lz_complexity FROM f LEFT JOIN (SELECT * FROM r WHERE k = 63) e USING (entity_id, date)""",
)
def win69(spark, sf_dir):
    return measured(spark, sf_dir, "lz_complexity")


@query("win70_complexity_pass")
def win70(spark, sf_dir):
    return measured(spark, sf_dir, *[m[0] for m in MEASURES])
