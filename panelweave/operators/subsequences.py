"""Windows of a series that resemble each other: motifs, discords, and analogs of the latest window.

A series is cut into blocks of window starts. Motifs compare every pair of
blocks, analogs every block with the last window, each in a group of bounded
size, so a long series is spread over tasks and no window is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, ship, trailing
from panelweave.plans.views import prices
from panelweave.registry import query
from panelweave.scans import Family, scan
from panelweave.sources.files import scratch

BLOCK, DIGITS = 1024, 5
#: Windows, how many are reported, the least history, the days after an analog and before the latest window.
WINDOW, MOTIFS, ANALOGS, HISTORY, HORIZON, GAP, YEAR = 21, 3, 5, 100, 21, 10, 252


class Place(Family):
    """Nothing but the row's number in its key."""

    width, neutral, outputs = 1, np.array([0.0]), ()

    def elements(self, x):
        return np.zeros((len(x), 1))

    def compose(self, first, then):
        return first + then

    def said(self, before, x, start, place):
        return []


def numbered(df: DataFrame, key: str, order: str, values: Sequence[str], label: str) -> DataFrame:
    """``k``, ``at``, ``t`` (from 0), ``n`` (the key's rows) and values ``v0``, ``v1`` and so on, in the shared folder. Non-finite values are null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).alias(f"v{j}") for j, c in enumerate(F.col(v).cast("double") for v in values)]
    rows = scan(df.select(F.col(key).alias("k"), F.col(order).alias("at"), *clean), "k", ["at"], ["v0"], Place(), scratch(df.sparkSession, label))
    size = rows.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("n"))
    rows = rows.join(size, F.col("k").eqNullSafe(F.col("_k"))).select("k", "at", (F.col("place") - 1).alias("t"), "n", *[f"v{j}" for j in range(len(values))])
    path = scratch(df.sparkSession, label)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def shapes(v: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows less their mean at length 1, which have no gap, and which are constant."""
    w = sliding_window_view(v, window)
    whole = ~np.isnan(w).any(1)
    w = np.where(whole[:, None], w, 0)
    z = w - w.mean(1, keepdims=True)
    size = np.linalg.norm(z, axis=1, keepdims=True)
    flat = size[:, 0] <= 1e-10 * np.maximum(np.abs(w).max(1), 1e-300)
    return np.where(flat[:, None], 0, z / np.where(size > 0, size, 1)), whole, flat


def distances(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Between z-normalised windows of two series; constant ones are 0 from each other and the root of the length from others; infinite at a gap."""
    (x, whole, flat), (y, whole_y, flat_y) = shapes(a, window), shapes(b, window)
    square = 2 * window * np.maximum(1 - x @ y.T, 0)
    square = np.where(flat[:, None] & flat_y, 0, np.where(flat[:, None] | flat_y, window, square))
    return np.where(whole[:, None] & whole_y, np.round(np.sqrt(square), DIGITS), np.inf)


def profile(df: DataFrame, key: str, order: str, value: str, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``k, t, near, distance``: for each window start the other window of the key that is nearest in shape, the earliest of equal ones.

    Windows that begin within a quarter of a window of it, and those with a gap,
    don't count. Each pair of blocks is one group of at most twice ``block`` and
    a window's rows; work grows with the square of a key's rows, spread
    over as many groups. Keys of fewer than three windows' rows are left out.
    """
    ship(df.sparkSession)
    rows, away = numbered(df, key, order, [value], "profile").where(f"n >= {3 * window}"), ceil(window / 4)
    last = f"(n - {window}) div {block}"
    own = F.expr(f"filter(array(t div {block}, CASE WHEN t % {block} < {window - 1} THEN t div {block} - 1 END), b -> b BETWEEN 0 AND {last})")
    dealt = rows.select("k", "t", "n", F.col("v0").alias("v"), F.explode(own).alias("own")).withColumn("other", F.explode(F.expr(f"sequence(0L, {last})")))
    dealt = dealt.select("k", "t", "n", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        ends = int(g["a"].iloc[0]), int(g["b"].iloc[0])
        starts, side = int(g["n"].iloc[0]) - window + 1, []
        sizes = [min(block, starts - of * block) for of in ends]
        for of, width in zip(ends, sizes):
            v = np.full(width + window - 1, np.nan)
            mine = g[g["own"] == of]
            v[mine["t"].to_numpy() - of * block] = mine["v"].to_numpy(float)
            side.append(v)
        d = distances(*side, window)
        i, j = (of * block + np.arange(width) for of, width in zip(ends, sizes))
        d[np.abs(i[:, None] - j) <= away] = np.inf
        out = []
        for d, i, j in ((d, i, j), (d.T, j, i))[: 1 + (ends[0] != ends[1])]:
            best = d.argmin(1)
            least = d[np.arange(len(d)), best]
            keep = np.isfinite(least)
            out.append(pd.DataFrame({"k": pd.Series([g["k"].iloc[0]] * int(keep.sum()), dtype=g["k"].dtype), "t": i[keep], "near": j[best][keep], "distance": least[keep]}))
        return pd.concat(out)

    found = dealt.groupBy("k", "a", "b").applyInPandas(tile, f"k {rows.schema['k'].dataType.simpleString()}, t long, near long, distance double")
    return found.groupBy("k", "t").agg(F.min(F.struct("distance", "near")).alias("best")).select("k", "t", "best.near", "best.distance")


def _chosen(found: DataFrame, top: int, window: int, motif: bool) -> DataFrame:
    """The best ``top`` windows of each key in turn, none of which begins within one chosen before (for motifs: nor its partner)."""
    spark, taken = found.sparkSession, None
    order = F.struct("distance", "t") if motif else F.struct(-F.col("distance"), "t")
    for place in range(1, top + 1):
        left = found.where(F.abs(F.col("t") - F.col("near")) >= window) if motif else found
        if taken is not None:
            starts = F.flatten(F.collect_list(F.array("t", "near") if motif else F.array("t")))
            held = taken.groupBy(F.col("k").alias("_k")).agg(starts.alias("starts"))
            inside = "exists(starts, s -> {0} >= s AND {0} < s + " + str(window) + ")"
            bad = " OR ".join(inside.format(x) for x in (("t", "near") if motif else ("t",)))
            left = left.join(held, F.col("k").eqNullSafe(F.col("_k"))).where(f"NOT ({bad})").select(*found.columns)
        pick = left.groupBy("k").agg(F.min_by(F.struct("t", "near", "distance"), order).alias("b")).select("k", "b.*", F.lit(place).alias("place"))
        path = scratch(spark, "motifs")
        pick.write.parquet(path)
        pick = spark.read.schema(pick.schema).parquet(path)
        taken = pick if taken is None else taken.unionByName(pick)
    return taken.select("k", F.lit("motif" if motif else "discord").alias("kind"), "place", "t", "near", "distance")


def motifs(found: DataFrame, top: int = MOTIFS, window: int = WINDOW) -> DataFrame:
    """``k, kind, place, t, near, distance`` of the ``top`` motifs (pairs of windows nearest to each other) and discords (windows farthest from all others) of a ``profile``."""
    path = scratch(found.sparkSession, "profile")
    found.write.parquet(path)
    found = found.sparkSession.read.schema(found.schema).parquet(path)
    return _chosen(found, top, window, True).unionByName(_chosen(found, top, window, False))


# Analogs


def warped(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """Dynamic time warping of each row of x to y, steps at most ``band`` apart: the root of the least sum of squared differences.

    Further dimensions of x and y are warped side by side. Cells go by diagonals, on which none waits for another.
    """
    q, x = len(y), np.ascontiguousarray(np.moveaxis(x, 0, 1))
    before, last = (np.full((q + 1, *x.shape[1:]), np.inf) for _ in range(2))  # by row of the cell, which begin at 1
    before[0] = 0
    for d in range(2 * q - 1):
        i = np.arange(max(0, d - q + 1, -((band - d) // 2)), min(d, q - 1, (d + band) // 2) + 1)
        if len(i):
            own, up = slice(i[0], i[-1] + 1), slice(i[0] + 1, i[-1] + 2)
            least = np.minimum(before[own], last[own])
            np.minimum(least, last[up], out=least)
            gap = x[own] - y[d - i][:, None]
            gap *= gap
            np.add(gap, least, out=before[up])
            before[i[0]] = np.inf  # rows only grow, so no later cell is nearer to the front
        else:
            before[:] = np.inf
        before, last = last, before
    return np.sqrt(last[q])


def bounded(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """At most what ``warped`` gives: how far rows lie outside the band's envelope of y, or with no band how far y lies outside theirs; the ends always meet."""
    near = np.abs(np.arange(len(y))[:, None] - np.arange(len(y))) <= band
    high, low = np.where(near, y, -np.inf).max(1), np.where(near, y, np.inf).min(1)
    ends = ((x[:, [0, -1]] - y[[0, -1]]) ** 2).sum(1) if len(y) > 1 else (x[:, 0] - y[0]) ** 2
    found = (np.maximum(np.maximum(x - high, low - x), 0)[:, 1:-1] ** 2).sum(1)
    if band >= len(y) - 1:
        over, under = y[1:-1] - x.max(1, keepdims=True), x.min(1, keepdims=True) - y[1:-1]
        found = np.maximum(found, (np.maximum(np.maximum(over, under), 0) ** 2).sum(1))
    return np.sqrt(ends + found)


def nearest(windows: np.ndarray, last: np.ndarray, k: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` windows (by length by feature) nearest to ``last`` and their distances, sums over features; only those whose bound allows it are warped."""
    count = range(last.shape[1])
    least = sum(bounded(windows[:, :, f], last[:, f], band) for f in count)

    def exact(chosen: np.ndarray) -> np.ndarray:
        each = warped(windows[chosen], last, band)
        return sum(each[:, f] for f in count)

    first = np.argsort(least, kind="stable")[: 6 * k]
    d = np.full(len(windows), np.inf)
    d[first] = exact(first)
    bar = np.sort(d[first])[:k].max(initial=0)  # k windows are as near as that
    rest = np.flatnonzero((least <= bar * (1 + 1e-9) + 10.0**-DIGITS) & np.isinf(d))
    d[rest] = exact(rest)
    d = np.round(d, DIGITS)
    best = np.argsort(d, kind="stable")[:k]
    return best, d[best]


def analogs(df: DataFrame, key: str, order: str, close: str, variables: Sequence[str], window: int = WINDOW, k: int = ANALOGS, horizon: int = HORIZON, gap: int = GAP, band: int | None = None, block: int = BLOCK) -> DataFrame:
    """The ``k`` earlier windows of each key most like its last one, and what followed.

    Variables are standardised over the key's history, missing values are its
    mean; distance is the sum over variables of their warped distances, steps
    at most ``band`` apart (None: any). Windows end ``gap`` rows or more before
    the last one begins; equal distances go to the earlier. Window and
    horizon are at most a quarter of the history, and keys of fewer than 100 rows, or
    too few for window, gap and horizon, have no analogs. Of a block of window
    starts a task keeps its best ``k``. Returns ``k, place, start_at, end_at,
    distance``, the return, largest drawdown and yearly volatility of the days
    after (null with fewer than two), and per key mean, median, 5th and 95th
    percentile of those returns and the worst drawdown.
    """
    ship(df.sparkSession)
    rows, count = numbered(df, key, order, [*variables, close], "analogs"), len(variables)
    q, h = f"least({window}L, greatest(3L, n div 4))", f"least({horizon}L, greatest(1L, n div 4))"
    rows = rows.selectExpr("*", f"{q} AS q", f"{h} AS h").where(f"n >= {HISTORY} AND n >= q + h + {gap}").withColumn("starts", F.expr(f"n - q - {gap}"))
    moments = rows.groupBy(F.col("k").alias("_k")).agg(*[f(f"v{j}").alias(f"{n}{j}") for j in range(count) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.expr(f"coalesce((v{j} - m{j}) / CASE WHEN s{j} < 1e-8 THEN 1D ELSE s{j} END, 0D)").alias(f"z{j}") for j in range(count)]
    scaled = rows.join(moments, F.col("k").eqNullSafe(F.col("_k"))).select("k", "t", "n", "q", "starts", *z)
    own = F.expr(f"filter(array(t div {block}, CASE WHEN t % {block} < q - 1 THEN t div {block} - 1 END), b -> b BETWEEN 0 AND (starts - 1) div {block})")
    seek = scaled.where("t >= n - q").select("*", F.explode(F.expr(f"sequence(0L, (starts - 1) div {block})")).alias("b"), F.lit(True).alias("last"))
    dealt = scaled.select("*", F.explode(own).alias("b"), F.lit(False).alias("last")).unionByName(seek)

    names = [f"z{j}" for j in range(count)]

    def search(g: pa.Table) -> pa.Table:
        size, begin = g["q"][0].as_py(), g["b"][0].as_py() * block
        end = min(begin + block, g["starts"][0].as_py())
        values, t, last = np.column_stack([g[n].to_numpy() for n in names]), g["t"].to_numpy(), g["last"].to_numpy()
        latest = values[last][t[last].argsort()]
        x = np.zeros((block + size - 1, count))
        x[t[~last] - begin] = values[~last]
        best, d = nearest(sliding_window_view(x[: end - begin + size - 1], size, 0).transpose(0, 2, 1), latest, k, size if band is None else band)
        return pa.table({"k": g["k"].take(pa.array(np.zeros(len(best), np.int64))), "t": begin + best, "distance": d})

    dealt = dealt.select("k", "b", "t", "q", "starts", "last", *names)
    found = dealt.groupBy("k", "b").applyInArrow(search, f"k {rows.schema['k'].dataType.simpleString()}, t long, distance double")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("distance", "t"))).where(f"place <= {k}")
    path = scratch(df.sparkSession, "analogs")
    found.write.parquet(path)
    found = df.sparkSession.read.schema(found.schema).parquet(path)
    size = rows.groupBy(F.col("k").alias("_k")).agg(F.first("n").alias("n"), F.first("q").alias("q"), F.first("h").alias("h"))
    spans = found.join(size, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    # the window's two ends, the day before what followed, and what followed
    wanted = spans.select(F.col("k").alias("_k"), F.col("t").alias("begin"), "distance", "place", "q", F.explode(F.expr("concat(array(t), sequence(t + q - 1, least(t + q + h, n) - 1))")).alias("_t")).distinct()
    seen = wanted.join(rows.select("k", "t", "at", F.col(f"v{count}").alias("price")), F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")))
    each = Window.partitionBy("k", "place").orderBy("t")
    after, before = F.col("t") >= F.col("begin") + F.col("q"), F.lag("price").over(each)
    seen = seen.withColumn("ret", F.when(after & (before != 0), F.col("price") / before - 1)).withColumn("price", F.when(after, F.col("price")))
    seen = seen.withColumn("fall", F.col("price") / F.max("price").over(each) - 1)
    spoke = F.when(F.col("price").isNotNull(), F.col("t"))
    out = seen.groupBy("k", "place", "distance").agg(
        F.min("at").alias("start_at"), F.max(F.when(~after, F.col("at"))).alias("end_at"), F.count("price").alias("_days"), F.count("ret").alias("_rets"),
        (F.max_by("price", spoke) / F.min_by("price", spoke) - 1).alias("_return"), F.min("fall").alias("_fall"), (F.stddev_samp("ret") * YEAR**0.5).alias("_vol"),
    )
    out = out.select("k", "place", "start_at", "end_at", "distance", *[F.when(F.col("_days") > 1, F.col(c)).alias(n) for c, n in (("_return", "outcome_return"), ("_fall", "max_drawdown"))], F.when(F.col("_rets") > 1, F.col("_vol")).alias("volatility"))
    every = Window.partitionBy("k")
    told = {"mean": F.avg("outcome_return"), "median": F.percentile("outcome_return", 0.5), "p5": F.percentile("outcome_return", 0.05), "p95": F.percentile("outcome_return", 0.95)}
    return out.select("*", *[c.over(every).alias(f"{n}_return") for n, c in told.items()], F.min("max_drawdown").over(every).alias("worst_drawdown")).withColumnRenamed("k", key)


@query("top06_historical_analogs")
def top06(spark, sf_dir):
    """Of close, return, volatility and volume."""
    back = F.col("close") / F.lag("close").over(ordered()) - 1
    rows = prices(spark, sf_dir).withColumn("ret", back).withColumn("vol", F.stddev_samp("ret").over(trailing(21)))
    found = analogs(rows, "entity_id", "date", "close", ["close", "ret", "vol", "volume"])
    return found.select("entity_id", "place", F.col("start_at").alias("start_date"), F.col("end_at").alias("end_date"), *[rounded(F.col(c), 4).alias(c) for c in found.columns[4:]])


@query("top07_motifs_and_discords")
def top07(spark, sf_dir):
    """Of each entity's close."""
    rows = prices(spark, sf_dir).select("entity_id", "date", "close")
    found = motifs(profile(rows, "entity_id", "date", "close"))
    return found.select(F.col("k").alias("entity_id"), "kind", "place", F.col("t").alias("start_row"), F.col("near").alias("nearest_row"), rounded(F.col("distance"), 4).alias("distance"))
