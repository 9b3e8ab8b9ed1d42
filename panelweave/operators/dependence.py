"""Kendall's tau and natural breaks, both exact, with bounded work in a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, ship
from panelweave.plans.views import peers, prices
from panelweave.registry import query
from panelweave.sources.files import written
from panelweave.sqlops import select

BLOCKS, BLOCK_ROWS, CLASSES, BINS = 256, 50_000, 5, 512


def inversions(y: np.ndarray) -> int:
    """Pairs that stand in the wrong order, equal ones not counted, by merging sorted halves of all sizes at once, bit by bit of the ranks."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    total, at = 0, np.arange(len(rank))
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        high, ones = rank >> (bit + 1), rank >> bit & 1
        order = np.lexsort((at, high))  # within equal higher bits in the order of the rows
        group, one = high[order], ones[order]
        before = np.cumsum(one) - one
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        start = np.repeat(before[first], np.diff(np.append(first, len(group))))
        total += int((before - start)[one == 0].sum())
    return total


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs that x and y order in opposite ways; ties of either count for none."""
    return inversions(y[np.lexsort((y, x))])


def _edges(c: str, blocks: int):
    return F.percentile_approx(c, [k / blocks for k in range(1, blocks)], 10_000)


def kendall(df: DataFrame, key: str, x: str, y: str, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per ``key`` the number of complete rows, concordant and discordant pairs and tau-b, exact.

    Values of either side are cut into ranges of about ``block_rows`` rows, ``blocks`` at most. Discordant
    pairs of different ranges on both sides follow from the counts of the
    cells; those within a range of x, or of y, are counted there by merging,
    and those within a cell, which both have counted, are taken off once. A
    task holds the rows of one range, a ``blocks``-th of a key's, or those of
    one repeated value, which have no such pairs and are left out. Equal values
    are always in one range. Keys of at most ``block_rows`` rows need no
    ranges; their pairs are counted as a whole. tau is null where a side has no
    two values.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = written(rows, "kendall")
    large = rows.groupBy("k").agg(F.count("*").alias("n")).where(f"n > {block_rows}").select(F.col("k").alias("_k"))
    large = written(large, "kendall")  # at most one key for so many rows
    if large.isEmpty():
        out = _whole(rows)
    else:
        on = F.col("k").eqNullSafe(F.col("_k"))
        out = _whole(rows.join(F.broadcast(large), on, "left_anti")).unionByName(_ranged(rows.join(F.broadcast(large), on, "left_semi"), blocks, block_rows))
    out = out.withColumn("pairs", F.expr("n * (n - 1) div 2")).withColumn("concordant", F.expr("pairs - tx - ty + txy - discordant"))
    below = (F.col("pairs") - F.col("tx")).cast("double") * (F.col("pairs") - F.col("ty")).cast("double")
    return out.select(F.col("k").alias(key), "n", "concordant", "discordant", F.when(below > 0, (F.col("concordant") - F.col("discordant")) / F.sqrt(below)).alias("tau"))


def _tied(*sides: np.ndarray) -> int:
    """Pairs that are equal on all sides; equal rows are neighbours."""
    new = np.append(True, np.any([s[1:] != s[:-1] for s in sides], axis=0))
    n = np.diff(np.append(np.flatnonzero(new), len(new)))
    return int((n * (n - 1) // 2).sum())


def _whole(rows: DataFrame) -> DataFrame:
    """``k, n``, discordant pairs and pairs tied in x, in y and in both, a key's rows together."""

    def count(g: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(g[c].to_numpy(), return_inverse=True)[1] for c in ("x", "y"))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        return pd.DataFrame({"k": g["k"].iloc[:1], "n": [len(x)], "discordant": [inversions(y)], "tx": [_tied(x)], "ty": [_tied(np.sort(y))], "txy": [_tied(x, y)]})

    return rows.groupBy("k").applyInPandas(count, f"k {rows.schema['k'].dataType.simpleString()}, n long, discordant long, tx long, ty long, txy long")


def _ranged(rows: DataFrame, blocks: int, block_rows: int) -> DataFrame:
    """The same by ranges of either side."""
    cuts = rows.groupBy("k").agg(_edges("x", blocks).alias("ex"), _edges("y", blocks).alias("ey"), F.least(F.lit(blocks), F.ceil(F.count("*") / block_rows)).alias("parts"))
    place = f"CAST(size(filter({{e}}, e -> e < {{c}})) * parts div {blocks} AS INT)"
    held = rows.join(cuts.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k"))).selectExpr("k", "x", "y", f"{place.format(e='ex', c='x')} AS bx", f"{place.format(e='ey', c='y')} AS bey")
    held = written(held, "kendall")  # read eight times below
    rows = held.select("k", "x", "y")

    def within(*by: str) -> DataFrame:
        # ranges of one value only hold no discordant pair, and may be large
        sizes = held.groupBy("k", *by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 < x1 AND y0 < y1").selectExpr("k AS _k", *[f"{b} AS _{b}" for b in by])
        on = F.col("k").eqNullSafe(F.col("_k"))
        for b in by:
            on = on & (F.col(b) == F.col(f"_{b}"))
        live = held.join(sizes, on, "left_semi")
        count = lambda g: pd.DataFrame({"k": g["k"].iloc[:1], "d": [discordant(g["x"].to_numpy(), g["y"].to_numpy())]})
        return live.groupBy("k", *by).applyInPandas(count, f"k {held.schema['k'].dataType.simpleString()}, d long")

    def across(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((blocks + 1, blocks + 1), object)
        m[g["bx"], g["bey"]] = [int(n) for n in g["n"]]
        low = np.cumsum(m, axis=1)  # rows of a range of x up to a range of y
        later = np.cumsum(low[::-1], axis=0)[::-1]
        d = sum(int(m[i, j]) * int(later[i + 1, j - 1]) for i in range(blocks) for j in range(1, blocks + 1) if m[i, j])
        return pd.DataFrame({"k": g["k"].iloc[:1], "d": [d]})

    cells = held.groupBy("k", "bx", "bey").agg(F.count("*").alias("n")).groupBy("k").applyInPandas(across, f"k {held.schema['k'].dataType.simpleString()}, d long")
    parts = cells.unionByName(within("bx")).unionByName(within("bey")).unionByName(within("bx", "bey").withColumn("d", -F.col("d")))
    total = parts.groupBy("k").agg(F.sum("d").alias("discordant"))
    tied = lambda *by: rows.groupBy("k", *by).agg(F.count("*").alias("n")).groupBy("k").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("t"))
    out = rows.groupBy("k").agg(F.count("*").alias("n"))
    for name, t in (("discordant", total), ("tx", tied("x")), ("ty", tied("y")), ("txy", tied("x", "y"))):
        t = t.toDF("_k", name)
        out = out.join(t, F.col("k").eqNullSafe(F.col("_k")), "left").drop("_k")
    return out.withColumn("discordant", F.coalesce("discordant", F.lit(0)))


def partition(value: np.ndarray, count: np.ndarray, total: np.ndarray, squares: np.ndarray, classes: int) -> list[int]:
    """The last item of each class but the last, for the least sum of squares within classes; of equal ones the earliest cut."""
    n, s, q = (np.append(0.0, np.cumsum(v)) for v in (count, total, squares))
    m = len(value)
    with np.errstate(all="ignore"):
        i, j = np.arange(m)[:, None], np.arange(m)[None] + 1
        cost = np.where(j > i, (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i]), np.inf)  # of items i to j - 1
    best, back = cost[0], []
    for _ in range(classes - 1):
        whole = np.concatenate(([np.inf], best[:-1]))[:, None] + cost  # the last class begins at i
        at = np.argmin(whole, axis=0)
        best = whole[at, np.arange(m)]
        back.append(at)
    cuts, end = [], m - 1
    for at in reversed(back):
        end = int(at[end]) - 1
        cuts.append(end)
    return cuts[::-1]


def natural_breaks(df: DataFrame, key: str, x: str, classes: int = CLASSES, bins: int = BINS) -> DataFrame:
    """Per key the ``classes`` - 1 interior breaks, each the largest value of its class, that leave the least variance within classes.

    Exact where a key has at most ``bins`` different values. Beyond that values
    fall into so many bins of equal width, breaks lie between bins, and a break
    is less than a bin's width from one that is best for the binned values. A task holds the
    bins of a key, never its rows. Keys of fewer than two rows a class, or
    fewer values than classes, have no breaks; nulls are left out.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(x).isNotNull()).groupBy(F.col(key).alias("k"), F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
    span = rows.groupBy("k").agg(F.count("*").alias("values"), F.sum("n").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high")).where(f"rows >= {2 * classes} AND values >= {classes}").withColumnRenamed("k", "_k")
    held = rows.join(span, F.col("k").eqNullSafe(F.col("_k")))
    number = F.when(F.col("values") > bins, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)))
    middle = (F.col("x") - F.col("low")).alias("d")  # squares keep their digits
    cells = held.select("k", "n", "x", "low", middle, number.alias("bin"), F.when(number.isNull(), F.col("x")).alias("own"))
    cells = cells.groupBy("k", "bin", "own").agg(F.max("x").alias("top"), F.sum("n").alias("count"), F.sum(F.expr("n * d")).alias("total"), F.sum(F.expr("n * d * d")).alias("squares"))

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("top")
        at = partition(*(g[c].to_numpy(np.float64) for c in ("top", "count", "total", "squares")), classes)
        return pd.DataFrame({"k": g["k"].iloc[:1], "breaks": [g["top"].to_numpy()[at].tolist()], "bins": [len(g)]})

    return cells.groupBy("k").applyInPandas(cut, f"k {cells.schema['k'].dataType.simpleString()}, breaks array<double>, bins int").withColumnRenamed("k", key)


RETURNS = "SELECT entity_id, date, region, ret, avg(ret) OVER (PARTITION BY region, date) AS mean FROM (SELECT x.entity_id, x.date, p.region, RAT(close, lag(close) OVER (PARTITION BY x.entity_id ORDER BY x.date)) - 1 AS ret FROM {px} x JOIN {peers} p ON p.entity_id = x.entity_id) a"


@query(
    "scal35_kendall_tau",
    """WITH r AS (SELECT x.entity_id, x.date, region, close / lag(close) OVER (PARTITION BY x.entity_id ORDER BY x.date) - 1 AS ret FROM px x JOIN peers p ON p.entity_id = x.entity_id), m AS MATERIALIZED (SELECT entity_id, round(ret, 3) AS x, round(avg(ret) OVER (PARTITION BY region, date), 3) AS y FROM r WHERE ret IS NOT NULL),
    c AS (SELECT a.entity_id, sum(CASE WHEN (a.x < b.x AND a.y < b.y) THEN 1 ELSE 0 END) AS concordant, sum(CASE WHEN a.x < b.x AND a.y > b.y THEN 1 ELSE 0 END) AS discordant, sum(CASE WHEN a.x < b.x THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN a.y < b.y THEN 1 ELSE 0 END) AS ny FROM m a JOIN m b ON a.entity_id = b.entity_id GROUP BY 1)
    SELECT entity_id, CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, round((concordant - discordant) / sqrt(CAST(nx AS DOUBLE) * ny) + 1e-9, 6) AS tau FROM c""",
)
def scal35(spark, sf_dir):
    """An entity's return and its region's, to a tenth of a percent."""
    rows = select(f"SELECT entity_id, round(ret, 3) AS x, round(mean, 3) AS y FROM ({RETURNS}) b WHERE ret IS NOT NULL", spark, sf_dir)
    return kendall(rows, "entity_id", "x", "y").select("entity_id", "concordant", "discordant", rounded(F.col("tau")).alias("tau"))


@query("top11_natural_breaks")
def top11(spark, sf_dir):
    """Five classes of each region's daily returns."""
    step = F.col("close") / F.lag("close").over(ordered()) - 1
    rows = prices(spark, sf_dir).select("entity_id", step.alias("ret")).join(peers(spark, sf_dir).select("entity_id", "region"), "entity_id")
    found = natural_breaks(rows, "region", "ret")
    return found.select("region", "bins", F.transform("breaks", lambda b: F.round(b + 1e-9, 6)).alias("breaks"))
