"""Regimes by a Gaussian mixture of each entity's returns, and breaks of their mean."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, ship
from panelweave.plans.views import prices
from panelweave.registry import query
from panelweave.sources.files import scratch, written

COMPONENTS, LEAST, MOST, ROUNDS, TOLERANCE, FLOOR = 3, 50, 1 << 18, 100, 1e-3, 1e-6
#: Rows on either side of a break, and the distance of their means in standard errors that makes one.
SIDE, LEVEL = 21, 3.0


def with_shares(df: DataFrame, x: str, k: int) -> DataFrame:
    """``share``, the probability of each component, and ``likelihood``, the row's log density. As SQL text, which the driver builds quickly in every round."""
    logs = ", ".join(f"ln(weight[{j}]) - 0.5D * (ln(2D * pi() * variance[{j}]) + pow({x} - mean[{j}], 2) / variance[{j}])" for j in range(k))
    rows = df.selectExpr("*", f"array({logs}) AS _log").selectExpr("*", "array_max(_log) AS _top").selectExpr("*", "transform(_log, v -> exp(v - _top)) AS _raw")
    return rows.selectExpr("*", "aggregate(_raw, 0D, (a, v) -> a + v) AS _sum").selectExpr("*", "transform(_raw, v -> v / _sum) AS share", "_top + ln(_sum) AS likelihood").drop("_log", "_top", "_raw", "_sum")


def _start(k: int) -> list[float]:
    """Where the means begin, in deviations from the key's mean."""
    return [0.0] if k == 1 else [2.0 * j / (k - 1) - 1 for j in range(k)]


def _fitted(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``rounds`` rounds over one key's values: weights, means, variances and each round's mean log likelihood."""
    n, v = len(x), x.var()
    weight, mean, variance, said = np.full(k, 1 / k), x.mean() + np.sqrt(v) * np.array(_start(k)), np.full(k, v), np.empty(rounds)
    for number in range(rounds):
        gap = x - mean[:, None]
        square = gap * gap
        logs = square * (-0.5 / variance)[:, None] + (np.log(weight) - 0.5 * np.log(2 * np.pi * variance))[:, None]
        top = logs.max(0)
        share = np.exp(np.subtract(logs, top, out=logs), out=logs)
        total = share.sum(0)
        said[number] = (top.sum() + np.log(total).sum()) / n
        share /= total
        size = share.sum(1)
        held = np.maximum(size, 1e-300)
        step = np.einsum("ij,ij->i", share, gap) / held
        weight, mean, variance = np.maximum(size / n, 1e-300), mean + step, np.maximum(np.einsum("ij,ij->i", share, square) / held - step * step, FLOOR * v)
    return weight, mean, variance, said


def _whole(rows: DataFrame, k: int, rounds: int, least: int) -> DataFrame:
    """The rounds of keys whose values fit in a task, one group a key; ``said`` has every round's likelihood."""
    ship(rows.sparkSession)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = g["x"].to_numpy()
        if len(x) < least or x.min() == x.max() or x.var() == 0:
            return pd.DataFrame({c: [] for c in ("k", "n", "weight", "mean", "variance", "said")}, dtype=object)
        weight, mean, variance, said = _fitted(x, k, rounds)
        return pd.DataFrame({"k": g["of"].iloc[:1], "n": [len(x)], "weight": [weight.tolist()], "mean": [mean.tolist()], "variance": [variance.tolist()], "said": [said.tolist()]})

    return rows.groupBy("of").applyInPandas(fit, f"k {rows.schema['of'].dataType.simpleString()}, n long, weight array<double>, mean array<double>, variance array<double>, said array<double>")


def _rounds(rows: DataFrame, k: int, rounds: int, tolerance: float, least: int, ended: set[int]) -> tuple[DataFrame, int]:
    """The rounds of few keys of any size, each an aggregation, up to the first one in ``ended`` in which these have ended too; and its number."""
    spark, folder, done = rows.sparkSession, scratch(rows.sparkSession, "mixture"), rounds
    start = rows.groupBy(F.col("of").alias("k")).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).where(f"n >= {least} AND v > 0")
    params = start.select("k", "n", F.col("v").alias("all"), F.array(*[F.lit(1.0 / k)] * k).alias("weight"), F.array(*[F.col("m") + s * F.sqrt("v") for s in _start(k)]).alias("mean"), F.array(*[F.col("v")] * k).alias("variance"), F.lit(float("-inf")).alias("likelihood"))
    for number in range(rounds):
        path = f"{folder}/round-{number}"
        params.write.parquet(path)
        params = spark.read.schema(params.schema).parquet(path)
        if number in ended and params.where(f"rise > {tolerance}").isEmpty():
            done = number
            break
        seen = with_shares(rows.join(F.broadcast(params.select("k", "weight", "mean", "variance")), F.col("of").eqNullSafe(F.col("k"))), "x", k)
        # centred on the present means, so that squares keep their digits
        sums = [f"sum({of}) AS {n}{j}" for j in range(k) for n, of in (("n", f"share[{j}]"), ("s", f"share[{j}] * (x - mean[{j}])"), ("q", f"share[{j}] * pow(x - mean[{j}], 2)"))]
        new = seen.groupBy("of").agg(*map(F.expr, ["avg(likelihood) AS now", *sums]))
        each, held = new.join(params, F.col("of").eqNullSafe(F.col("k"))), [f"greatest(n{j}, 1e-300D)" for j in range(k)]
        params = each.selectExpr(
            "k", "n", "all", f"array({', '.join(f'greatest(n{j} / n, 1e-300D)' for j in range(k))}) AS weight", f"array({', '.join(f'mean[{j}] + s{j} / {held[j]}' for j in range(k))}) AS mean",
            f"array({', '.join(f'greatest(q{j} / {held[j]} - pow(s{j} / {held[j]}, 2), {FLOOR}D * all)' for j in range(k))}) AS variance", "now AS likelihood", "now - likelihood AS rise", f"{number + 1} AS rounds",
        )
    return params, done


def mixture(df: DataFrame, key: str, x: str, k: int = COMPONENTS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Per key weights, means (rising) and variances of ``k`` normal components, with the mean log likelihood and the number of rounds.

    Expectation-maximisation from means at -1, 0, 1 deviations (evenly spread
    for other ``k``); it ends for all keys when no mean likelihood rises
    by ``tolerance``. Keys of at most ``most`` values are fitted as a group
    each, all rounds in one job, and once more if the common end comes earlier.
    Of larger keys, of which there are few, a round is one aggregation to
    sufficient statistics, so only those leave a task. Variances are at
    least a millionth of the key's. Nulls, keys of fewer than ``least`` values
    and constant keys are left out.
    """
    spark = df.sparkSession
    rows = written(df.where(F.col(x).isNotNull()).select(F.col(key).alias("of"), F.col(x).cast("double").alias("x")), "mixture")
    large = written(rows.groupBy(F.col("of").alias("k")).agg(F.count("*").alias("n")).where(f"n > {most}").select("k"), "mixture")
    on = F.col("of").eqNullSafe(F.col("k"))
    some = not large.isEmpty()
    small = rows.join(F.broadcast(large), on, "left_anti") if some else rows
    fit = written(_whole(small, k, rounds, least), "mixture")
    # the largest rise of each round after the first; the first has none before it
    told = fit.selectExpr(f"explode(transform(sequence(1, {rounds}), i -> struct(i AS number, CASE WHEN i > 1 THEN said[i - 1] - said[i - 2] END AS rise))) AS r").groupBy("r.number").agg(F.max("r.rise").alias("rise"))
    ended = {r["number"] for r in told.where(f"number > 1 AND rise <= {tolerance}").collect()} if not fit.isEmpty() else set(range(2, rounds + 1))
    if some:
        params, done = _rounds(rows.join(F.broadcast(large), on, "left_semi"), k, rounds, tolerance, least, ended)
    else:
        done = min(ended, default=rounds)
    if done < rounds:
        fit = _whole(small, k, done, least)
    out = fit.select("k", "n", "weight", "mean", "variance", F.element_at("said", -1).alias("likelihood"), F.lit(done).alias("rounds"))
    if some:
        out = out.unionByName(params.select(*out.columns))
    out = out.withColumn("_order", F.array_sort(F.arrays_zip("mean", "variance", "weight")))
    fields = {c: F.expr(f"transform(_order, s -> s.{c})") for c in ("weight", "mean", "variance")}
    return out.select(F.col("k").alias(key), "n", *[v.alias(c) for c, v in fields.items()], "likelihood", "rounds")


def regimes(df: DataFrame, key: str, x: str, k: int = COMPONENTS, rounds: int = ROUNDS) -> DataFrame:
    """Each row's component, 0 the one of the lowest mean, its probability, and those of all components; null where nothing could be fitted."""
    fit = mixture(df, key, x, k, rounds).select(F.col(key).alias("_k"), "weight", "mean", "variance")
    seen = with_shares(df.join(fit, F.col(key).eqNullSafe(F.col("_k")), "left"), x, k)
    best = F.array_max("share")
    return seen.select(*df.columns, (F.array_position("share", best) - 1).cast("int").alias("regime"), best.alias("confidence"), *[F.col("share")[j].alias(f"p{j}") for j in range(k)])


def breaks(df: DataFrame, x: str, side: int = SIDE) -> DataFrame:
    """``break_score``: how many standard errors the mean of the last ``side`` rows lies from that of the rows before them; null until both are full."""
    now, past = ordered().rowsBetween(1 - side, 0), ordered().rowsBetween(1 - 2 * side, -side)
    error = F.sqrt((F.var_samp(x).over(now) + F.var_samp(x).over(past)) / side)
    full = (F.count(x).over(now) == side) & (F.count(x).over(past) == side) & (error > 0)
    return df.withColumn("break_score", F.when(full, F.abs(F.avg(x).over(now) - F.avg(x).over(past)) / error))


def returns(spark, sf_dir) -> DataFrame:
    """Log returns of each entity's close."""
    step = F.log(F.col("close")) - F.log(F.lag("close").over(ordered()))
    return prices(spark, sf_dir).select("entity_id", "date", step.alias("ret"))


@query("fc19_mixture_regimes")
def fc19(spark, sf_dir):
    fit = mixture(returns(spark, sf_dir), "entity_id", "ret")
    return fit.select("entity_id", "n", *[F.transform(c, lambda v: F.round(v, 5)).alias(c) for c in ("weight", "mean", "variance")])


@query("fc77_regimes_and_breaks")
def fc77(spark, sf_dir):
    """Regime, its probabilities, whether it changed, and breaks of the mean, from returns up to the day for breaks and all returns for regimes."""
    rows = breaks(regimes(returns(spark, sf_dir), "entity_id", "ret"), "ret")
    shift = F.coalesce((F.col("regime") != F.lag("regime").over(ordered())).cast("int"), F.lit(0))
    return rows.select("entity_id", "date", "regime", *[rounded(F.col(c), 5).alias(c) for c in ("confidence", "p0", "p1", "p2", "break_score")], shift.alias("regime_shift"), F.coalesce((F.col("break_score") > LEVEL).cast("int"), F.lit(0)).alias("structural_break"))
