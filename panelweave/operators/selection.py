"""Ridge regressions for each key from summed products: stacked forecasts and adjusted residuals; and a greedy choice of features.

Rows are reduced to a few sums a key (and block of dates) before anything is
solved, so a key with many rows costs no task more than its share of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, ship
from panelweave.operators.forecasts import walk_forward
from panelweave.operators.imputation import totals, written
from panelweave.plans.views import prices
from panelweave.registry import query

#: Log entries and complete rows that stacking needs, the ridge, rows and values that an adjustment needs, and its largest share of the forecast.
LEAST_LOG, LEAST_ROWS, ALPHA, LEAST_VALUES, LARGEST = 50, 30, 1.0, 20, 0.05
FOLDS, BINS, CHOSEN = 5, 10, 30


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def products(rows: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Per key ``k`` (and ``by``): ``n``, the key's means ``m``, and sums ``s`` and products ``q`` of the columns less those means. Rows are complete."""
    means = rows.groupBy(F.col("k").alias("_k")).agg(F.array(*[F.avg(c) for c in columns]).alias("m"))
    x = [F.col(c) - F.col("m")[j] for j, c in enumerate(columns)]
    return rows.join(means, same("k", "_k")).groupBy("k", "m", *by).agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("s"), F.array(*[F.sum(a * b) for i, a in enumerate(x) for b in x[i:]]).alias("q"))


def ridge(n: float, s: np.ndarray, q: np.ndarray, m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients of all columns but the last, which is the target, and the constant, which isn't shrunk."""
    p = len(m)
    whole = np.zeros((p, p))
    whole[np.triu_indices(p)] = q
    whole = np.where(np.tri(p, dtype=bool), whole.T, whole) - np.outer(s, s) / n
    weights = np.linalg.solve(whole[:-1, :-1] + alpha * np.eye(p - 1), whole[:-1, -1])
    at = m + s / n
    return weights, float(at[-1] - weights @ at[:-1])


# Stacking


def blocks(rows: DataFrame, folds: int) -> DataFrame:
    """``rows`` with ``fold``: the key's dates cut in ``folds`` ranges of equal length."""
    ends = rows.groupBy(F.col("k").alias("_k")).agg(F.min("day").alias("first"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    number = F.expr(f"CAST(least({folds - 1}, datediff(day, first) * {folds} div (span + 1)) AS INT)")
    return rows.join(ends, same("k", "_k")).withColumn("fold", number).drop("_k", "first", "span")


def _stack(groups: Iterator[pd.DataFrame], folds: int, alpha: float) -> Iterator[pd.DataFrame]:
    for g in groups:
        out = []
        for key, logged, m, parts in zip(g["k"], g["logged"], g["m"], g["parts"]):
            held, m = {r["fold"]: r for r in parts}, np.array(m, float)
            for until in range(1, folds + 1):  # weights for the block ``until``: rows of the blocks before it
                known = [held[f] for f in range(until) if f in held]
                n = sum(r["n"] for r in known)
                if n < LEAST_ROWS or (until == folds and logged < LEAST_LOG):
                    continue
                weights, start = ridge(n, sum(np.array(r["s"], float) for r in known), sum(np.array(r["q"], float) for r in known), m, alpha)
                share = np.maximum(weights, 0)
                out.append((key, until, n, weights.tolist(), start, (share / share.sum()).tolist() if share.sum() > 0 else None))
        yield pd.DataFrame(out, columns=["k", "fold", "n", "coefficients", "intercept", "weights"]).astype({"k": g["k"].dtype})


def stack(df: DataFrame, key: str, date: str, models: Sequence[str], actual: str, folds: int = FOLDS, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """Weights of models for each key by a ridge of the actual values on their forecasts, and forecasts made with them.

    Weights: ``coefficients`` and ``intercept`` of the rows in the blocks of
    dates before ``fold``, and ``weights``, the coefficients that aren't
    negative over their sum (null if all are 0). ``fold`` equal to ``folds`` has all
    rows, if the key has 50; every fit needs 30 rows with the actual value and all
    forecasts. Forecasts: the rows of ``df`` with ``stacked``, from the weights
    of the blocks before the row's own, null where there are none or a forecast is missing; so no
    row's weights know its date or a later one.
    """
    ship(df.sparkSession)
    inputs = [*models, actual]
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).alias("k"), F.to_date(date).alias("day"), *[finite(c).alias(f"_x{j}") for j, c in enumerate(inputs)])
    held, names = blocks(written(rows, "stack"), folds), [f"_x{j}" for j in range(len(inputs))]
    whole = held.dropna(subset=names)
    logged = held.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("logged"))
    sums = products(whole, names, "fold").groupBy("k", "m").agg(F.collect_list(F.struct("fold", "n", "s", "q")).alias("parts"))  # at most ``folds`` of them
    sums = sums.join(logged, same("k", "_k")).drop("_k")
    weights = sums.mapInPandas(partial(_stack, folds=folds, alpha=alpha), f"k {rows.schema['k'].dataType.simpleString()}, fold int, n long, coefficients array<double>, intercept double, weights array<double>")
    weights = written(weights, "stack-weights")
    by = weights.select(F.col("k").alias("_k"), F.col("fold").alias("_fold"), "coefficients", "intercept")
    told = sum((F.col("coefficients")[j] * F.col(n) for j, n in enumerate(names[:-1])), F.col("intercept"))
    out = held.join(by, same("k", "_k") & same("fold", "_fold"), "left").select("row.*", told.alias("stacked"))
    return weights.withColumnRenamed("k", key), out


# Adjusted residuals


def _adjust(groups: Iterator[pd.DataFrame], alpha: float) -> Iterator[pd.DataFrame]:
    for g in groups:
        out = []
        for key, n, m, s, q, latest, forecast in zip(g["k"], g["n"], g["m"], g["s"], g["q"], g["latest"], g["forecast"]):
            move = 0.0
            if n >= LEAST_ROWS:
                weights, start = ridge(n, *(np.array(v, float) for v in (s, q, m)), alpha)
                bound = abs(forecast) * LARGEST if forecast else 1.0
                move = float(np.clip(start + weights @ np.array(latest, float), -bound, bound))
            out.append((key, move))
        yield pd.DataFrame(out, columns=["k", "move"]).astype({"k": g["k"].dtype})


def adjusted(df: DataFrame, key: str, order: str, variable: str, fitted: str, forecast: str, features: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Per key its ``forecast`` (of the last row) and ``adjusted``, which adds what a ridge of the residuals on the features tells from the last row's features.

    Residuals are ``variable`` less ``fitted``, over rows that have it and all features;
    features of 20 values or fewer in the key aren't used. The change is at most
    5 % of the forecast, 1 if that is 0, and 0 with fewer than 30 rows or no
    usable feature; missing features of the last row count as 0.
    """
    ship(df.sparkSession)
    p = len(features)
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("at"), (finite(variable) - finite(fitted)).alias("y"), finite(forecast).alias("forecast"), *[finite(f).alias(f"x{j}") for j, f in enumerate(features)])
    rows = written(rows, "residuals")
    last = rows.groupBy(F.col("k").alias("_k")).agg(F.max_by(F.struct("forecast", *[F.coalesce(f"x{j}", F.lit(0.0)).alias(f"x{j}") for j in range(p)]), "at").alias("l"), *[(F.count(f"x{j}") > LEAST_VALUES).alias(f"u{j}") for j in range(p)])
    use = [F.when(F.col(f"u{j}"), F.col(f"x{j}")).otherwise(0.0).alias(f"z{j}") for j in range(p)]  # a column of zeros has no weight
    any_used = F.expr(" OR ".join(f"u{j}" for j in range(p)) or "false")
    whole = rows.join(last, same("k", "_k")).where(any_used).select("k", *use, "y").dropna(subset=[*[f"z{j}" for j in range(p)], "y"])
    sums = products(whole, [*[f"z{j}" for j in range(p)], "y"])
    known = sums.join(last, same("k", "_k")).select("k", "n", "m", "s", "q", F.array(*[F.when(F.col(f"u{j}"), F.col(f"l.x{j}")).otherwise(0.0) for j in range(p)]).alias("latest"), F.col("l.forecast").alias("forecast")).where("forecast IS NOT NULL")
    moves = known.mapInPandas(partial(_adjust, alpha=alpha), f"k {rows.schema['k'].dataType.simpleString()}, move double")
    out = last.join(moves, same("k", "_k"), "left")
    return out.select(F.col("_k").alias(key), F.col("l.forecast").alias("forecast"), (F.col("l.forecast") + F.coalesce("move", F.lit(0.0))).alias("adjusted"))


# Choice of features


def _shares(x: np.ndarray, edges: Sequence[np.ndarray], mean: np.ndarray) -> np.ndarray:
    """Counts of the cells of each feature with the target, the last column, and products of the columns less ``mean``, of complete rows."""
    x = x[~np.isnan(x).any(1)]
    bins = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)]
    cells = [np.bincount(b * BINS + bins[-1], minlength=BINS * BINS) for b in bins[:-1]]
    d = x - mean
    return np.concatenate((*cells, (d.T @ d).reshape(-1), d.sum(0)))


def information(cells: np.ndarray) -> float:
    """Mutual information of a table of counts, in nats."""
    p = cells / max(cells.sum(), 1)
    apart = p.sum(1, keepdims=True) * p.sum(0)
    return float((p[p > 0] * np.log(p[p > 0] / apart[p > 0])).sum())


def greedy(relevance: np.ndarray, alike: np.ndarray, most: int) -> list[tuple[int, float]]:
    """The most relevant first, then in turn the one whose relevance less its mean likeness to those chosen is highest; the first of equals."""
    out: list[tuple[int, float]] = []
    left = list(range(len(relevance)))
    while left and len(out) < most:
        score = [relevance[i] - (np.mean([alike[i, j] for j, _ in out]) if out else 0.0) for i in left]
        at = int(np.argmax(score))
        out.append((left.pop(at), float(score[at])))
    return out


def choose_features(df: DataFrame, target: str, candidates: Sequence[str], most: int = CHOSEN) -> DataFrame:
    """``place, feature, relevance, score``: features that tell of the target and not of each other.

    Relevance is the mutual information of feature and target over ten bins of
    equally many rows each, likeness the absolute correlation, both over rows complete in
    target and candidates, in one pass of counts and products. Features of ten values or
    fewer are left out; with fewer than two others, or 30 complete rows, they
    are returned in order without a score.
    """
    spark = df.sparkSession
    ship(spark)
    have = df.select(*[finite(c).alias(f"x{j}") for j, c in enumerate([*candidates, target])])
    counts = have.agg(*[F.count(f"x{j}") for j in range(len(candidates))], F.count("*")).first()
    valid = [j for j in range(len(candidates)) if counts[j] > 10]
    schema = "place int, feature string, relevance double, score double"
    plain = [(k + 1, candidates[j], None, None) for k, j in enumerate(valid[:most])]
    if len(valid) < 2:
        return spark.createDataFrame(plain, schema)
    names = [*[f"x{j}" for j in valid], f"x{len(candidates)}"]
    whole = written(have.select(*names).dropna(), "features")
    found = whole.agg(F.count("*").alias("n"), *[F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 100_000) for n in names], *[F.avg(n) for n in names]).first()
    if found["n"] < 30:
        return spark.createDataFrame(plain, schema)
    p, edges, mean = len(valid), [np.array(e) for e in found[1 : len(names) + 1]], np.array(found[len(names) + 1 :])
    made = totals(whole, names, partial(_shares, edges=edges, mean=mean), (p * BINS * BINS + (p + 1) * (p + 2),))
    relevance = np.array([information(c) for c in made[: p * BINS * BINS].reshape(p, BINS, BINS)])
    q, s = made[p * BINS * BINS : -(p + 1)].reshape(p + 1, p + 1), made[-(p + 1) :]
    cov = q - np.outer(s, s) / found["n"]
    with np.errstate(all="ignore"):
        alike = np.nan_to_num(np.abs(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))), posinf=0.0)
    picked = greedy(relevance, alike[:p, :p], most)
    return spark.createDataFrame([(k + 1, candidates[valid[j]], float(relevance[j]), score) for k, (j, score) in enumerate(picked)], schema)


MODELS = ("last_value", "mean_reversion", "linear_trend")


def logged(spark, sf_dir) -> DataFrame:
    """The walk-forward forecasts of a day in one row, and its close."""
    rows = walk_forward(spark, sf_dir)
    return rows.groupBy("entity_id", "date").agg(*[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in MODELS], F.max(F.when(F.col("model") == MODELS[0], F.col("predicted") + F.col("error"))).alias("close"))


@query("fc45_stacking")
def fc45(spark, sf_dir):
    """Weights of each entity's models, of all its rows and of the blocks before each block."""
    weights, _ = stack(logged(spark, sf_dir), "entity_id", "date", MODELS, "close")
    return weights.select("entity_id", "fold", "n", *[rounded(F.col("weights")[j], 5).alias(f"w_{m}") for j, m in enumerate(MODELS)])


@query("fc45_stacked_forecasts")
def fc45_forecasts(spark, sf_dir):
    _, rows = stack(logged(spark, sf_dir), "entity_id", "date", MODELS, "close")
    return rows.select("entity_id", "date", "close", rounded(F.col("stacked"), 3).alias("stacked"))


def features(spark, sf_dir) -> DataFrame:
    w = ordered()
    rows = prices(spark, sf_dir).select("entity_id", "date", "close", F.lag("close").over(w).alias("before"), F.col("volume").cast("double").alias("volume"), (F.col("high") - F.col("low")).alias("spread"), (F.col("close") - F.col("open")).alias("move"))
    ret = F.col("close") / F.col("before") - 1
    return rows.withColumn("ret", ret).withColumns({"ret_1": F.lag("ret", 1).over(w), "ret_2": F.lag("ret", 2).over(w), "ret_5": F.lag("ret", 5).over(w), "range": F.col("spread") / F.col("close")})


@query("fc28_feature_choice")
def fc28(spark, sf_dir):
    """What tells of the next return."""
    rows = features(spark, sf_dir).withColumn("next", F.lead("ret").over(ordered()))
    found = choose_features(rows, "next", ["ret", "ret_1", "ret_2", "ret_5", "volume", "spread", "range", "move", "close"])
    return found.select("place", "feature", *[rounded(F.col(c), 5).alias(c) for c in ("relevance", "score")])


@query("fc14_residual_adjustment")
def fc14(spark, sf_dir):
    """The last close as forecast of the next, adjusted by the day's volume, spread and return."""
    found = adjusted(features(spark, sf_dir), "entity_id", "date", "close", "before", "close", ["volume", "spread", "ret_1"])
    return found.select("entity_id", *[rounded(F.col(c), 4).alias(c) for c in ("forecast", "adjusted")])
