"""Imputation by chained regressions, low-rank completion and a correction for selection.

All three fit small matrices of sums over the rows. A pass over the table gives
one such matrix for each task, the driver solves it, and a row's estimate is a
function of the row and the solution, so nothing grows with the rows but the
scan. Observed values are never changed: estimates stand in columns beside them.
Null and non-finite numbers are missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from math import erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from panelweave.core import rounded, ship
from panelweave.registry import query
from panelweave.scans import numbers
from panelweave.sources.files import scratch
from panelweave.sqlops import frame

ROUNDS, TOLERANCE, RIDGE = 10, 1e-6, 1e-6
RANK, LOW_RANK_ROUNDS, SHRINK = 4, 100, 0.1
#: Observations and selection columns that the selection model needs, its rounds, the share of rows a feature must have, and how many features.
LEAST_OBSERVED, LEAST_SELECTION, PROBIT_ROUNDS, COVERAGE, FEATURES = 15, 3, 50, 0.6, 10
PROBABILITY_BOUND = 3.090232306167813  # where the normal distribution reaches 0.001 and 0.999


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    x = numbers(batch, columns)
    return np.where(np.isfinite(x), x, np.nan)


def _sums(batches: Iterator[pa.RecordBatch], columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size)
    for batch in batches:
        if batch.num_rows:
            total += of(_values(batch, columns)).reshape(-1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])


def totals(df: DataFrame, columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over batches of rows of ``of``, which makes an array of ``shape`` from a matrix of ``columns``."""
    size, out = int(np.prod(shape)), np.zeros(int(np.prod(shape)))
    rows = df.select(*columns).mapInArrow(partial(_sums, columns=columns, of=of, size=size), "at int, v double")
    for r in rows.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def _extended(batches: Iterator[pa.RecordBatch], columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray], names: Sequence[str], kept: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = of(_values(batch, columns)) if batch.num_rows else np.zeros((0, len(names)))
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *[pa.array(made[:, k], pa.float64(), from_pandas=True) for k in range(len(names))]], names=[*kept, *names])


def extended(df: DataFrame, columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray], names: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The ``kept`` columns of ``df`` and new ones ``names``, which ``of`` makes from a matrix of ``columns``."""
    schema = StructType([df.schema[c] for c in kept])
    for n in names:
        schema = schema.add(n, DoubleType())
    return df.mapInArrow(partial(_extended, columns=columns, of=of, names=names, kept=kept), schema)


def _moments(x: np.ndarray) -> np.ndarray:
    seen = ~np.isnan(x)
    return np.stack((seen.sum(0), np.where(seen, x, 0).sum(0)))


def _squares(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return (np.where(np.isnan(x), 0, x - mean) ** 2).sum(0)


def scale(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observations, means and deviations of columns; constant ones have deviation 1."""
    n, total = totals(df, columns, _moments, (2, len(columns)))
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(totals(df, columns, partial(_squares, mean=mean), (len(columns),)) / np.maximum(n - 1, 1))
    return n, mean, np.where(spread < 1e-10, 1.0, spread)


def carried(df: DataFrame, features: Sequence[str], entity: str, order: str) -> tuple[DataFrame, list[str]]:
    """``df`` with each feature's last value of the entity, in new columns."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    prefix = "_feature_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    names = [f"{prefix}{k}" for k in range(len(features))]
    return df.select("*", *[F.last(F.when(~F.isnan(F.col(f).cast("double")), F.col(f)), ignorenulls=True).over(w).cast("double").alias(n) for f, n in zip(features, names)]), names


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, read once and kept in the shared folder, since every round reads it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Chained regressions


def replay(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, steps: Sequence[np.ndarray]) -> np.ndarray:
    """Standardised rows with holes filled as the rounds so far have filled them: by the mean, then by each round's regressions in turn."""
    z = (x - mean) / spread
    hole = np.isnan(z)
    y = np.where(hole, 0, z)
    for weights in steps:
        for j in range(len(weights)):
            y[:, j] = np.where(hole[:, j], weights[j, 0] + y @ weights[j, 1:], y[:, j])
    return y


def _grams(x: np.ndarray, targets: int, **fit) -> np.ndarray:
    """For each target the products of the filled columns and 1 over the rows that have it."""
    y = np.column_stack((np.ones(len(x)), replay(x, **fit)))
    return np.stack([y[seen].T @ y[seen] for seen in (~np.isnan(x[:, :targets])).T])


def regressions(grams: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Each target's weights: a constant, then one for each column, its own 0."""
    out = np.zeros((len(grams), grams.shape[1]))
    for j, g in enumerate(grams):
        if g[0, 0] < 2:
            continue
        at = np.flatnonzero(np.arange(len(g)) != j + 1)
        keep = g[np.ix_(at, at)] + np.diag(np.where(at > 0, ridge * g[0, 0], 0))
        out[j, at] = np.linalg.solve(keep, g[at, j + 1])
    return out


def _chained(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, steps: Sequence[np.ndarray], confidence: np.ndarray) -> np.ndarray:
    k = len(confidence)
    made = (replay(x, mean, spread, steps) * spread + mean)[:, :k]
    hole = np.isnan(x[:, :k])
    return np.stack((np.where(hole, made, np.nan), np.where(hole, confidence, np.nan)), 2).reshape(len(x), 2 * k)


def _named(variables: Sequence[str]) -> list[str]:
    return [f"{v}_{s}" for v in variables for s in ("estimated", "confidence")]


def chained(df: DataFrame, variables: Sequence[str], features: Sequence[str], entity: str, order: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with an estimate and its confidence for each hole of ``variables``; null where a value is observed.

    In a round each variable is regressed on all other columns as filled so far,
    over the rows that have it, from one pass of sums; holes then take the
    regressions in turn. No round writes a table: a row's fill is replayed from
    the weights of the rounds before. It ends when no weight moves by
    ``tolerance``. Features are carried forward within the entity, what is still
    missing takes the mean, and they aren't estimated. A variable with fewer than two values has
    no estimates. Confidence is 0.4 plus half the observed share, 0.85 at most.
    """
    ship(df.sparkSession)
    kept = df.columns
    rows, extra = carried(df, features, entity, order)
    rows = written(rows, "chained")
    columns, k = [*variables, *extra], len(variables)
    n, mean, spread = scale(rows, columns)
    steps: list[np.ndarray] = []
    while len(steps) < rounds:
        grams = totals(rows, columns, partial(_grams, targets=k, mean=mean, spread=spread, steps=steps), (k, len(columns) + 1, len(columns) + 1))
        steps = [*steps, regressions(grams)]
        if len(steps) > 1 and np.abs(steps[-1] - steps[-2]).max(initial=0) < tolerance:
            break
    return extended(rows, columns, partial(_answer, known=n[:k] >= 2, fit=partial(_chained, mean=mean, spread=spread, steps=steps, confidence=np.minimum(0.85, 0.4 + 0.5 * n[:k] / max(rows.count(), 1)))), _named(variables), kept)


def _answer(x: np.ndarray, known: np.ndarray, fit: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The fit's columns, null for variables that nothing is known of."""
    return np.where(np.repeat(known, 2), fit(x), np.nan)


# Low-rank completion


def _loadings(z: np.ndarray, factors: np.ndarray, penalty: float) -> np.ndarray:
    """Each row's weights on the factors, from the values it has."""
    seen = (~np.isnan(z)).astype(float)
    left = np.einsum("np,pr,ps->nrs", seen, factors, factors) + penalty * np.eye(factors.shape[1])
    return np.linalg.solve(left, (np.where(np.isnan(z), 0, z) @ factors)[..., None])[..., 0]


def _factor_sums(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, factors: np.ndarray, penalty: float) -> np.ndarray:
    """For each column the products of the row weights over the rows that have it, and theirs with its values."""
    z = (x - mean) / spread
    u, seen = _loadings(z, factors, penalty), (~np.isnan(z)).astype(float)
    return np.concatenate((np.einsum("np,nr,ns->prs", seen, u, u), np.einsum("np,nr->pr", np.where(np.isnan(z), 0, z), u)[..., None]), 2)


def _products(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.nan_to_num((x - mean) / spread)
    return z.T @ z


def _misses(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, factors: np.ndarray, penalty: float) -> np.ndarray:
    z = (x - mean) / spread
    return np.abs(np.nan_to_num(_loadings(z, factors, penalty) @ factors.T - z)).sum(0)


def _completed(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, factors: np.ndarray, penalty: float, confidence: np.ndarray) -> np.ndarray:
    k, hole = len(confidence), np.isnan(x)[:, : len(confidence)]
    made = (_loadings((x - mean) / spread, factors, penalty) @ factors.T * spread + mean)[:, :k]
    return np.stack((np.where(hole, made, np.nan), np.where(hole, confidence, np.nan)), 2).reshape(len(x), 2 * k)


def low_rank(df: DataFrame, variables: Sequence[str], features: Sequence[str], entity: str, order: str, rank: int = RANK, rounds: int = LOW_RANK_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """As ``chained``, from the matrix of low nuclear norm that is nearest to the observed values.

    The penalty is a tenth of the largest singular value of the standardised
    matrix with holes at 0. Alternating least squares finds that matrix where
    ``rank`` is at least its rank: a row's weights follow from the factors and
    its own values within a task, so a round is one pass that sums a few
    numbers a column. It ends when no factor moves by ``tolerance`` of the
    largest. Confidence is 1 less twice the mean error on observed values over
    their range, between 0.1 and 0.9, and 0.3 with five values or fewer; unlike
    in a completion that puts observed values back first, the error is that of the fit.
    """
    ship(df.sparkSession)
    kept = df.columns
    rows, extra = carried(df, features, entity, order)
    rows = written(rows, "low-rank")
    columns, k = [*variables, *extra], len(variables)
    n, mean, spread = scale(rows, columns)
    fixed = {"mean": mean, "spread": spread}
    value, vector = np.linalg.eigh(totals(rows, columns, partial(_products, **fixed), (len(columns), len(columns))))
    strong = np.sqrt(np.maximum(value[::-1], 0))[: min(rank, len(columns))]
    penalty = max(SHRINK * strong[0], 1e-12)
    factors = vector[:, ::-1][:, : len(strong)] * np.sqrt(np.maximum(strong - penalty, 0.01 * max(strong[0], 1e-12)))
    for _ in range(rounds):
        sums = totals(rows, columns, partial(_factor_sums, **fixed, factors=factors, penalty=penalty), (len(columns), len(strong), len(strong) + 1))
        new = np.linalg.solve(sums[..., :-1] + penalty * np.eye(len(strong)), sums[..., -1:])[..., 0]
        moved, factors = np.abs(new - factors).max(), new
        if moved <= tolerance * np.abs(factors).max():
            break
    fixed |= {"factors": factors, "penalty": penalty}
    miss = totals(rows, columns, partial(_misses, **fixed), (len(columns),)) / np.maximum(n, 1) * spread
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in (F.col(v).cast("double") for v in variables)]
    ends = rows.agg(*[F.max(c) - F.min(c) for c in finite]).first()
    span = np.array([r if r is not None and r >= 1e-10 else 1.0 for r in ends])
    confidence = np.where(n[:k] > 5, np.clip(1 - 2 * miss[:k] / span, 0.1, 0.9), 0.3)
    return extended(rows, columns, partial(_answer, known=n[:k] >= 2, fit=partial(_completed, **fixed, confidence=confidence)), _named(variables), kept)


# Correction for selection


def normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Density and distribution of the standard normal at ``x``, held within 6 deviations; a series whose terms don't change sign."""
    x = np.clip(x, -6, 6)
    density, a = np.exp(-x * x / 2) / np.sqrt(2 * np.pi), np.abs(x)
    term, total = a.copy(), a.copy()
    for k in range(1, 90):
        term = term * a * a / (2 * k + 1)
        total += term
    upper = np.maximum(0.5 - density * total, 0)
    return density, np.where(x < 0, upper, 1 - upper)


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Missing entries count as 0, as columns of a selection do."""
    return np.column_stack((np.ones(len(x)), (np.nan_to_num(x) - mean) / spread))


def _filled_moments(x: np.ndarray) -> np.ndarray:
    return np.stack((np.full(x.shape[1], len(x)), np.nan_to_num(x).sum(0), (~np.isnan(x)).sum(0)))


def _filled_squares(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return ((np.nan_to_num(x) - mean) ** 2).sum(0)


def _probit(x: np.ndarray, weights: np.ndarray, **of) -> np.ndarray:
    """Information, score and rows told right of a probit of whether the first column is there, by the others."""
    d, seen = _design(x[:, 1:], **of), ~np.isnan(x[:, 0])
    f, p = normal(d @ weights)
    below = np.maximum(p * (1 - p), 1e-18)
    return np.column_stack(((d * (f * f / below)[:, None]).T @ d, d.T @ (f * (seen - p) / below), np.full(d.shape[1], ((p > 0.5) == seen).sum())))


def mills(x: np.ndarray, weights: np.ndarray, **of) -> tuple[np.ndarray, np.ndarray]:
    """Inverse Mills ratios of each row's chance of having a value, held within 0.001 and 0.999: were it to have one, and were it not to."""
    f, p = normal(np.clip(_design(x, **of) @ weights, -PROBABILITY_BOUND, PROBABILITY_BOUND))
    return f / p, -f / (1 - p)


def _second(x: np.ndarray, chosen: int, select: dict, regress: dict, level: float, spread: float, as_missing: bool = False) -> np.ndarray:
    """Columns of the second stage, and the scaled value last, of rows that are target, features, selection columns."""
    d = _design(x[:, 1 : 1 + chosen], **regress)
    return np.column_stack((d, mills(x[:, 1 + chosen :], **select)[as_missing], (x[:, 0] - level) / spread))


def _second_sums(x: np.ndarray, **of) -> np.ndarray:
    d = _second(x[~np.isnan(x[:, 0])], **of)
    return d.T @ d


def _corrected(x: np.ndarray, weights: np.ndarray, confidence: float, **of) -> np.ndarray:
    hole = np.isnan(x[:, 0])
    made = _second(x, **of)[:, :-1] @ weights * of["spread"] + of["level"]
    return np.column_stack((np.where(hole, made, np.nan), np.where(hole, confidence, np.nan)))


def tail(t: float, dof: float) -> float:
    """How likely Student's t is at least so far from 0."""
    if dof > 5000:
        return erfc(abs(t) / 2**0.5)
    angle = np.linspace(0, np.pi / 2, 200_001)
    mass = np.cos(angle) ** (dof - 1)
    area = np.append(0.0, np.cumsum((mass[1:] + mass[:-1]) / 2))
    return float(1 - np.interp(np.arctan(abs(t) / dof**0.5), angle, area) / area[-1])


def filled_scale(df: DataFrame, columns: Sequence[str]) -> tuple[dict, np.ndarray]:
    """Means and deviations of columns whose holes count as 0, and the share of rows that have each."""
    n, total, seen = totals(df, columns, _filled_moments, (3, len(columns)))
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(totals(df, columns, partial(_filled_squares, mean=mean), (len(columns),)) / np.maximum(n, 1))
    return {"mean": mean, "spread": np.where(spread < 1e-10, 1.0, spread)}, seen / np.maximum(n, 1)


def selection_columns(df: DataFrame, variable: str, sizes: Sequence[str], fields: Sequence[str], entity: str, order: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that tell whether ``variable`` is reported: sizes carried forward, the share of the last four rows that had it, how complete
    the row is in ``fields`` (the variable itself aside, which would give the answer away), and how far on the row is in its entity's history."""
    w = Window.partitionBy(entity).orderBy(order)
    there = lambda c: (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double")
    others = [f for f in fields if f != variable]
    rate = F.avg(there(variable)).over(w.rowsBetween(-4, -1))
    full: Column = sum((there(f) for f in others), F.lit(0.0)) / max(len(others), 1)
    trend = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(entity))
    sizes = [s for s in sizes if s != variable]
    made = {**{f"_size_{k}": F.last(s, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double") for k, s in enumerate(sizes)}, "_rate": rate, "_full": full, "_trend": trend}
    if not others:
        del made["_full"]
    return df.select("*", *[c.alias(n) for n, c in made.items()]), list(made)


def selection_corrected(df: DataFrame, variable: str, features: Sequence[str], selection: Sequence[str], entity: str, order: str, as_missing: bool = False) -> DataFrame:
    """``df`` with an estimate and its confidence for each hole of ``variable``, from rows that have it, corrected for which rows those are.

    A probit by Fisher scoring (a pass a round) tells from the ``selection``
    columns of ``df`` which rows have a value; its inverse Mills ratio joins the
    features, carried forward and then 0, in a regression over the rows that
    have one. Features that over 40 % of the rows lack are left out, and of the
    others the first ten are used. Estimates are null with fewer than 15 values,
    without a hole, a usable feature or three selection columns, or where the
    probit has no finite fit. Confidence is 0.3 plus a fifth of the share of rows
    that the probit tells right, a fifth of the regression's R squared and 0.1 where the
    ratio's coefficient is significant at a tenth, 0.8 at most. Estimates take the ratio of
    rows that have a value; with ``as_missing`` that of rows that lack one, which is nearer the
    truth where the same unseen cause drives value and reporting.
    """
    ship(df.sparkSession)
    kept, names = df.columns, [f"{variable}_estimated", f"{variable}_confidence"]
    rows, extra = carried(df, features, entity, order)
    rows = written(rows, "selection")
    none = rows.select(*kept, *[F.lit(None).cast("double").alias(n) for n in names])
    count, (seen, *_) = rows.count(), totals(rows, [variable], _moments, (2, 1))[0]
    if seen < LEAST_OBSERVED or seen == count or len(selection) < LEAST_SELECTION:
        return none
    of, have = filled_scale(rows, extra) if extra else ({}, np.zeros(0))
    used = np.flatnonzero(have > COVERAGE)[:FEATURES]
    if not len(used):
        return none
    chosen, regress = [extra[k] for k in used], {key: v[used] for key, v in of.items()}
    select, _ = filled_scale(rows, selection)
    weights, size = np.zeros(len(selection) + 1), len(selection) + 1
    for _ in range(PROBIT_ROUNDS):
        sums = totals(rows, [variable, *selection], partial(_probit, weights=weights, **select), (size, size + 2))
        step = np.linalg.pinv(sums[:, :size], rcond=1e-10, hermitian=True) @ sums[:, size]
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    if not np.abs(step).max() < 1e-4:
        return none  # chances of 0 and 1, which no finite weights give
    right = totals(rows, [variable, *selection], partial(_probit, weights=weights, **select), (size, size + 2))[0, -1] / count
    _, level, spread = scale(rows, [variable])
    second = {"chosen": len(chosen), "select": {"weights": weights, **select}, "regress": regress, "level": float(level[0]), "spread": float(spread[0])}
    columns = [variable, *chosen, *selection]
    g = totals(rows, columns, partial(_second_sums, **second), (len(chosen) + 3, len(chosen) + 3))
    inverse = np.linalg.pinv(g[:-1, :-1], rcond=1e-12, hermitian=True)
    beta = inverse @ g[:-1, -1]
    left, total = max(g[-1, -1] - beta @ g[:-1, -1], 0.0), g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    dof = seen - np.linalg.matrix_rank(g[:-1, :-1], hermitian=True)
    error = (inverse[-1, -1] * left / dof) ** 0.5 if dof > 0 else 0.0
    sure = dof > 0 and (tail(beta[-1] / error, dof) < 0.1 if error > 0 else True)
    confidence = min(0.8, 0.3 + 0.2 * right + 0.2 * (max(0.0, 1 - left / total) if total > 0 else 0.0) + 0.1 * sure)
    return extended(rows, columns, partial(_corrected, weights=beta, confidence=float(confidence), as_missing=as_missing, **second), names, kept)


HELD, ALWAYS = ("revenue", "cost_of_revenue", "gross_profit", "total_assets", "total_liabilities", "total_equity", "capex"), ("operating_cash_flow",)


def _query(name: str, of: Callable[[DataFrame], DataFrame], variables: Sequence[str]) -> None:
    def run(spark, sf_dir):
        found = of(frame("fin_gaps", spark, sf_dir))
        return found.select("entity_id", "report_date", *variables, *[rounded(F.col(c), 2 if c.endswith("estimated") else 5).alias(c) for c in _named(variables)])

    query(name)(run)


_query("dq24_chained_imputation", lambda df: chained(df, HELD, ALWAYS, "entity_id", "report_date"), HELD)
_query("dq25_low_rank_imputation", lambda df: low_rank(df, HELD, ALWAYS, "entity_id", "report_date"), HELD)


def corrected_revenue(df: DataFrame) -> DataFrame:
    rows, selection = selection_columns(df, "revenue", ("total_assets", "revenue"), (*HELD, *ALWAYS), "entity_id", "report_date")
    return selection_corrected(rows, "revenue", [*[h for h in HELD if h != "revenue"], *ALWAYS], selection, "entity_id", "report_date")


_query("dq27_selection_corrected", corrected_revenue, ("revenue",))
