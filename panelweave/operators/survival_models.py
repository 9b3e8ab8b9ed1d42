"""Survival models that are fitted, and bootstraps whose draws are hashes, so that every run draws alike."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.core import forward_fill, ordered, rounded, ship
from panelweave.operators.survival import CURRENT_RATIO, DEBT, DEBT_TO_EQUITY, DRAWDOWN, FCF_YIELD, FLAGGED
from panelweave.registry import query
from panelweave.scans import numbers
from panelweave.sources.files import written
from panelweave.sqlops import TEXTS, select

RATIOS = ("cr", "de", "fy", "drawdown")
#: Levels of the triggers and whether distress lies below them.
LEVELS = ((CURRENT_RATIO, True), (DEBT_TO_EQUITY, False), (FCF_YIELD, True), (DRAWDOWN, True))
LEAST_EVENTS, LEAST_ROWS, DRAWS, REPLICATES, FADE, STEP = 5, 50, 100, 500, 0.997, 64
#: Rows of a trailing deviation, and the least values in them.
TRAIL, LEAST_TRAIL = 63, 10


def uniform(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit row seeds and draw numbers, broadcast against each other."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64) + (draw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    return (x.astype(np.float64) + 0.5) / 2.0**53


def normal(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Standard normal numbers, each of two uniform ones."""
    return np.sqrt(-2 * np.log(uniform(seed, 2 * draw))) * np.cos(2 * np.pi * uniform(seed, 2 * draw + 1))


def poisson(seed: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """How often each row is drawn: Poisson numbers of mean 1."""
    steps = np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 16)))
    return np.searchsorted(np.cumsum(steps), uniform(seed, draw))


def _worst(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The worst distance to a trigger, or the mean of the distances, 0 without any ratio.

    The mean is the geometric one of numbers of at least a hundredth, less 1,
    so it exceeds the worst distance only where all lie below -0.99, which it
    then is.
    """
    worst = None
    for x, (level, below) in zip(columns, LEVELS):
        far = np.clip((level - x if below else x - level) / max(abs(level), 0.01), -5, 5)
        worst = far if worst is None else np.fmax(worst, far)
    return np.where(np.isnan(worst), 0.0, np.maximum(worst, -0.99))


def _squashed(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def probability(ratios: np.ndarray) -> np.ndarray:
    """Distress from the last axis of ``RATIOS``: the worst distance to a trigger or their geometric mean, squashed; a half without any ratio."""
    return _squashed(_worst(np.moveaxis(ratios, -1, 0)))


def _percentile(x: np.ndarray, percent: int) -> np.ndarray:
    """Of each row's probabilities, whose order is that of ``x``: only its two neighbours are squashed."""
    at = (x.shape[1] - 1) * (percent / 100)
    low = int(at)
    high = min(low + 1, x.shape[1] - 1)
    x = np.partition(x, (low, high), 1)
    a, b, t = _squashed(x[:, low]), _squashed(x[:, high]), at - low
    return a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t)


def _bands(batches: Iterator[pa.RecordBatch], draws: int, kept: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
        x, scale, seed = numbers(batch, RATIOS), np.nan_to_num(numbers(batch, [f"{r}_scale" for r in RATIOS])), col("seed").to_numpy()
        found = np.empty((2, batch.num_rows))
        for at in range(0, batch.num_rows, STEP):
            part = slice(at, at + STEP)
            moved = (x[part, k, None] + normal(seed[part, None], np.arange(draws) * len(RATIOS) + k) * 0.5 * scale[part, k, None] for k in range(len(RATIOS)))
            worst = _worst(moved)
            found[:, part] = [_percentile(worst, p) for p in (10, 90)]
        yield pa.RecordBatch.from_arrays([*[col(k) for k in kept], *map(pa.array, found)], names=[*kept, "p10", "p90"])


def _deviations(x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """From row ``first`` on, of each column's last ``TRAIL`` rows: how many have a value, and their sample deviation."""
    lead = np.full((max(0, TRAIL - 1 - first), x.shape[1]), np.nan)
    x = np.concatenate((lead, x[max(0, first - TRAIL + 1) :]))
    ok = ~np.isnan(x)
    values, seen = (sliding_window_view(v, TRAIL, 0) for v in (np.where(ok, x, 0), ok))
    n, out = seen.sum(2), np.empty(values.shape[:2])
    for at in range(0, len(values), STEP):
        part = slice(at, at + STEP)
        gap = (values[part] - (values[part].sum(2) / np.maximum(n[part], 1))[:, :, None]) * seen[part]
        out[part] = np.sqrt((gap * gap).sum(2) / np.maximum(n[part] - 1, 1))
    return n, out


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scales of rows that come sorted by key and date: the trailing deviation where enough values are seen, else the one given."""
    now, kept = (), np.zeros((0, len(RATIOS)))
    for batch in batches:
        keys, x, given = batch.column(0).to_pylist(), numbers(batch, RATIOS), numbers(batch, [f"{r}_scale" for r in RATIOS])
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            kept = np.concatenate((kept if (keys[a],) == now else kept[:0], x[a:b]))
            now, first = (keys[a],), len(kept) - (b - a)
            n, deviation = _deviations(kept, first)
            given[a:b] = np.where(n >= LEAST_TRAIL, deviation, given[a:b])
            kept = kept[1 - TRAIL :]
        at = {f"{r}_scale": pa.array(given[:, k]) for k, r in enumerate(RATIOS)}
        yield pa.RecordBatch.from_arrays([at.get(c, v) for c, v in zip(batch.schema.names, batch.columns)], names=batch.schema.names)


def _moved(batches: Iterator[pa.RecordBatch], draws: int) -> Iterator[pa.RecordBatch]:
    return _bands(_scaled(batches), draws, ("entity_id", "date"))


def uncertainty(df: DataFrame, draws: int = DRAWS) -> DataFrame:
    """P10 and P90 of each day's distress probability when its ratios are moved by half their own deviation, ``draws`` times.

    A ratio's deviation is that of its last 63 values, ten at least, else of
    the entity's whole series; a ratio without one stays as it is. With 100
    draws a percentile's standard error is about 1.7 tenths of the deviation
    of the probabilities. Draws follow from the entity and the date alone.
    """
    ship(df.sparkSession)
    every = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order, so that every run adds alike
    scales = {f"{r}_scale": F.stddev_samp(r).over(every) for r in RATIOS}
    rows = df.select("entity_id", "date", *[F.col(r).cast("double").alias(r) for r in RATIOS]).withColumns(scales).withColumn("seed", F.xxhash64("entity_id", "date"))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("entity_id", "date").schema]
    # an entity's rows pass through one task in order, a batch at a time
    found = rows.repartition("entity_id").sortWithinPartitions("entity_id", "date").mapInArrow(partial(_moved, draws=draws), f"{', '.join(keys)}, p10 double, p90 double")
    return found.withColumn("spread", F.col("p90") - F.col("p10"))


def _replicas(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """Per key and batch the weighted sums of every replicate."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys, seed = part.column(0).to_pylist(), part.column(1).to_numpy()
            flag, weight = numbers(part, ("flag", "weight")).T
            drawn = poisson(seed[:, None], np.arange(replicates)[None]) * weight[:, None]
            names = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            code = np.array([names[k] for k in keys])
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
            hit, all_ = (np.add.reduceat(v[order], first, axis=0) for v in (drawn * flag[:, None], drawn))
            yield pa.RecordBatch.from_arrays([pa.array(list(names), part.column(0).type), *[pa.array(list(v), pa.list_(pa.float64())) for v in (hit, all_)]], names=["key", "hit", "drawn"])


def bootstrap(df: DataFrame, key: str, identity: Sequence[str], flag: str, weight: str, replicates: int = REPLICATES) -> DataFrame:
    """Per ``key`` the bootstrapped weighted share of ``flag``: mean, deviation and percentiles over replicates.

    Each row is drawn a Poisson number of times by a hash of ``identity`` and
    the replicate, so rows aren't multiplied: tasks send sums per key and
    replicate. Rows without flag or weight are left out; a replicate that draws
    no weight is, too.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(flag).isNotNull() & F.col(weight).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(*identity).alias("seed"), F.col(flag).cast("double").alias("flag"), F.col(weight).cast("double").alias("weight"))
    sums = rows.mapInArrow(partial(_replicas, replicates=replicates), f"key {rows.schema['key'].dataType.simpleString()}, hit array<double>, drawn array<double>")
    each = sums.select("key", F.posexplode(F.arrays_zip("hit", "drawn")).alias("replicate", "s")).groupBy("key", "replicate").agg(F.sum("s.hit").alias("hit"), F.sum("s.drawn").alias("drawn"))
    share = each.where("drawn > 0").withColumn("share", F.col("hit") / F.col("drawn"))
    points = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return share.groupBy(F.col("key").alias(key)).agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("std"), *[F.percentile("share", p).alias(n) for n, p in points.items()])


def durations(df: DataFrame, flag: str) -> DataFrame:
    """``duration``: rows since the entity's last event or since its start, the row itself counted."""
    events = F.sum(flag).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_run", F.coalesce(events, F.lit(0))).withColumn("duration", F.row_number().over(Window.partitionBy("entity_id", "_run").orderBy("date")).cast("double")).drop("_run")


def moments(df: DataFrame, columns: Sequence[str]) -> list[tuple[float, float]]:
    """Mean and deviation of each column; a constant one has deviation 1."""
    r = df.agg(*[a for c in columns for a in (F.avg(c), F.stddev_pop(c))]).first()
    return [(r[2 * k], r[2 * k + 1] or 1.0) for k in range(len(columns))]


def scaled(columns: Sequence[str], found: Sequence[tuple[float, float]]) -> list[Column]:
    return [((F.col(c) - m) / s).alias(f"_{c}") for c, (m, s) in zip(columns, found)]


def linear(columns: Sequence[str], weights: Sequence[float], found: Sequence[tuple[float, float]], start: float = 0.0) -> Column:
    return sum(((F.col(c) - m) / s * float(w) for c, w, (m, s) in zip(columns, weights, found)), F.lit(float(start)))


def survival_regression(df: DataFrame, covariates: Sequence[str] = RATIOS, flag: str = "flag") -> tuple[DataFrame, dict | None]:
    """``hazard``, the squashed log hazard of a Weibull model of the time to the next event, and the fit.

    Fitted on all entities' complete rows; a row without event is censored. A
    Weibull model is one of proportional hazards as well: the log hazard ratio
    is minus the coefficient over the scale. Missing covariates are carried
    forward, never back; with fewer than 5 events or 50 rows there is no score.
    The frame and its complete rows are written once, since the fit reads them
    many times.
    """
    df = written(df.select("entity_id", "date", *covariates, flag), "survival")
    clean = written(durations(df.dropna(), flag).select(*covariates, flag, "duration"), "durations")
    n, events = clean.agg(F.count("*"), F.sum(flag)).first()
    rows = df.select("entity_id", "date", *[forward_fill(c).alias(c) for c in covariates])
    if n < LEAST_ROWS or (events or 0) < LEAST_EVENTS:
        return rows.select("entity_id", "date", F.lit(None).cast("double").alias("hazard")), None
    found = moments(clean, covariates)
    made = VectorAssembler(inputCols=[f"_{c}" for c in covariates], outputCol="x").transform(clean.select(F.col(flag).cast("double").alias("event"), "duration", *scaled(covariates, found)))
    model = AFTSurvivalRegression(featuresCol="x", labelCol="duration", censorCol="event", maxIter=100, tol=1e-7).fit(made)
    ratios = [-float(b) / model.scale for b in model.coefficients]
    log_hazard = linear(covariates, ratios, found)
    fit = {"log_hazard_ratios": dict(zip(covariates, ratios)), "coefficients": [float(b) for b in model.coefficients], "intercept": float(model.intercept), "scale": float(model.scale), "moments": found, "rows": n, "events": int(events)}
    return rows.select("entity_id", "date", (1 / (1 + F.exp(-log_hazard))).alias("hazard")), fit


def discrete_survival(df: DataFrame, covariates: Sequence[str] = RATIOS[:3], flag: str = "flag") -> tuple[DataFrame, dict | None]:
    """``probability`` of distress in a period: logistic regression on scaled ratios, both classes of equal weight, and the fit.

    Rows missing a ratio aren't fitted on; for the score missing ratios are
    carried forward, else 0. Fewer than two events or four rows give no score.
    The frame is written once, since the fit reads it many times.
    """
    df = written(df.select("entity_id", "date", *covariates, flag), "survival")
    clean = df.select(*covariates, F.col(flag).cast("double").alias("event")).dropna()
    n, events = clean.agg(F.count("*"), F.sum("event")).first()
    rows = df.select("entity_id", "date", *[F.coalesce(forward_fill(c), F.lit(0.0)).alias(c) for c in covariates])
    if n < 4 or (events or 0) < 2 or events == n:
        return rows.select("entity_id", "date", F.lit(None).cast("double").alias("probability")), None
    found = moments(clean, covariates)
    weight = F.when(F.col("event") == 1, n / (2 * events)).otherwise(n / (2 * (n - events)))
    made = VectorAssembler(inputCols=[f"_{c}" for c in covariates], outputCol="x").transform(clean.select("event", weight.alias("weight"), *scaled(covariates, found)))
    model = LogisticRegression(featuresCol="x", labelCol="event", weightCol="weight", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(made)
    weights = [float(w) for w in model.coefficients]
    fit = {"coefficients": weights, "intercept": float(model.intercept), "moments": found, "rows": n, "events": int(events)}
    return rows.select("entity_id", "date", (1 / (1 + F.exp(-linear(covariates, weights, found, model.intercept)))).alias("probability")), fit


def flagged(spark, sf_dir) -> DataFrame:
    """The daily panel's ratios and distress flag."""
    return select(f"WITH {FLAGGED} SELECT entity_id, date, {', '.join(RATIOS)}, company_flag AS flag FROM f", spark, sf_dir)


def flagged_quarters(spark, sf_dir) -> DataFrame:
    """A quarter's ratios and distress flag."""
    text = f"""WITH k AS ({TEXTS["anal01_company_flag_quarterly"]}), m AS (SELECT entity_id, report_date, max_by(market_cap, date) AS market_cap FROM {{day}} WHERE report_date IS NOT NULL GROUP BY entity_id, report_date)
    SELECT f.entity_id, f.report_date AS date, RAT(current_assets, current_liabilities) AS cr, RAT({DEBT}, abs(total_equity)) AS de, RAT(4 * (operating_cash_flow - abs(capex)), m.market_cap) AS fy, k.company_survival_mode_flag AS flag
    FROM {{fin}} f JOIN k ON k.entity_id = f.entity_id AND k.report_date = f.report_date LEFT JOIN m ON m.entity_id = f.entity_id AND m.report_date = f.report_date"""
    return select(text, spark, sf_dir)


@query("anal03_survival_uncertainty")
def anal03(spark, sf_dir):
    found = uncertainty(flagged(spark, sf_dir))
    return found.select("entity_id", "date", *[rounded(F.col(c)).alias(f"survival_{c}") for c in ("p10", "p90", "spread")])


@query("anal04_survival_regression")
def anal04(spark, sf_dir):
    found, _ = survival_regression(flagged(spark, sf_dir))
    return found.select("entity_id", "date", rounded(F.col("hazard")).alias("cox_survival_score"))


@query("anal05_discrete_survival")
def anal05(spark, sf_dir):
    found, _ = discrete_survival(flagged_quarters(spark, sf_dir))
    return found.select("entity_id", F.col("date").alias("report_date"), rounded(F.col("probability")).alias("discrete_survival_score"))


@query("fc61_bootstrap_probability")
def fc61(spark, sf_dir):
    """Share of days without distress, recent days weighing more."""
    age = F.datediff(F.max("date").over(Window.partitionBy("entity_id")), "date")
    rows = flagged(spark, sf_dir).select("entity_id", "date", (1 - F.col("flag")).alias("survived"), F.pow(F.lit(FADE), age).alias("weight"))
    found = bootstrap(rows, "entity_id", ["entity_id", "date"], "survived", "weight")
    return found.select("entity_id", *[rounded(F.col(c)).alias(c) for c in found.columns[1:]])
