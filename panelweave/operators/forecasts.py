"""Forecasts of each entity's close and their evaluation.

Predictions of a day use only earlier days; all fits are window or grouped
expressions, so nothing loops over models or days.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded
from panelweave.plans.views import peers, prices
from panelweave.registry import query

HORIZONS = (1, 5, 21, 63, 252)
#: An interval of this coverage; scores of so many last days; at least so many of them.
COVERAGE_TENTHS, CALIBRATION, LEAST = 9, 500, 20
Z_90 = 1.645
STEPS = "s AS (SELECT *, close - lag(close) OVER w AS step, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY entity_id) AS n FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date))"


def steps(spark, sf_dir):
    """Closes with their change, their place from the start and from the end, and their number."""
    every = Window.partitionBy("entity_id")
    step, back = F.col("close") - F.lag("close").over(ordered()), F.row_number().over(every.orderBy(F.desc("date")))
    return prices(spark, sf_dir).select("entity_id", "date", "close", step.alias("step"), back.alias("back"), (F.row_number().over(ordered()) - 1).alias("t"), F.count("*").over(every).alias("n"))


@query(
    "fc06_walk_forward",
    """WITH h AS (SELECT entity_id, date, close, row_number() OVER w - 1 AS t, lag(close) OVER w AS before, avg(close) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS mean FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
    f AS (SELECT *, CASE WHEN t >= 5 THEN regr_intercept(close, t) OVER p + regr_slope(close, t) OVER p * t ELSE before END AS trend FROM h WINDOW p AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT entity_id, date, close, unnest(['last_value', 'mean_reversion', 'linear_trend']) AS model, unnest([before, before + 0.1 * (mean - before), trend]) AS predicted FROM f WHERE before IS NOT NULL)
    SELECT entity_id, date, model, round(predicted + 1e-9, 4) AS predicted, round(close - predicted + 1e-9, 4) AS error FROM l""",
)
def walk_forward(spark, sf_dir):
    """Each day's close by three models from the days before; a trend needs five days and else repeats the last value."""
    w, before = ordered(), F.col("before")
    past, last63 = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-63, -1)
    h = prices(spark, sf_dir).select("entity_id", "date", "close", (F.row_number().over(w) - 1).alias("t"), F.lag("close").over(w).alias("before"), F.avg("close").over(last63).alias("mean"))
    trend = F.when(F.col("t") >= 5, F.regr_intercept("close", "t").over(past) + F.regr_slope("close", "t").over(past) * F.col("t")).otherwise(before)
    models = h.withColumn("linear_trend", trend).where("before is not null").withColumns({"last_value": before, "mean_reversion": before + 0.1 * (F.col("mean") - before)})
    long = models.unpivot(["entity_id", "date", "close"], ["last_value", "mean_reversion", "linear_trend"], "model", "predicted")
    return long.select("entity_id", "date", "model", rounded(F.col("predicted"), 4).alias("predicted"), rounded(F.col("close") - F.col("predicted"), 4).alias("error"))


@query(
    "fc01_baseline",
    f"""WITH {STEPS} SELECT entity_id, round(CASE WHEN max(n) >= 3 THEN sum(close * CASE WHEN back = n THEN pow(10.0 / 11, n - 1) ELSE 1.0 / 11 * pow(10.0 / 11, back - 1) END) * 1.0
    ELSE max(close) FILTER (back = 1) END + 1e-9, 4) AS ema, round(max(close) FILTER (back = 1) + 1e-9, 4) AS last FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n, CAST(back AS DOUBLE) AS back) FROM s) GROUP BY 1""",
)
def baseline(spark, sf_dir):
    """Level of an exponential mean of span 21 as a weighted sum, so that no history is gathered into an array; and the last value."""
    df, keep = steps(spark, sf_dir), 10 / 11
    weight = F.when(F.col("back") == F.col("n"), F.pow(F.lit(keep), F.col("n") - 1)).otherwise(1 / 11 * F.pow(F.lit(keep), F.col("back") - 1))
    last = F.max(F.when(F.col("back") == 1, F.col("close")))
    return df.groupBy("entity_id").agg(rounded(F.when(F.max("n") >= 3, F.sum(F.col("close") * weight)).otherwise(last), 4).alias("ema"), rounded(last, 4).alias("last"))


@query(
    "fc07_autoregression",
    """WITH p AS (SELECT entity_id, date, close, lag(close) OVER (PARTITION BY entity_id ORDER BY date) AS before FROM px),
    f AS (SELECT entity_id, regr_slope(close, before) AS phi, regr_intercept(close, before) AS c, last(close ORDER BY date) AS x FROM p GROUP BY 1 HAVING count(*) >= 10)
    SELECT entity_id, round(phi + 1e-9, 4) AS phi, round(CASE WHEN abs(phi - 1) < 1e-9 THEN x + 5 * c ELSE pow(phi, 5) * x + c * (1 - pow(phi, 5)) / (1 - phi) END + 1e-9, 4) AS forecast_5d FROM f""",
)
def autoregression(spark, sf_dir):
    """A first-order autoregression and its forecast five days ahead, of entities with ten days or more."""
    p = prices(spark, sf_dir).withColumn("before", F.lag("close").over(ordered()))
    f = p.groupBy("entity_id").agg(F.regr_slope("close", "before").alias("phi"), F.regr_intercept("close", "before").alias("c"), F.max_by("close", "date").alias("x"), F.count("*").alias("n")).where("n >= 10")
    phi, c, x = F.col("phi"), F.col("c"), F.col("x")
    ahead = F.when(F.abs(phi - 1) < 1e-9, x + 5 * c).otherwise(F.pow(phi, 5) * x + c * (1 - F.pow(phi, 5)) / (1 - phi))
    return f.select("entity_id", rounded(phi, 4).alias("phi"), rounded(ahead, 4).alias("forecast_5d"))


@query(
    "fc08_fast_ensemble",
    f"""WITH {STEPS}, l AS (SELECT entity_id, max(close) FILTER (back = 1) AS x, avg(close) FILTER (back <= 21) AS mean, max(close) FILTER (back = 5) AS fifth FROM s WHERE n >= 10 GROUP BY 1),
    h AS (SELECT *, unnest([1, 5, 21, 63, 252]) AS horizon FROM l) SELECT entity_id, horizon, round((x + mean + x + (x - fifth) / 5 * horizon) / 3 + 1e-9, 4) AS forecast FROM h""",
)
def fast_ensemble(spark, sf_dir):
    """The mean of last value, mean of 21 days and recent drift at each horizon; the smoothing member is fc01's and not averaged in here."""
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    l = steps(spark, sf_dir).where("n >= 10").groupBy("entity_id").agg(at(1).alias("x"), F.avg(F.when(F.col("back") <= 21, F.col("close"))).alias("mean"), at(5).alias("fifth"))
    h = l.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    x = F.col("x")
    return h.select("entity_id", "horizon", rounded((x + F.col("mean") + x + (x - F.col("fifth")) / 5 * F.col("horizon")) / 3, 4).alias("forecast"))


HOLDOUT = f"{STEPS}, b AS (SELECT *, n * 85 // 100 AS cut, max(close) FILTER (t = n * 85 // 100 - 1) OVER (PARTITION BY entity_id) AS predicted FROM s WHERE n > 10), e AS (SELECT entity_id, avg(abs(close - predicted)) AS mae, sqrt(avg((close - predicted) ^ 2)) AS rmse, count(*) AS n_test FROM b WHERE t >= cut GROUP BY 1)"


def holdout(spark, sf_dir):
    df = steps(spark, sf_dir).where("n > 10").withColumn("cut", F.expr("n * 85 div 100"))
    miss = F.col("close") - F.col("predicted")
    df = df.withColumn("predicted", F.max(F.when(F.col("t") == F.col("cut") - 1, F.col("close"))).over(Window.partitionBy("entity_id")))
    return df.where("t >= cut").groupBy("entity_id").agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.count("*").alias("n_test"))


@query("fc16_holdout_errors", f"WITH {HOLDOUT} SELECT entity_id, round(mae + 1e-9, 4) AS mae, round(rmse + 1e-9, 4) AS rmse, n_test FROM e")
def holdout_errors(spark, sf_dir):
    """Errors of the last value before the last 15 % of days over those days."""
    return holdout(spark, sf_dir).select("entity_id", rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("rmse"), 4).alias("rmse"), "n_test")


@query(
    "fc33_conformal_intervals",
    f"""WITH {STEPS}, q AS (SELECT entity_id, abs(step) AS score, row_number() OVER (PARTITION BY entity_id ORDER BY abs(step)) AS place, count(*) OVER (PARTITION BY entity_id) AS m FROM s WHERE step IS NOT NULL AND back <= {CALIBRATION}),
    w AS (SELECT entity_id, max(score) AS width FROM q WHERE m >= {LEAST} AND place = least(({COVERAGE_TENTHS} * (m + 1) + 9) // 10 + 1, m) GROUP BY 1),
    l AS (SELECT s.entity_id, s.close AS point, w.width, unnest([1, 5, 21, 63, 252]) AS horizon FROM s LEFT JOIN w USING (entity_id) WHERE back = 1)
    SELECT entity_id, horizon, round(point - coalesce(width * sqrt(horizon), abs(point) * 0.1) + 1e-9, 4) AS lower_ci, round(point + coalesce(width * sqrt(horizon), abs(point) * 0.1) + 1e-9, 4) AS upper_ci FROM l""",
)
def conformal_intervals(spark, sf_dir):
    """The finite-sample quantile of the last value's errors, widened by the root of the horizon; a tenth of the point where there are under 20 errors."""
    s = steps(spark, sf_dir)
    every = Window.partitionBy("entity_id")
    scores = s.where(F.col("step").isNotNull() & (F.col("back") <= CALIBRATION)).select("entity_id", F.abs("step").alias("score"))
    scores = scores.withColumns({"place": F.row_number().over(every.orderBy("score")), "m": F.count("*").over(every)})
    place = F.expr(f"least(({COVERAGE_TENTHS} * (m + 1) + 9) div 10 + 1, m)")
    width = scores.where((F.col("m") >= LEAST) & (F.col("place") == place)).select("entity_id", F.col("score").alias("width"))
    l = s.where("back = 1").join(width, "entity_id", "left").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    half = F.coalesce(F.col("width") * F.sqrt("horizon"), F.abs("close") * 0.1)
    return l.select("entity_id", "horizon", rounded(F.col("close") - half, 4).alias("lower_ci"), rounded(F.col("close") + half, 4).alias("upper_ci"))


@query(
    "fc39_fallback_width",
    f"""WITH {STEPS} SELECT entity_id, round(CASE WHEN count(step) >= 10 THEN greatest(1.35 * (quantile_cont(abs(step), 0.75) - quantile_cont(abs(step), 0.25)), abs(max(close) FILTER (back = 1)) * 0.001) ELSE abs(max(close) FILTER (back = 1)) * 0.1 END + 1e-9, 4) AS width FROM s GROUP BY 1""",
)
def fallback_width(spark, sf_dir):
    """Half width from the quartiles of absolute errors; a tenth of the last value where there are under ten."""
    point = F.abs(F.max(F.when(F.col("back") == 1, F.col("close"))))
    spread = F.percentile(F.abs("step"), F.lit(0.75)) - F.percentile(F.abs("step"), F.lit(0.25))
    width = F.when(F.count("step") >= 10, F.greatest(1.35 * spread, point * 0.001)).otherwise(point * 0.1)
    return steps(spark, sf_dir).groupBy("entity_id").agg(rounded(width, 4).alias("width"))


@query(
    "fc40_bands_and_confidence",
    f"""WITH {HOLDOUT}, m AS (SELECT nation, median(rmse) AS reference FROM e JOIN peers USING (entity_id) GROUP BY 1),
    l AS (SELECT s.entity_id, s.close AS point, e.rmse, m.reference, unnest([1, 5, 21, 63, 252]) AS horizon FROM s JOIN e USING (entity_id) JOIN peers p USING (entity_id) JOIN m USING (nation) WHERE back = 1),
    k AS (SELECT *, CASE WHEN rmse < 1e-10 THEN abs(point) * 0.1 ELSE {Z_90} * rmse * sqrt(horizon) END AS half FROM l),
    c AS (SELECT *, sqrt(CASE WHEN reference <= 1e-10 THEN 0.5 ELSE exp(-rmse / reference) END) AS confidence FROM k)
    SELECT entity_id, horizon, round(point - half + 1e-9, 4) AS lower_ci, round(point + half + 1e-9, 4) AS upper_ci, CAST(2 * half > 2 * abs(point) AS INTEGER) AS rejected,
    round(confidence * CASE WHEN 2 * half > 2 * abs(point) THEN 0.3 ELSE 1 END + 1e-9, 4) AS confidence, round(CASE WHEN point > 0 AND half > 0 THEN 1 / (1 + 2 * half / point / (0.04 * sqrt(horizon))) ELSE 0.5 END + 1e-9, 4) AS band_confidence FROM c""",
)
def bands_and_confidence(spark, sf_dir):
    """Bands of root-time errors, confidence against the nation's median error, and the rejection of bands wider than twice the forecast."""
    e = holdout(spark, sf_dir).join(peers(spark, sf_dir).select("entity_id", "nation"), "entity_id")
    reference = e.groupBy("nation").agg(F.median("rmse").alias("reference"))
    last = steps(spark, sf_dir).where("back = 1").select("entity_id", F.col("close").alias("point"))
    l = last.join(e, "entity_id").join(reference, "nation").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    point, root = F.col("point"), F.sqrt("horizon")
    l = l.withColumn("half", F.when(F.col("rmse") < 1e-10, F.abs(point) * 0.1).otherwise(Z_90 * F.col("rmse") * root))
    wide = 2 * F.col("half") > 2 * F.abs(point)
    confidence = F.sqrt(F.when(F.col("reference") <= 1e-10, 0.5).otherwise(F.exp(-F.col("rmse") / F.col("reference")))) * F.when(wide, 0.3).otherwise(1.0)
    by_band = F.when((point > 0) & (F.col("half") > 0), 1 / (1 + 2 * F.col("half") / point / (0.04 * root))).otherwise(0.5)
    return l.select("entity_id", "horizon", rounded(point - F.col("half"), 4).alias("lower_ci"), rounded(point + F.col("half"), 4).alias("upper_ci"), wide.cast("int").alias("rejected"), rounded(confidence, 4).alias("confidence"), rounded(by_band, 4).alias("band_confidence"))


VARIABLES, LAGS = ("close", "volume", "spread"), (1, 2, 3)
PAIRS = [(a, b) for a in VARIABLES for b in VARIABLES if a != b]
LAGGED = ", ".join(f"lag({v}, {k}) OVER w AS {v}_{k}" for v in VARIABLES for k in LAGS)
CORRELATED = ", ".join(f"abs(corr({b}, {a}_{k})) AS {a}_{b}_{k}" for a, b in PAIRS for k in LAGS)
STRONGEST = " UNION ALL ".join(f"SELECT entity_id, n, '{a}' AS source, '{b}' AS target, greatest({', '.join(f'coalesce({a}_{b}_{k}, 0)' for k in LAGS)}) AS r FROM c" for a, b in PAIRS)


@query(
    "fc23_lagged_causality",
    f"""WITH v AS (SELECT entity_id, date, close, volume, high - low AS spread FROM px), l AS (SELECT *, {LAGGED} FROM v WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
    c AS (SELECT entity_id, count(*) AS n, {CORRELATED} FROM l GROUP BY 1 HAVING count(*) >= 30), r AS ({STRONGEST}), t AS (SELECT *, r * sqrt(n - 2) / sqrt(1 - r * r + 1e-10) AS t FROM r),
    p AS (SELECT *, 2 * (1 - least(0.9999, t / (t + 1))) AS p FROM t) SELECT entity_id, source, target, round(r + 1e-9, 4) AS correlation, round(p + 1e-9, 4) AS pseudo_p, CAST(p < 0.05 AND r > 0.1 AS INTEGER) AS edge FROM p""",
)
def lagged_causality(spark, sf_dir):
    """The strongest lagged correlation of each ordered pair of variables, its pseudo p-value and whether that makes an edge; all pairs in one grouped pass."""
    v = prices(spark, sf_dir).select("entity_id", "date", "close", "volume", (F.col("high") - F.col("low")).alias("spread"))
    l = v.select("*", *[F.lag(x, k).over(ordered()).alias(f"{x}_{k}") for x in VARIABLES for k in LAGS])
    strongest = [F.greatest(*[F.coalesce(F.abs(F.corr(b, f"{a}_{k}")), F.lit(0.0)) for k in LAGS]).alias(f"{a}>{b}") for a, b in PAIRS]
    c = l.groupBy("entity_id").agg(F.count("*").alias("n"), *strongest).where("n >= 30")
    r = c.unpivot(["entity_id", "n"], [f"`{a}>{b}`" for a, b in PAIRS], "pair", "r").withColumn("pair", F.split("pair", ">"))
    r = r.withColumn("t", F.col("r") * F.sqrt(F.col("n") - 2) / F.sqrt(1 - F.col("r") * F.col("r") + 1e-10))
    p = 2 * (1 - F.least(F.lit(0.9999), F.col("t") / (F.col("t") + 1)))
    return r.select("entity_id", F.col("pair")[0].alias("source"), F.col("pair")[1].alias("target"), rounded(F.col("r"), 4).alias("correlation"), rounded(p, 4).alias("pseudo_p"), ((p < 0.05) & (F.col("r") > 0.1)).cast("int").alias("edge"))


@query(
    "fc73_trend_and_regime",
    f"""WITH {STEPS}, d AS (SELECT *, close / max(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS drawdown FROM s),
    a AS (SELECT entity_id, max(n) AS n, avg(close) FILTER (t < n // 3) AS early, avg(close) FILTER (back <= (n + 2) // 3) AS late, max(close) FILTER (back = 1) / max(close) FILTER (t = 0) - 1 AS total, min(drawdown) AS worst, min(close) AS lowest, max(close) AS highest FROM d GROUP BY 1)
    SELECT entity_id, CASE WHEN n >= 3 AND late > early * 1.05 THEN 'up' WHEN n >= 3 AND late < early * 0.95 THEN 'down' ELSE 'flat' END AS trend,
    CASE WHEN n < 5 THEN 'unknown' WHEN total > 0.3 AND worst > -0.2 THEN 'bull' WHEN total < -0.2 THEN 'bear' WHEN total > 0 AND worst < -0.3 THEN 'recovery' ELSE 'sideways' END AS regime,
    round(CASE WHEN n >= 3 THEN lowest END + 1e-9, 4) AS lower_bound, round(CASE WHEN n >= 3 THEN highest END + 1e-9, 4) AS upper_bound FROM a""",
)
def trend_and_regime(spark, sf_dir):
    """First against last third of days, return against worst drawdown, and the range that forecasts stay in."""
    d = steps(spark, sf_dir).withColumn("drawdown", F.col("close") / F.max("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    some = lambda agg, cond: agg(F.when(F.expr(cond), F.col("close")))
    a = d.groupBy("entity_id").agg(F.max("n").alias("n"), some(F.avg, "t < n div 3").alias("early"), some(F.avg, "back <= (n + 2) div 3").alias("late"), (some(F.max, "back = 1") / some(F.max, "t = 0") - 1).alias("total"), F.min("drawdown").alias("worst"), F.min("close").alias("lowest"), F.max("close").alias("highest"))
    trend = F.when((F.col("n") >= 3) & (F.col("late") > F.col("early") * 1.05), "up").when((F.col("n") >= 3) & (F.col("late") < F.col("early") * 0.95), "down").otherwise("flat")
    total, worst, enough = F.col("total"), F.col("worst"), F.col("n") >= 3
    regime = F.when(F.col("n") < 5, "unknown").when((total > 0.3) & (worst > -0.2), "bull").when(total < -0.2, "bear").when((total > 0) & (worst < -0.3), "recovery").otherwise("sideways")
    return a.select("entity_id", trend.alias("trend"), regime.alias("regime"), rounded(F.when(enough, F.col("lowest")), 4).alias("lower_bound"), rounded(F.when(enough, F.col("highest")), 4).alias("upper_bound"))


@query(
    "fc38_rolling_coverage",
    """WITH s AS (SELECT entity_id, date, abs(close - lag(close) OVER (PARTITION BY entity_id ORDER BY date)) AS score FROM px),
    q AS (SELECT *, quantile_cont(score, 0.9) OVER p AS width, count(score) OVER p AS m FROM s WINDOW p AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))
    SELECT entity_id, date, round(width + 1e-9, 4) AS width, CAST(score <= width AS INTEGER) AS covered FROM q WHERE m >= 20""",
)
def rolling_coverage(spark, sf_dir):
    """Each day's interval from the 63 days before it, and whether it held."""
    w = ordered()
    s = prices(spark, sf_dir).select("entity_id", "date", F.abs(F.col("close") - F.lag("close").over(w)).alias("score"))
    past = w.rowsBetween(-63, -1)
    q = s.select("*", F.percentile("score", F.lit(0.9)).over(past).alias("width"), F.count("score").over(past).alias("m")).where("m >= 20")
    return q.select("entity_id", "date", rounded(F.col("width"), 4).alias("width"), (F.col("score") <= F.col("width")).cast("int").alias("covered"))
