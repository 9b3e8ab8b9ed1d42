"""Errors of simple one-day forecasts, and the weights, spreads and choices made from them.

Three forecasts of each close use earlier days only: the last close, the mean
of 63 closes and the last close plus the mean change of 21 days. The mode says
whether the last close lay above that mean.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded
from panelweave.plans.views import prices
from panelweave.registry import query

MODELS = ("last_value", "mean", "drift")
ERRORS = """h AS (SELECT entity_id, date, close, lag(close) OVER w AS last_value, avg(close) OVER m AS mean, lag(close) OVER w + (lag(close) OVER w - lag(close, 22) OVER w) / 21 AS drift, CASE WHEN lag(close) OVER w > avg(close) OVER m THEN 'up' ELSE 'down' END AS mode
 FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date), m AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
 e AS (SELECT entity_id, date, mode, model, predicted, predicted - close AS error FROM h UNPIVOT (predicted FOR model IN (last_value, mean, drift)))"""


def errors(spark, sf_dir):
    """One row per entity, day and model that has a forecast."""
    w, last = ordered(), F.lag("close").over(ordered())
    mean = F.avg("close").over(w.rowsBetween(-63, -1))
    h = prices(spark, sf_dir).select("entity_id", "date", "close", last.alias("last_value"), mean.alias("mean"), (last + (last - F.lag("close", 22).over(w)) / 21).alias("drift"), F.when(last > mean, "up").otherwise("down").alias("mode"))
    e = h.unpivot(["entity_id", "date", "close", "mode"], list(MODELS), "model", "predicted").where("predicted is not null")
    return e.select("entity_id", "date", "mode", "model", "predicted", (F.col("predicted") - F.col("close")).alias("error"))


RMSE_SQL = "sqrt(avg(error * error))"


def rmse():
    return F.sqrt(F.avg(F.col("error") * F.col("error")))


@query("agg22_error_leaderboard", f"WITH {ERRORS}, g AS (SELECT mode, model, count(*) AS n, avg(abs(error)) AS mae, {RMSE_SQL} AS rmse FROM e GROUP BY 1, 2) SELECT mode, model, n, round(mae + 1e-9, 4) AS mae, round(rmse + 1e-9, 4) AS rmse, row_number() OVER (PARTITION BY mode ORDER BY mae, model) = 1 AS best FROM g")
def agg22(spark, sf_dir):
    g = errors(spark, sf_dir).groupBy("mode", "model").agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), rmse().alias("rmse"))
    best = F.row_number().over(Window.partitionBy("mode").orderBy("mae", "model")) == 1
    return g.select("mode", "model", "n", rounded(F.col("mae"), 4).alias("mae"), rounded(F.col("rmse"), 4).alias("rmse"), best.alias("best"))


@query("agg24_mode_weights", f"WITH {ERRORS}, g AS (SELECT mode, model, 1 / {RMSE_SQL} AS x FROM e GROUP BY 1, 2) SELECT mode, model, round(x / sum(x) OVER (PARTITION BY mode) + 1e-9, 6) AS weight FROM g")
def agg24(spark, sf_dir):
    g = errors(spark, sf_dir).groupBy("mode", "model").agg((1 / rmse()).alias("x"))
    return g.select("mode", "model", rounded(F.col("x") / F.sum("x").over(Window.partitionBy("mode"))).alias("weight"))


@query("agg25_confidence_set", f"WITH {ERRORS}, g AS (SELECT entity_id, mode, model, avg(error * error) AS loss FROM e GROUP BY 1, 2, 3) SELECT entity_id, mode, model, round(loss + 1e-9, 4) AS loss FROM g QUALIFY loss <= 1.2 * min(loss) OVER (PARTITION BY entity_id, mode)")
def agg25(spark, sf_dir, slack: float = 1.2):
    """Models whose mean squared error is at most ``slack`` times the least of entity and mode."""
    g = errors(spark, sf_dir).groupBy("entity_id", "mode", "model").agg(F.avg(F.col("error") * F.col("error")).alias("loss"))
    g = g.withColumn("least", F.min("loss").over(Window.partitionBy("entity_id", "mode"))).where(F.col("loss") <= slack * F.col("least"))
    return g.select("entity_id", "mode", "model", rounded(F.col("loss"), 4).alias("loss"))


def weights(e):
    g = e.groupBy("entity_id", "model").agg((1 / rmse()).alias("x"))
    return g.select("entity_id", "model", (F.col("x") / F.sum("x").over(Window.partitionBy("entity_id"))).alias("weight"))


WEIGHTS = f"{ERRORS}, g AS (SELECT entity_id, model, 1 / {RMSE_SQL} AS x FROM e GROUP BY 1, 2), k AS (SELECT entity_id, model, x / sum(x) OVER (PARTITION BY entity_id) AS weight FROM g)"


@query("agg26_inverse_rmse_weights", f"WITH {WEIGHTS} SELECT entity_id, model, round(weight + 1e-9, 6) AS weight FROM k")
def agg26(spark, sf_dir):
    return weights(errors(spark, sf_dir)).select("entity_id", "model", rounded(F.col("weight")).alias("weight"))


@query("agg27_model_spread", f"WITH {WEIGHTS}, m AS (SELECT entity_id, date, weight, predicted, sum(weight * predicted) OVER d / sum(weight) OVER d AS point FROM e JOIN k USING (entity_id, model) WINDOW d AS (PARTITION BY entity_id, date)) SELECT entity_id, date, round(avg(point) + 1e-9, 4) AS point, round(sqrt(sum(weight * power(predicted - point, 2)) / sum(weight)) + 1e-9, 4) AS spread FROM m GROUP BY 1, 2")
def agg27(spark, sf_dir):
    """Weighted mean of the forecasts of a day and its between-model spread."""
    e, day = errors(spark, sf_dir), Window.partitionBy("entity_id", "date")
    point = F.sum(F.col("weight") * F.col("predicted")).over(day) / F.sum("weight").over(day)
    m = e.join(weights(e), ["entity_id", "model"]).withColumn("point", point)
    square = F.sum(F.col("weight") * F.pow(F.col("predicted") - F.col("point"), 2)) / F.sum("weight")
    return m.groupBy("entity_id", "date").agg(rounded(F.avg("point"), 4).alias("point"), rounded(F.sqrt(square), 4).alias("spread"))


@query("agg29_recent_rmse", f"WITH {ERRORS}, b AS (SELECT *, row_number() OVER (PARTITION BY entity_id, model ORDER BY date DESC) - 1 AS back FROM e) SELECT entity_id, model, round(sqrt(sum(exp(-back / 10.0) * error * error) / sum(exp(-back / 10.0))) + 1e-9, 4) AS rmse FROM b WHERE back < 30 GROUP BY 1, 2")
def agg29(spark, sf_dir, errors_used: int = 30, decay: float = 10.0):
    back = F.row_number().over(Window.partitionBy("entity_id", "model").orderBy(F.desc("date"))) - 1
    b = errors(spark, sf_dir).withColumn("back", back).where(F.col("back") < errors_used)
    weight = F.exp(-F.col("back") / decay)
    return b.groupBy("entity_id", "model").agg(rounded(F.sqrt(F.sum(weight * F.col("error") * F.col("error")) / F.sum(weight)), 4).alias("rmse"))


@query("agg65_disagreement_band", f"WITH {ERRORS} SELECT entity_id, date, round(greatest(1.35 * (quantile_cont(predicted, 0.75) - quantile_cont(predicted, 0.25)) * 1.645 / 2, 0.001 * abs(avg(predicted))) + 1e-9, 4) AS half_width FROM e GROUP BY 1, 2")
def agg65(spark, sf_dir):
    """Half-width of an interval from the quartiles of the models, at least a thousandth of their mean."""
    iqr = F.percentile("predicted", F.lit(0.75)) - F.percentile("predicted", F.lit(0.25))
    return errors(spark, sf_dir).groupBy("entity_id", "date").agg(rounded(F.greatest(1.35 * iqr * 1.645 / 2, 0.001 * F.abs(F.avg("predicted"))), 4).alias("half_width"))


@query("agg66_inverse_variance", f"WITH {ERRORS}, g AS (SELECT entity_id, model, 1 / var_samp(error) AS x FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entity_id, model ORDER BY date DESC) <= 60) GROUP BY 1, 2) SELECT entity_id, model, round(x / sum(x) OVER (PARTITION BY entity_id) + 1e-9, 6) AS weight FROM g")
def agg66(spark, sf_dir, errors_used: int = 60):
    b = errors(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "model").orderBy(F.desc("date")))).where(F.col("n") <= errors_used)
    g = b.groupBy("entity_id", "model").agg((1 / F.nullif(F.var_samp("error"), F.lit(0.0))).alias("x"))
    return g.select("entity_id", "model", rounded(F.col("x") / F.sum("x").over(Window.partitionBy("entity_id"))).alias("weight"))


@query("agg36_effective_sample", f"WITH {ERRORS}, b AS (SELECT *, exp(-(row_number() OVER (PARTITION BY entity_id, model ORDER BY date DESC) - 1) / 63.0) AS w FROM e) SELECT entity_id, model, count(*) AS n, round(sum(w) * sum(w) / sum(w * w) + 1e-9, 4) AS effective FROM b GROUP BY 1, 2")
def agg36(spark, sf_dir):
    """Errors weighted by recency count for fewer: the square of the sum over the sum of squares."""
    back = F.row_number().over(Window.partitionBy("entity_id", "model").orderBy(F.desc("date"))) - 1
    b = errors(spark, sf_dir).withColumn("w", F.exp(-back / 63.0))
    return b.groupBy("entity_id", "model").agg(F.count("*").alias("n"), rounded(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 4).alias("effective"))


@query("win77_training_weights", f"WITH {ERRORS}, d AS (SELECT entity_id, date, mode, row_number() OVER l - 1 AS back, first_value(mode) OVER l AS now FROM h WINDOW l AS (PARTITION BY entity_id ORDER BY date DESC)) SELECT entity_id, date, round(exp(-ln(2) * back / 126.0) * CASE WHEN mode = now THEN 1.5 ELSE 1 END + 1e-9, 6) AS weight FROM d")
def win77(spark, sf_dir, half_life: float = 126.0, boost: float = 1.5):
    """Weights that halve every ``half_life`` days, more for days in the mode of the last one."""
    w, last = ordered(), F.lag("close").over(ordered())
    h = prices(spark, sf_dir).select("entity_id", "date", F.when(last > F.avg("close").over(w.rowsBetween(-63, -1)), "up").otherwise("down").alias("mode"))
    newest = Window.partitionBy("entity_id").orderBy(F.desc("date"))
    weight = F.exp(-F.ln(F.lit(2.0)) * (F.row_number().over(newest) - 1) / half_life) * F.when(F.col("mode") == F.first("mode").over(newest), boost).otherwise(1.0)
    return h.select("entity_id", "date", rounded(weight).alias("weight"))
