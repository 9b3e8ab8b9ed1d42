"""Filters, smoothing and interval control: recurrences over each entity's days, as scans."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, trailing
from panelweave.functions.protocol import ChangeScore, fold
from panelweave.plans.views import prices
from panelweave.registry import query
from panelweave.scans import Clamped, LocalLevel, Smoothed, scan
from panelweave.sources.files import scratch
from panelweave.streaming.keyed import CHANGE

#: Entities with fewer values aren't fitted; the last hundredths of each series are for testing.
LEAST, TEST_HUNDREDTHS = 30, 15
LEVELS, TRENDS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.1, 0.3)
# fixed values: miss rate, learning rate and bounds of alpha; gains and bound of the integral
ALPHA, RATE, LOW, HIGH = 0.1, 0.05, 0.01, 0.5
KP, KI, KD, WINDUP = 0.05, 0.005, 0.01, 3.0
Z_90, CALIBRATION, LEAST_CHANGES = 1.645, 63, 20


def split(df: DataFrame, value: str = "close") -> DataFrame:
    """Rows with a value of entities that have enough of them: place ``t`` from 1, number ``n`` and the last training place."""
    every = Window.partitionBy("entity_id")
    rows = df.where(F.col(value).isNotNull()).select("entity_id", "date", F.col(value).alias("x"), F.row_number().over(ordered()).alias("t"), F.count("*").over(every).alias("n"))
    return rows.where(F.col("n") >= LEAST).withColumn("trained", F.expr(f"n * {100 - TEST_HUNDREDTHS} div 100"))


def level_filter(df: DataFrame, value: str = "close") -> DataFrame:
    """Each day's forecast, level and variance by a local-level filter.

    The variances of steps and noise follow from the training part's first
    differences: their lag-one covariance is minus the noise, their variance
    the steps plus twice the noise; neither is less than a hundredth of it.
    Series without any change are left out.
    """
    rows = split(df, value)
    step = F.col("x") - F.lag("x").over(ordered())
    moves = rows.where("t <= trained").withColumn("step", step).withColumn("before", F.lag("step").over(ordered()))
    fits = moves.groupBy("entity_id").agg(F.var_pop("step").alias("v"), F.covar_pop("step", "before").alias("c"))
    noise = F.greatest(-F.col("c"), 0.01 * F.col("v"))
    fits = fits.where("v > 0").withColumn("noise", noise).withColumn("steps", F.greatest(F.col("v") - 2 * F.col("noise"), 0.01 * F.col("v")))
    joined = rows.join(fits.select("entity_id", "steps", "noise"), "entity_id")
    return scan(joined, "entity_id", ["date"], ["x", "steps", "noise"], LocalLevel(), scratch(df.sparkSession, "level"))


#: Places of values in SQL, as ``split`` gives them.
SPLIT = "s AS MATERIALIZED (SELECT * FROM (SELECT entity_id, date, close AS x, row_number() OVER (PARTITION BY entity_id ORDER BY date) AS t, count(*) OVER (PARTITION BY entity_id) AS n FROM px) WHERE n >= 30)"


@query(
    "fc09_local_level",
    f"""WITH RECURSIVE {SPLIT}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY entity_id ORDER BY t) AS step FROM s WHERE t <= n * 85 // 100), e AS (SELECT *, lag(step) OVER (PARTITION BY entity_id ORDER BY t) AS before FROM d),
    v AS MATERIALIZED (SELECT entity_id, noise, greatest(v - 2 * noise, 0.01 * v) AS steps FROM (SELECT entity_id, v, greatest(-c, 0.01 * v) AS noise FROM (SELECT entity_id, var_pop(step) AS v, covar_pop(step, before) AS c FROM e GROUP BY 1) WHERE v > 0)),
    f AS MATERIALIZED (SELECT s.entity_id, date, x, t, steps, noise FROM s JOIN v USING (entity_id)),
    r AS (SELECT entity_id, date, t, NULL::DOUBLE AS predicted, x AS level, noise * (noise + steps) / (2 * noise + steps) AS variance FROM f WHERE t = 1
     UNION ALL SELECT n.entity_id, n.date, n.t, b.level, b.level + (b.variance + n.steps) / (b.variance + n.steps + n.noise) * (n.x - b.level), n.noise * (b.variance + n.steps) / (b.variance + n.steps + n.noise) FROM r b JOIN (SELECT * FROM f) n ON n.entity_id = b.entity_id AND n.t = b.t + 1)
    SELECT entity_id, date, round(predicted + 1e-9, 3) AS predicted, round(level + 1e-9, 3) AS level, round(variance + 1e-9, 2) AS variance FROM r""",
)
def fc09(spark, sf_dir):
    found = level_filter(prices(spark, sf_dir))
    return found.select("entity_id", "date", rounded(F.col("predicted"), 3).alias("predicted"), rounded(F.col("level"), 3).alias("level"), rounded(F.col("variance"), 2).alias("variance"))


def smoothing(df: DataFrame, value: str = "close", levels=LEVELS, trends=TRENDS) -> DataFrame:
    """Per entity the pair of smoothing weights with the least squared error on the training part, its error on the rest, and the next forecast.

    All pairs run in one scan; ties go to the smaller level weight, then the smaller trend weight.
    """
    family = Smoothed(levels, trends)
    found = scan(split(df, value), "entity_id", ["date"], ["x"], family, scratch(df.sparkSession, "smoothed"))
    n = len(family.grid)
    error = [F.pow(F.col("x") - F.col(f"before_{k}"), F.lit(2)) for k in range(n)]
    sums = [a for k in range(n) for a in (F.avg(F.when(F.col("t") <= F.col("trained"), error[k])).alias(f"train_{k}"), F.avg(F.when(F.col("t") > F.col("trained"), error[k])).alias(f"test_{k}"), F.max_by(f"after_{k}", "t").alias(f"next_{k}"))]
    wide = found.groupBy("entity_id").agg(F.max("n").alias("n"), *sums)
    each = F.array(*[F.struct(F.round(F.col(f"train_{k}"), 6).alias("train"), F.lit(a).alias("level_weight"), F.lit(b).alias("trend_weight"), F.sqrt(f"test_{k}").alias("test_rmse"), F.col(f"next_{k}").alias("forecast")) for k, (a, b) in enumerate(family.grid)])
    return wide.select("entity_id", "n", F.array_min(each).alias("best")).select("entity_id", "n", "best.level_weight", "best.trend_weight", F.sqrt("best.train").alias("train_rmse"), "best.test_rmse", "best.forecast")


@query(
    "fc10_exponential_smoothing",
    f"""WITH RECURSIVE {SPLIT}, g AS (SELECT a, b FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS a), (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS b)),
    r AS (SELECT entity_id, t, a, b, x, x AS level, 0.0::DOUBLE AS trend, NULL::DOUBLE AS predicted, n FROM s, g WHERE t = 1
     UNION ALL SELECT entity_id, t, a, b, x, l, b * (l - level) + (1 - b) * trend, level + trend, n FROM (SELECT n.entity_id, n.t, p.a, p.b, n.x, n.n, p.level, p.trend, p.a * n.x + (1 - p.a) * (p.level + p.trend) AS l FROM r p JOIN (SELECT * FROM s) n ON n.entity_id = p.entity_id AND n.t = p.t + 1)),
    e AS (SELECT entity_id, a, b, max(n) AS n, round(avg((x - predicted) * (x - predicted)) FILTER (t <= n * 85 // 100), 6) AS train, avg((x - predicted) * (x - predicted)) FILTER (t > n * 85 // 100) AS test, arg_max(level + trend, t) AS forecast FROM r GROUP BY 1, 2, 3)
    SELECT entity_id, n, a AS level_weight, b AS trend_weight, round(sqrt(train) + 1e-9, 4) AS train_rmse, round(sqrt(test) + 1e-9, 4) AS test_rmse, round(forecast + 1e-9, 4) AS forecast FROM e QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY train, a, b) = 1""",
)
def fc10(spark, sf_dir):
    found = smoothing(prices(spark, sf_dir))
    return found.select("entity_id", "n", "level_weight", "trend_weight", *[rounded(F.col(c), 4).alias(c) for c in ("train_rmse", "test_rmse", "forecast")])


def adaptive_alpha(df: DataFrame, covered: str = "covered") -> DataFrame:
    """``alpha`` after each day: up a little where the interval held, down where it didn't, within its bounds; days without an interval change nothing."""
    moved = df.withColumn("moved", RATE * (ALPHA - (1 - F.col(covered))))
    return scan(moved, "entity_id", ["date"], ["moved"], Clamped(ALPHA, LOW, HIGH), scratch(df.sparkSession, "alpha")).withColumnRenamed("state", "alpha").drop("moved", "place")


def pid_alpha(df: DataFrame, covered: str = "covered") -> DataFrame:
    """``integral`` and ``alpha`` after each day with an interval, by the error of the miss rate, its sum and its change: two scans, as the sum is clipped first."""
    rows = df.where(F.col(covered).isNotNull()).withColumn("error", 1 - F.col(covered) - F.lit(ALPHA))
    rows = rows.withColumn("change", F.col("error") - F.lag("error", 1, 0.0).over(ordered()))
    summed = scan(rows, "entity_id", ["date"], ["error"], Clamped(0.0, -WINDUP, WINDUP), scratch(df.sparkSession, "integral")).withColumnRenamed("state", "integral").drop("place")
    moved = summed.withColumn("moved", KP * F.col("error") + KI * F.col("integral") + KD * F.col("change"))
    return scan(moved, "entity_id", ["date"], ["moved"], Clamped(ALPHA, LOW, HIGH), scratch(df.sparkSession, "pid")).withColumnRenamed("state", "alpha").drop("moved", "place", "error", "change")


def naive_coverage(df: DataFrame) -> DataFrame:
    """Whether each close lay within 1.645 deviations of the earlier changes round the last close; null before 20 changes."""
    change = F.col("close") - F.lag("close").over(ordered())
    past = trailing(CALIBRATION).rowsBetween(-CALIBRATION, -1)
    moves = df.select("entity_id", "date", change.alias("change"))
    width = F.when(F.count("change").over(past) >= LEAST_CHANGES, Z_90 * F.stddev_samp("change").over(past))
    return moves.select("entity_id", "date", (F.abs("change") <= F.round(width, 6)).cast("double").alias("covered"))


COVERED = """c AS MATERIALIZED (SELECT entity_id, date, row_number() OVER (PARTITION BY entity_id ORDER BY date) AS t, CAST(abs(change) <= round(CASE WHEN count(change) OVER w >= 20 THEN 1.645 * stddev_samp(change) OVER w END, 6) AS INT) AS covered
 FROM (SELECT entity_id, date, close - lag(close) OVER (PARTITION BY entity_id ORDER BY date) AS change FROM px) WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING))"""


@query(
    "fc36_adaptive_alpha",
    f"""WITH RECURSIVE {COVERED}, r AS (SELECT entity_id, date, t, covered, 0.1::DOUBLE AS alpha FROM c WHERE t = 1
     UNION ALL SELECT n.entity_id, n.date, n.t, n.covered, CASE WHEN n.covered IS NULL THEN b.alpha ELSE greatest(0.01, least(0.5, b.alpha + 0.05 * (0.1 - (1 - n.covered)))) END FROM r b JOIN (SELECT * FROM c) n ON n.entity_id = b.entity_id AND n.t = b.t + 1)
    SELECT entity_id, date, covered, round(alpha + 1e-9, 6) AS alpha FROM r""",
)
def fc36(spark, sf_dir):
    found = adaptive_alpha(naive_coverage(prices(spark, sf_dir)))
    return found.select("entity_id", "date", F.col("covered").cast("int").alias("covered"), rounded(F.col("alpha")).alias("alpha"))


@query(
    "fc37_pid_alpha",
    f"""WITH RECURSIVE {COVERED}, k AS MATERIALIZED (SELECT entity_id, date, covered, 0.9 - covered AS error, row_number() OVER (PARTITION BY entity_id ORDER BY t) AS t FROM c WHERE covered IS NOT NULL),
    r AS (SELECT entity_id, date, t, covered, CAST(error AS DOUBLE) AS error, CAST(error AS DOUBLE) AS integral, greatest(0.01, least(0.5, 0.1 + 0.05 * error + 0.005 * error + 0.01 * error))::DOUBLE AS alpha FROM k WHERE t = 1
     UNION ALL SELECT entity_id, date, t, covered, e, i, greatest(0.01, least(0.5, alpha + 0.05 * e + 0.005 * i + 0.01 * (e - error))) FROM (SELECT n.entity_id, n.date, n.t, n.covered, n.error AS e, b.error, b.alpha, greatest(-3.0, least(3.0, b.integral + n.error)) AS i FROM r b JOIN (SELECT * FROM k) n ON n.entity_id = b.entity_id AND n.t = b.t + 1))
    SELECT entity_id, date, covered, round(integral + 1e-9, 6) AS integral, round(alpha + 1e-9, 6) AS alpha FROM r""",
)
def fc37(spark, sf_dir):
    """Only the controller; ``protocol.PidInterval`` also makes the intervals, by mode, and judges them (``str08_online_conformal``)."""
    found = pid_alpha(naive_coverage(prices(spark, sf_dir)))
    return found.select("entity_id", "date", F.col("covered").cast("int").alias("covered"), rounded(F.col("integral")).alias("integral"), rounded(F.col("alpha")).alias("alpha"))


@query(
    "fc21_change_score",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT entity_id AS user_id, date, x, row_number() OVER (PARTITION BY entity_id ORDER BY date) AS t FROM (SELECT entity_id, date, close / lag(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS x FROM px) WHERE x IS NOT NULL), {CHANGE}
    SELECT s.user_id AS entity_id, date, round(coalesce(score, 0) + 1e-9, 5) AS score FROM s LEFT JOIN late USING (user_id, t)""",
)
def fc21(spark, sf_dir):
    """Each day's change score of an entity's returns."""
    back = F.col("close") / F.lag("close").over(ordered()) - 1
    rows = prices(spark, sf_dir).select("entity_id", "date", back.alias("value")).where("value IS NOT NULL")
    return fold(rows, "entity_id", ["date"], ChangeScore()).select("entity_id", "date", rounded(F.col("score"), 5).alias("score"))
