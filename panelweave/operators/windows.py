"""Windowed panel features. All windows are by rows per entity, ordered by date."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import gated, islands, ordered, rounded, trailing
from panelweave.plans.views import filings, prices
from panelweave.registry import query

RET = "r AS (SELECT *, close / lag(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS ret FROM px)"


def frame(rows: int) -> str:
    return f"(PARTITION BY entity_id ORDER BY date ROWS {rows - 1} PRECEDING)"


def returns(spark, sf_dir):
    px = prices(spark, sf_dir)
    return px.withColumn("ret", F.col("close") / F.lag("close").over(ordered()) - 1)


@query(
    "win01_returns_risk",
    f"""WITH {RET} SELECT entity_id, date, round(ret + 1e-9, 6) AS return_1d, round(close / lag(close, 5) OVER w - 1 + 1e-9, 6) AS return_5d, round(close / lag(close, 21) OVER w - 1 + 1e-9, 6) AS return_21d, round(ln(1 + ret) + 1e-9, 6) AS log_return,
    round(CASE WHEN count(ret) OVER {frame(21)} >= 5 THEN stddev_samp(ret) OVER {frame(21)} END + 1e-9, 6) AS vol_21d, round(CASE WHEN count(ret) OVER {frame(63)} >= 10 THEN stddev_samp(ret) OVER {frame(63)} END + 1e-9, 6) AS vol_63d, round(close / max(close) OVER {frame(252)} - 1 + 1e-9, 6) AS drawdown_252d FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY date)""",
)
def win01(spark, sf_dir):
    df, w, close = returns(spark, sf_dir), ordered(), F.col("close")
    change = lambda k: rounded(close / F.lag("close", k).over(w) - 1)
    vol = lambda n, least: rounded(gated(F.stddev_samp("ret"), F.col("ret"), trailing(n), least))
    return df.select("entity_id", "date", rounded(F.col("ret")).alias("return_1d"), change(5).alias("return_5d"), change(21).alias("return_21d"), rounded(F.ln(1 + F.col("ret"))).alias("log_return"), vol(21, 5).alias("vol_21d"), vol(63, 10).alias("vol_63d"), rounded(close / F.max("close").over(trailing(252)) - 1).alias("drawdown_252d"))


@query("win04_average_volume", f"SELECT entity_id, date, round(avg(volume) OVER {frame(21)} + 1e-9, 6) AS avg_volume_21d FROM px")
def win04(spark, sf_dir):
    return prices(spark, sf_dir).select("entity_id", "date", rounded(F.avg("volume").over(trailing(21))).alias("avg_volume_21d"))


@query(
    "win05_technical",
    f"""WITH d AS (SELECT *, close - lag(close) OVER (PARTITION BY entity_id ORDER BY date) AS step FROM px),
    g AS (SELECT *, avg(CASE WHEN step > 0 THEN step ELSE 0 END) OVER {frame(14)} AS gain, avg(CASE WHEN step < 0 THEN -step ELSE 0 END) OVER {frame(14)} AS loss, count(step) OVER {frame(14)} AS n FROM d)
    SELECT entity_id, date, round(avg(close) OVER {frame(50)} + 1e-9, 4) AS sma_50, round(CASE WHEN n >= 14 AND gain + loss > 0 THEN 100 * gain / (gain + loss) END + 1e-9, 4) AS rsi_14,
    round(CASE WHEN count(close) OVER {frame(20)} >= 20 THEN avg(close) OVER {frame(20)} + 2 * stddev_samp(close) OVER {frame(20)} END + 1e-9, 4) AS bollinger_upper,
    round(sum(CASE WHEN step > 0 THEN volume WHEN step < 0 THEN -volume ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY date), 4) AS obv FROM g""",
)
def win05(spark, sf_dir):
    df = prices(spark, sf_dir).withColumn("step", F.col("close") - F.lag("close").over(ordered()))
    w14, w20, step = trailing(14), trailing(20), F.col("step")
    df = df.select("*", F.avg(F.when(step > 0, step).otherwise(0)).over(w14).alias("gain"), F.avg(F.when(step < 0, -step).otherwise(0)).over(w14).alias("loss"), F.count("step").over(w14).alias("n"))
    signed = F.when(step > 0, F.col("volume")).when(step < 0, -F.col("volume")).otherwise(0)
    rsi = F.when((F.col("n") >= 14) & (F.col("gain") + F.col("loss") > 0), 100 * F.col("gain") / (F.col("gain") + F.col("loss")))
    upper = F.when(F.count("close").over(w20) >= 20, F.avg("close").over(w20) + 2 * F.stddev_samp("close").over(w20))
    return df.select("entity_id", "date", rounded(F.avg("close").over(trailing(50)), 4).alias("sma_50"), rounded(rsi, 4).alias("rsi_14"), rounded(upper, 4).alias("bollinger_upper"), F.round(F.sum(signed).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("obv"))


@query(
    "win06_rolling_beta",
    f"""WITH {RET}, m AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM r)
    SELECT entity_id, date, round(CASE WHEN count(ret) OVER {frame(252)} >= 60 AND var_samp(market) OVER {frame(252)} > 1e-12 THEN regr_slope(ret, market) OVER {frame(252)} END + 1e-9, 4) AS beta FROM m""",
)
def win06(spark, sf_dir):
    """Beta against the mean return of the day.

    Running sums and their values 252 rows before give each frame's moments in
    linear time, instead of going over 252 rows for every row.
    """
    df = returns(spark, sf_dir)
    market = df.groupBy("date").agg(F.avg("ret").alias("market"))  # pre-aggregated: no window over a whole day
    df = df.join(market, "date")
    y, m = F.col("ret"), F.col("market")
    x = F.when(y.isNotNull(), m)
    parts = {"n": y.isNotNull().cast("double"), "x": x, "y": y, "xy": x * y, "xx": x * x, "k": m.isNotNull().cast("double"), "m": m, "mm": m * m}
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("entity_id", "date", *[F.sum(F.coalesce(c, F.lit(0.0))).over(so_far).alias(k) for k, c in parts.items()])
    df = df.select("entity_id", "date", *[(F.col(k) - F.coalesce(F.lag(k, 252).over(ordered()), F.lit(0.0))).alias(k) for k in parts])
    n, k = F.col("n"), F.col("k")
    spread = F.when(k > 1, (F.col("mm") - F.col("m") * F.col("m") / k) / (k - 1))
    variance = F.when(n > 1, F.col("xx") - F.col("x") * F.col("x") / n)
    beta = F.when((n >= 60) & (spread > 1e-12) & (variance > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / variance)
    return df.select("entity_id", "date", rounded(beta, 4).alias("beta"))


@query(
    "win07_drawdown_recovery",
    """WITH d AS (SELECT *, close < max(close) OVER (PARTITION BY entity_id ORDER BY date) AS under FROM px),
    s AS (SELECT *, CASE WHEN under AND NOT coalesce(lag(under) OVER (PARTITION BY entity_id ORDER BY date), false) THEN 1 ELSE 0 END AS begins FROM d),
    e AS (SELECT entity_id, sum(begins) OVER (PARTITION BY entity_id ORDER BY date) AS episode, under FROM s), n AS (SELECT entity_id, episode, count(*) AS days FROM e WHERE under GROUP BY 1, 2)
    SELECT entity_id, count(*) AS episodes, max(days) AS longest, round(avg(days) + 1e-9, 6) AS mean_days FROM n GROUP BY 1""",
)
def win07(spark, sf_dir):
    df = prices(spark, sf_dir).withColumn("under", F.col("close") < F.max("close").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    begins = F.col("under") & ~F.coalesce(F.lag("under").over(ordered()), F.lit(False))
    runs = df.withColumn("begins", begins).withColumn("episode", islands(F.col("begins"))).where("under").groupBy("entity_id", "episode").agg(F.count("*").alias("days"))
    return runs.groupBy("entity_id").agg(F.count("*").alias("episodes"), F.max("days").alias("longest"), rounded(F.avg("days")).alias("mean_days"))


@query(
    "win09_realised_vol_split",
    f"""WITH {RET}, b AS (SELECT *, abs(ret) * abs(lag(ret) OVER (PARTITION BY entity_id ORDER BY date)) AS pair FROM r),
    v AS (SELECT entity_id, date, sum(ret * ret) OVER {frame(21)} AS rv, pi() / 2 * sum(pair) OVER {frame(21)} AS bv FROM b)
    SELECT entity_id, date, round(rv + 1e-9, 5) AS rv, round(bv + 1e-9, 5) AS bv, round(CASE WHEN rv IS NOT NULL AND bv IS NOT NULL THEN greatest(0, rv - bv) END + 1e-9, 5) AS jump FROM v""",
)
def win09(spark, sf_dir):
    df = returns(spark, sf_dir)
    df = df.withColumn("pair", F.abs("ret") * F.abs(F.lag("ret").over(ordered())))
    rv, bv = F.sum(F.col("ret") * F.col("ret")).over(trailing(21)), F.pi() / 2 * F.sum("pair").over(trailing(21))
    v = df.select("entity_id", "date", rv.alias("rv"), bv.alias("bv"))
    jump = F.when(F.col("rv").isNotNull() & F.col("bv").isNotNull(), F.greatest(F.lit(0.0), F.col("rv") - F.col("bv")))
    return v.select("entity_id", "date", rounded(F.col("rv"), 5).alias("rv"), rounded(F.col("bv"), 5).alias("bv"), rounded(jump, 5).alias("jump"))


@query(
    "win14_autocorrelation",
    f"""WITH {RET}, l AS (SELECT *, lag(ret) OVER (PARTITION BY entity_id ORDER BY date) AS before FROM r), c AS (SELECT entity_id, date, close, count(*) FILTER (ret IS NOT NULL AND before IS NOT NULL) OVER {frame(63)} AS n, corr(ret, before) OVER {frame(63)} AS ac FROM l)
    SELECT entity_id, date, round(CASE WHEN n >= 20 THEN ac END + 1e-9, 4) AS autocorr_1, round(lag(close, 21) OVER w / lag(close, 252) OVER w - 1 + 1e-9, 6) AS momentum_12_1 FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY date)""",
)
def win14(spark, sf_dir):
    df, w = returns(spark, sf_dir), ordered()
    df = df.withColumn("before", F.lag("ret").over(w))
    both = F.count_if(F.col("ret").isNotNull() & F.col("before").isNotNull()).over(trailing(63))
    return df.select("entity_id", "date", rounded(F.when(both >= 20, F.corr("ret", "before").over(trailing(63))), 4).alias("autocorr_1"), rounded(F.lag("close", 21).over(w) / F.lag("close", 252).over(w) - 1).alias("momentum_12_1"))


@query(
    "win28_amihud",
    f"""WITH {RET}, i AS (SELECT *, CASE WHEN close * volume > 0 THEN abs(ret) / (close * volume) END AS x FROM r) SELECT entity_id, date, round(1e6 * CASE WHEN count(x) OVER {frame(21)} >= 5 THEN avg(x) OVER {frame(21)} END + 1e-9, 4) AS illiquidity FROM i""",
)
def win28(spark, sf_dir):
    df = returns(spark, sf_dir).withColumn("x", F.when(F.col("close") * F.col("volume") > 0, F.abs("ret") / (F.col("close") * F.col("volume"))))
    return df.select("entity_id", "date", rounded(1e6 * gated(F.avg("x"), F.col("x"), trailing(21), 5), 4).alias("illiquidity"))


@query(
    "win26_normalisation",
    f"""WITH z AS (SELECT *, count(close) OVER {frame(63)} AS n, avg(close) OVER {frame(63)} AS mean, stddev_samp(close) OVER {frame(63)} AS sd FROM px) SELECT entity_id, date, round(CASE WHEN n >= 10 AND sd > 1e-9 THEN (close - mean) / sd END + 1e-9, 4) AS z63, round(close - lag(close, 21) OVER (PARTITION BY entity_id ORDER BY date) + 1e-9, 4) AS change_21 FROM z""",
)
def win26(spark, sf_dir):
    w, close = trailing(63), F.col("close")
    sd = F.stddev_samp("close").over(w)
    z = F.when((F.count("close").over(w) >= 10) & (sd > 1e-9), (close - F.avg("close").over(w)) / sd)
    return prices(spark, sf_dir).select("entity_id", "date", rounded(z, 4).alias("z63"), rounded(close - F.lag("close", 21).over(ordered()), 4).alias("change_21"))


@query(
    "win47_days_in_mode",
    """WITH m AS (SELECT entity_id, date, CASE WHEN close > avg(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) THEN 'up' ELSE 'down' END AS mode FROM px),
    s AS (SELECT *, CASE WHEN mode <> lag(mode) OVER w THEN 1 ELSE 0 END AS switch FROM m WINDOW w AS (PARTITION BY entity_id ORDER BY date)), i AS (SELECT *, sum(switch) OVER (PARTITION BY entity_id ORDER BY date) AS run FROM s)
    SELECT entity_id, date, mode, switch, CAST(row_number() OVER (PARTITION BY entity_id, run ORDER BY date) AS INTEGER) AS days_in_mode FROM i""",
)
def win47(spark, sf_dir):
    """Mode, switch points and the run's length so far."""
    df = prices(spark, sf_dir).select("entity_id", "date", F.when(F.col("close") > F.avg("close").over(trailing(21)), "up").otherwise("down").alias("mode"))
    df = df.withColumn("switch", F.coalesce((F.col("mode") != F.lag("mode").over(ordered())).cast("int"), F.lit(0)))
    df = df.withColumn("run", islands(F.col("switch")))
    return df.select("entity_id", "date", "mode", "switch", F.row_number().over(Window.partitionBy("entity_id", "run").orderBy("date")).alias("days_in_mode"))


@query(
    "win03_ttm_growth",
    """WITH t AS (SELECT *, CASE WHEN count(*) OVER f = 4 THEN sum(revenue) OVER f END AS ttm FROM filings WINDOW f AS (PARTITION BY entity_id ORDER BY report_date ROWS 3 PRECEDING)), y AS (SELECT *, lag(ttm, 4) OVER (PARTITION BY entity_id ORDER BY report_date) AS prior FROM t)
    SELECT entity_id, report_date, round(ttm + 1e-9, 2) AS ttm, round(CASE WHEN abs(prior) >= 1e-9 THEN (ttm - prior) / abs(prior) END + 1e-9, 6) AS yoy FROM y""",
)
def win03(spark, sf_dir):
    w, f = ordered(order="report_date"), trailing(4, order="report_date")
    df = filings(spark, sf_dir).withColumn("ttm", F.when(F.count("*").over(f) == 4, F.sum("revenue").over(f))).withColumn("prior", F.lag("ttm", 4).over(w))
    return df.select("entity_id", "report_date", rounded(F.col("ttm"), 2).alias("ttm"), rounded(F.when(F.abs("prior") >= 1e-9, (F.col("ttm") - F.col("prior")) / F.abs("prior"))).alias("yoy"))


@query("win59_forward_returns", "SELECT entity_id, date, round(lead(close) OVER w / close - 1 + 1e-9, 6) AS fwd_1d, round(lead(close, 5) OVER w / close - 1 + 1e-9, 6) AS fwd_5d, round(lead(close, 21) OVER w / close - 1 + 1e-9, 6) AS fwd_21d FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)")
def win59(spark, sf_dir):
    w = ordered()
    return prices(spark, sf_dir).select("entity_id", "date", *[rounded(F.lead("close", k).over(w) / F.col("close") - 1).alias(f"fwd_{k}d") for k in (1, 5, 21)])


@query("win55_engulfing", "WITH b AS (SELECT *, lag(open) OVER w AS o1, lag(close) OVER w AS c1 FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)) SELECT entity_id, date, CASE WHEN c1 < o1 AND close > open AND open <= c1 AND close >= o1 THEN 1 WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 THEN -1 ELSE 0 END AS engulfing FROM b")
def win55(spark, sf_dir):
    df = prices(spark, sf_dir).select("*", F.lag("open").over(ordered()).alias("o1"), F.lag("close").over(ordered()).alias("c1"))
    return df.select("entity_id", "date", F.expr("case when c1 < o1 and close > open and open <= c1 and close >= o1 then 1 when c1 > o1 and close < open and open >= c1 and close <= o1 then -1 else 0 end").alias("engulfing"))


@query("win72_vol_term_structure", f"WITH {RET} SELECT entity_id, date, round(CASE WHEN count(ret) OVER {frame(5)} >= 5 THEN stddev_samp(ret) OVER {frame(5)} END * sqrt(252) + 1e-9, 5) AS vol_5, round(CASE WHEN count(ret) OVER {frame(63)} >= 63 THEN stddev_samp(ret) OVER {frame(63)} END * sqrt(252) + 1e-9, 5) AS vol_63 FROM r")
def win72(spark, sf_dir):
    vol = lambda n: rounded(gated(F.stddev_samp("ret"), F.col("ret"), trailing(n), n) * F.sqrt(F.lit(252.0)), 5).alias(f"vol_{n}")
    return returns(spark, sf_dir).select("entity_id", "date", vol(5), vol(63))


@query("win74_ou_half_life", "WITH d AS (SELECT entity_id, lag(close) OVER w AS x, close - lag(close) OVER w AS dx FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)), s AS (SELECT entity_id, regr_slope(dx, x) AS b FROM d GROUP BY 1) SELECT entity_id, round(b + 1e-9, 6) AS slope, round(CASE WHEN b < 0 THEN ln(2) / -b END + 1e-9, 4) AS half_life FROM s")
def win74(spark, sf_dir):
    df = prices(spark, sf_dir).select("entity_id", F.lag("close").over(ordered()).alias("x"), F.col("close").alias("c")).withColumn("dx", F.col("c") - F.col("x"))
    s = df.groupBy("entity_id").agg(F.regr_slope("dx", "x").alias("b"))
    return s.select("entity_id", rounded(F.col("b")).alias("slope"), rounded(F.when(F.col("b") < 0, F.ln(F.lit(2.0)) / -F.col("b")), 4).alias("half_life"))
