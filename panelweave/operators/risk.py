"""Performance, tails, stability and patterns of daily returns."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import asof_join, gated, islands, ordered, rounded, trailing
from panelweave.operators.windows import RET, frame, returns
from panelweave.plans.views import filings, peers, prices
from panelweave.registry import query

W_SQL = "(PARTITION BY entity_id ORDER BY date)"


@query(
    "agg34_performance",
    f"""WITH {RET}, d AS (SELECT *, close / max(close) OVER {W_SQL} - 1 AS dd FROM r), g AS (SELECT entity_id, count(ret) AS n, last(close ORDER BY date) / first(close ORDER BY date) AS growth, avg(ret) AS mean, stddev_samp(ret) AS sd, min(dd) AS dd, max(ret) AS best, min(ret) AS worst FROM d GROUP BY 1)
    SELECT entity_id, n, round(growth - 1 + 1e-9, 6) AS total_return, round(power(growth, 252.0 / n) - 1 + 1e-9, 5) AS annual_return, round(sd * sqrt(252) + 1e-9, 5) AS vol, round(mean / sd * sqrt(252) + 1e-9, 4) AS sharpe, round(dd + 1e-9, 6) AS max_drawdown, round(best + 1e-9, 6) AS best, round(worst + 1e-9, 6) AS worst FROM g""",
)
def agg34(spark, sf_dir):
    d = returns(spark, sf_dir).withColumn("dd", F.col("close") / F.max("close").over(ordered()) - 1)
    g = d.groupBy("entity_id").agg(F.count("ret").alias("n"), (F.max_by("close", "date") / F.min_by("close", "date")).alias("growth"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("dd"), F.max("ret").alias("best"), F.min("ret").alias("worst"))
    year = F.sqrt(F.lit(252.0))
    return g.select("entity_id", "n", rounded(F.col("growth") - 1).alias("total_return"), rounded(F.pow("growth", 252.0 / F.nullif(F.col("n"), F.lit(0))) - 1, 5).alias("annual_return"), rounded(F.col("sd") * year, 5).alias("vol"), rounded(F.col("mean") / F.nullif(F.col("sd"), F.lit(0.0)) * year, 4).alias("sharpe"), rounded(F.col("dd")).alias("max_drawdown"), rounded(F.col("best")).alias("best"), rounded(F.col("worst")).alias("worst"))


DOWN = f"f AS (SELECT entity_id, date, close / max(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 251 PRECEDING) - 1 < -0.5 AS down FROM px), s AS (SELECT *, coalesce(lag(down) OVER {W_SQL}, false) AS before FROM f)"


def down_days(spark, sf_dir, depth: float = -0.5):
    f = prices(spark, sf_dir).select("entity_id", "date", (F.col("close") / F.max("close").over(trailing(252)) - 1 < depth).alias("down"))
    return f.withColumn("before", F.coalesce(F.lag("down").over(ordered()), F.lit(False)))


@query("agg33_episode_stats", f"WITH {DOWN}, i AS (SELECT *, sum(CAST(down AND NOT before AS INTEGER)) OVER {W_SQL} AS run FROM s), g AS (SELECT entity_id, run, count(*) AS days FROM i WHERE down GROUP BY 1, 2) SELECT entity_id, count(*) AS episodes, round(avg(days) + 1e-9, 4) AS mean_days, max(days) AS longest FROM g GROUP BY 1")
def agg33(spark, sf_dir):
    """Runs of days at less than half the year's high."""
    i = down_days(spark, sf_dir).withColumn("run", islands(F.col("down") & ~F.col("before")))
    g = i.where("down").groupBy("entity_id", "run").agg(F.count("*").alias("days"))
    return g.groupBy("entity_id").agg(F.count("*").alias("episodes"), rounded(F.avg("days"), 4).alias("mean_days"), F.max("days").alias("longest"))


@query("win81_recovery_signal", f"WITH {DOWN}, r AS (SELECT *, before AND NOT down AS recovered FROM s) SELECT entity_id, date, recovered, CAST(date_diff('day', max(CASE WHEN recovered THEN date END) OVER {W_SQL}, date) AS INTEGER) AS days_since FROM r")
def win81(spark, sf_dir):
    """Days on which an episode ends and the days since the latest one."""
    r = down_days(spark, sf_dir).withColumn("recovered", F.col("before") & ~F.col("down"))
    return r.select("entity_id", "date", "recovered", F.datediff("date", F.max(F.when(F.col("recovered"), F.col("date"))).over(ordered())).alias("days_since"))


REGIONAL = f"{RET}, q AS (SELECT r.entity_id, date, region, ret, avg(ret) OVER (PARTITION BY region, date) AS market FROM r JOIN peers USING (entity_id) WHERE ret IS NOT NULL)"


def regional(spark, sf_dir):
    """Returns next to the mean return of the region on that day."""
    q = returns(spark, sf_dir).where("ret is not null").join(peers(spark, sf_dir).select("entity_id", "region"), "entity_id")
    return q.join(q.groupBy("region", "date").agg(F.avg("ret").alias("market")), ["region", "date"])


@query("agg43_tail_dependence", f"WITH {REGIONAL}, t AS (SELECT entity_id, quantile_cont(ret, 0.1) + 1e-12 AS a, quantile_cont(market, 0.1) + 1e-12 AS b FROM q GROUP BY 1) SELECT entity_id, count(*) AS n, round(count(*) FILTER (ret <= a) / count(*) + 1e-9, 6) AS lower_tail FROM q JOIN t USING (entity_id) WHERE market <= b GROUP BY 1")
def agg43(spark, sf_dir):
    """Share of the region's worst tenth of days that are among the entity's own worst tenth."""
    q = regional(spark, sf_dir)
    t = q.groupBy("entity_id").agg((F.percentile("ret", F.lit(0.1)) + 1e-12).alias("a"), (F.percentile("market", F.lit(0.1)) + 1e-12).alias("b"))
    j = q.join(t, "entity_id").where("market <= b")
    return j.groupBy("entity_id").agg(F.count("*").alias("n"), rounded(F.count_if(F.col("ret") <= F.col("a")) / F.count("*")).alias("lower_tail"))


@query("agg48_component_cvar", f"WITH {REGIONAL}, d AS (SELECT DISTINCT region, date, market FROM q), t AS (SELECT region, quantile_cont(market, 0.05) + 1e-12 AS b FROM d GROUP BY 1) SELECT q.region, entity_id, count(*) AS n, round(avg(ret) + 1e-9, 6) AS tail_mean FROM q JOIN t USING (region) WHERE market <= b GROUP BY 1, 2")
def agg48(spark, sf_dir):
    """Mean return of each entity over the worst twentieth of its region's days."""
    q = regional(spark, sf_dir)
    t = q.groupBy("region", "date").agg(F.first("market").alias("market")).groupBy("region").agg((F.percentile("market", F.lit(0.05)) + 1e-12).alias("b"))
    return q.join(t, "region").where("market <= b").groupBy("region", "entity_id").agg(F.count("*").alias("n"), rounded(F.avg("ret")).alias("tail_mean"))


@query("agg52_session_noise", f"WITH {RET}, l AS (SELECT *, open / lag(close) OVER {W_SQL} - 1 AS gap, power(ln(high / low), 2) / (4 * ln(2)) AS park FROM r), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) <= 63) SELECT entity_id, round(least(greatest(stddev_samp(gap) / stddev_samp(ret), 0.05), 1) + 1e-9, 5) AS overnight, round(least(greatest(sqrt(avg(park)) / stddev_samp(ret) * 0.5, 0.1), 1.5) + 1e-9, 5) AS intraday FROM k GROUP BY 1")
def agg52(spark, sf_dir, rows: int = 63):
    """Overnight and range-based deviation relative to that of daily returns, over the last rows."""
    l = returns(spark, sf_dir).select("*", (F.col("open") / F.lag("close").over(ordered()) - 1).alias("gap"), (F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0)))).alias("park"), F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("date"))).alias("back"))
    sd, clamp = F.nullif(F.stddev_samp("ret"), F.lit(0.0)), lambda x, a, b: rounded(F.least(F.greatest(x, F.lit(a)), F.lit(b)), 5)
    return l.where(F.col("back") <= rows).groupBy("entity_id").agg(clamp(F.stddev_samp("gap") / sd, 0.05, 1.0).alias("overnight"), clamp(F.sqrt(F.avg("park")) / sd * 0.5, 0.1, 1.5).alias("intraday"))


@query("agg53_garman_klass", f"WITH {RET} SELECT entity_id, round(sqrt(greatest(avg(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2)), 0)) + 1e-9, 5) AS garman_klass, round(least(greatest(sqrt(greatest(avg(0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2)), 0)) / stddev_samp(ret) * 1.645, 1), 5) + 1e-9, 5) AS factor FROM r GROUP BY 1")
def agg53(spark, sf_dir):
    gk = F.sqrt(F.greatest(F.avg(F.expr("0.5D * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2)")), F.lit(0.0)))
    factor = F.least(F.greatest(gk / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * 1.645, F.lit(1.0)), F.lit(5.0))
    return returns(spark, sf_dir).groupBy("entity_id").agg(rounded(gk, 5).alias("garman_klass"), rounded(factor, 5).alias("factor"))


@query("agg64_participation", f"WITH {RET}, g AS (SELECT entity_id, count(x) AS n, avg(x) AS illiquidity FROM (SELECT entity_id, CASE WHEN close * volume > 0 THEN abs(ret) / (close * volume) END AS x FROM r) GROUP BY 1) SELECT entity_id, round(CASE WHEN n >= 20 THEN least(greatest(1 / (1 + 10 * illiquidity * 1e6), 0.05), 0.5) END + 1e-9, 6) AS participation FROM g")
def agg64(spark, sf_dir):
    x = F.when(F.col("close") * F.col("volume") > 0, F.abs("ret") / (F.col("close") * F.col("volume")))
    g = returns(spark, sf_dir).select("entity_id", x.alias("x")).groupBy("entity_id").agg(F.count("x").alias("n"), F.avg("x").alias("illiquidity"))
    return g.select("entity_id", rounded(F.when(F.col("n") >= 20, F.least(F.greatest(1 / (1 + 10 * F.col("illiquidity") * 1e6), F.lit(0.05)), F.lit(0.5)))).alias("participation"))


@query("win16_tail_moments", f"WITH {RET}, v AS (SELECT *, CASE WHEN count(ret) OVER {frame(21)} >= 5 THEN stddev_samp(ret) OVER {frame(21)} END AS vol FROM r) SELECT entity_id, date, round(CASE WHEN count(ret) OVER {frame(63)} >= 20 THEN quantile_cont(ret, 0.95) OVER {frame(63)} END + 1e-9, 6) AS p95, round(CASE WHEN count(ret) OVER {frame(63)} >= 20 THEN quantile_cont(ret, 0.05) OVER {frame(63)} END + 1e-9, 6) AS p05, round(CASE WHEN count(ret) OVER {frame(63)} >= 20 THEN min(ret) OVER {frame(63)} END + 1e-9, 6) AS worst, round(CASE WHEN count(vol) OVER {frame(63)} >= 20 THEN stddev_samp(vol) OVER {frame(63)} END + 1e-9, 5) AS vol_of_vol FROM v")
def win16(spark, sf_dir):
    w, ret = trailing(63), F.col("ret")
    v = returns(spark, sf_dir).withColumn("vol", gated(F.stddev_samp("ret"), ret, trailing(21), 5))
    return v.select("entity_id", "date", *[rounded(gated(a, ret, w, 20)).alias(n) for n, a in (("p95", F.percentile("ret", F.lit(0.95))), ("p05", F.percentile("ret", F.lit(0.05))), ("worst", F.min("ret")))], rounded(gated(F.stddev_samp("vol"), F.col("vol"), w, 20), 5).alias("vol_of_vol"))


@query("win27_anchors", f"SELECT entity_id, date, round(close / max(close) OVER {frame(252)} + 1e-9, 6) AS to_high, round(close / min(close) OVER {frame(252)} + 1e-9, 6) AS to_low, coalesce(count(volume) OVER {frame(63)} >= 20 AND volume > avg(volume) OVER {frame(63)} + 2 * stddev_samp(volume) OVER {frame(63)}, false) AS volume_spike FROM px")
def win27(spark, sf_dir):
    w, high, low = trailing(63), F.max("close").over(trailing(252)), F.min("close").over(trailing(252))
    spike = (F.count("volume").over(w) >= 20) & (F.col("volume") > F.avg("volume").over(w) + 2 * F.stddev_samp("volume").over(w))
    return prices(spark, sf_dir).select("entity_id", "date", rounded(F.col("close") / high).alias("to_high"), rounded(F.col("close") / low).alias("to_low"), F.coalesce(spike, F.lit(False)).alias("volume_spike"))


@query("win33_relative_strength", "WITH n AS (SELECT region, nation, date, avg(close) AS x FROM px JOIN peers USING (entity_id) GROUP BY 1, 2, 3), g AS (SELECT *, x / lag(x, 21) OVER (PARTITION BY nation ORDER BY date) - 1 AS own FROM n), a AS (SELECT *, avg(own) OVER (PARTITION BY region, date) AS market FROM g) SELECT region, nation, date, round(CASE WHEN abs(market) >= 1e-8 THEN own / market END + 1e-9, 4) AS strength FROM a")
def win33(spark, sf_dir):
    """The nation's 21-row change over the mean change of its region's nations; null where that is next to zero."""
    n = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id").groupBy("region", "nation", "date").agg(F.avg("close").alias("x"))
    g = n.withColumn("own", F.col("x") / F.lag("x", 21).over(ordered("nation")) - 1).withColumn("market", F.avg("own").over(Window.partitionBy("region", "date")))
    return g.select("region", "nation", "date", rounded(F.when(F.abs("market") >= 1e-8, F.col("own") / F.col("market")), 4).alias("strength"))


@query("win39_filing_freshness", "WITH j AS (SELECT px.entity_id, px.date, date_diff('day', f.filing_date, px.date) AS age FROM px ASOF LEFT JOIN filings f ON px.entity_id = f.entity_id AND px.date >= f.filing_date) SELECT entity_id, date, round(CASE WHEN age IS NULL THEN -1 WHEN age <= 91 THEN 1 ELSE greatest(1 - (age - 91) / 91.0, 0) END + 1e-9, 6) AS freshness FROM j")
def win39(spark, sf_dir, gap: int = 91):
    """1 within one usual gap after the last filing, falling to 0 over the next; -1 before the first."""
    j = asof_join(prices(spark, sf_dir).select("entity_id", "date"), filings(spark, sf_dir), "entity_id", "date", "filing_date", [])
    age = F.datediff("date", "filing_date")
    return j.select("entity_id", "date", rounded(F.when(age.isNull(), -1.0).when(age <= gap, 1.0).otherwise(F.greatest(1 - (age - gap) / float(gap), F.lit(0.0)))).alias("freshness"))


@query("win48_stability", f"WITH m AS (SELECT entity_id, date, CASE WHEN close > avg(close) OVER {frame(21)} THEN 1 ELSE 0 END AS up FROM px), s AS (SELECT *, avg(up) OVER {frame(21)} AS share FROM m) SELECT entity_id, date, round(CASE WHEN up = 1 THEN share ELSE 1 - share END + 1e-9, 6) AS stability FROM s")
def win48(spark, sf_dir):
    """Share of the last 21 rows in the mode of this one."""
    m = prices(spark, sf_dir).select("entity_id", "date", F.when(F.col("close") > F.avg("close").over(trailing(21)), 1).otherwise(0).alias("up"))
    share = F.avg("up").over(trailing(21))
    return m.select("entity_id", "date", rounded(F.when(F.col("up") == 1, share).otherwise(1 - share)).alias("stability"))


@query("win56_soldiers", "WITH b AS (SELECT entity_id, date, close > open AS up, close < open AS down, lag(close > open) OVER w AS up1, lag(close > open, 2) OVER w AS up2, lag(close < open) OVER w AS down1, lag(close < open, 2) OVER w AS down2, close, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date)) SELECT entity_id, date, CASE WHEN up AND up1 AND up2 AND close > c1 AND c1 > c2 THEN 1 WHEN down AND down1 AND down2 AND close < c1 AND c1 < c2 THEN -1 ELSE 0 END AS three FROM b")
def win56(spark, sf_dir):
    """1 for three rising candles with rising closes, -1 for three falling ones."""
    w, up, down, close = ordered(), F.expr("close > open"), F.expr("close < open"), F.col("close")
    at = lambda c, k: F.lag(c, k).over(w)
    c1, c2 = at(close, 1), at(close, 2)
    rise = up & at(up, 1) & at(up, 2) & (close > c1) & (c1 > c2)
    fall = down & at(down, 1) & at(down, 2) & (close < c1) & (c1 < c2)
    return prices(spark, sf_dir).select("entity_id", "date", F.when(rise, 1).when(fall, -1).otherwise(0).alias("three"))


@query("win62_deterioration", "WITH b AS (SELECT entity_id, close, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM px) SELECT entity_id, round((avg(close) FILTER (back <= 21) - avg(close) FILTER (back > 21 AND back <= 273)) / stddev_samp(close) FILTER (back > 21 AND back <= 273) + 1e-9, 5) AS shift FROM b GROUP BY 1")
def win62(spark, sf_dir, recent: int = 21, prior: int = 252):
    """The recent mean less the mean of the rows before, in standard deviations of those."""
    b = prices(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("date"))))
    new, old = F.when(F.col("back") <= recent, F.col("close")), F.when((F.col("back") > recent) & (F.col("back") <= recent + prior), F.col("close"))
    return b.groupBy("entity_id").agg(rounded((F.avg(new) - F.avg(old)) / F.nullif(F.stddev_samp(old), F.lit(0.0)), 5).alias("shift"))
