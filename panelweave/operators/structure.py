"""Concentration, mix and migration of revenue, and repairs of filings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, trailing
from panelweave.plans.views import filings, peers, prices, table
from panelweave.registry import query

SALES = "s AS (SELECT l_suppkey AS entity_id, n_name AS nation, r_name AS region, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"


def sales(spark, sf_dir):
    """Revenue of each supplier by its customers' nation and region."""
    li, o, c, n, r = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.col("l_suppkey").alias("entity_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.sum("l_extendedprice").alias("value"))


@query("agg07_geographic_hhi", f"WITH {SALES} SELECT entity_id, count(*) AS nations, round(sum(value * value) / (sum(value) * sum(value)) + 1e-9, 6) AS hhi, round(max(value) / sum(value) + 1e-9, 6) AS largest FROM s GROUP BY 1")
def agg07(spark, sf_dir):
    total = F.sum("value")
    return sales(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("nations"), rounded(F.sum(F.col("value") * F.col("value")) / (total * total)).alias("hhi"), rounded(F.max("value") / total).alias("largest"))


@query("agg13_region_exposure", f"WITH {SALES} SELECT entity_id, round(least(sum(CASE region WHEN 'ASIA' THEN value WHEN 'MIDDLE EAST' THEN 0.5 * value ELSE 0 END) / sum(value), 1) + 1e-9, 6) AS exposure FROM s GROUP BY 1")
def agg13(spark, sf_dir):
    """Share of revenue from one region, a second one counted by half."""
    part = F.when(F.col("region") == "ASIA", F.col("value")).when(F.col("region") == "MIDDLE EAST", 0.5 * F.col("value")).otherwise(0.0)
    return sales(spark, sf_dir).groupBy("entity_id").agg(rounded(F.least(F.sum(part) / F.sum("value"), F.lit(1.0))).alias("exposure"))


BRANDS = "b AS (SELECT l_suppkey AS entity_id, year(l_shipdate) AS year, p_brand AS segment, sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


def brands(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("year"), F.col("p_brand").alias("segment")).agg(F.sum("l_extendedprice").alias("value"))


@query("agg10_segment_metrics", f"WITH {BRANDS} SELECT entity_id, year, count(*) AS segments, round(sum(value * value) / (sum(value) * sum(value)) + 1e-9, 6) AS hhi, first(segment ORDER BY value DESC, segment) AS dominant, round(max(value) / sum(value) + 1e-9, 6) AS dominant_share FROM b GROUP BY 1, 2")
def agg10(spark, sf_dir):
    total = F.sum("value")
    dominant = F.min_by("segment", F.struct(-F.col("value"), F.col("segment")))
    return brands(spark, sf_dir).groupBy("entity_id", "year").agg(F.count("*").alias("segments"), rounded(F.sum(F.col("value") * F.col("value")) / (total * total)).alias("hhi"), dominant.alias("dominant"), rounded(F.max("value") / total).alias("dominant_share"))


@query(
    "agg11_cannibalisation",
    f"""WITH {BRANDS}, p AS (SELECT *, value / sum(value) OVER (PARTITION BY entity_id, year) AS share FROM b), u AS (SELECT entity_id, year, segment, share AS now, 0.0 AS before FROM p UNION ALL SELECT entity_id, year + 1, segment, 0.0, share FROM p),
    d AS (SELECT entity_id, year, segment, sum(now) - sum(before) AS delta, sum(now) AS now, sum(before) AS before FROM u GROUP BY 1, 2, 3), g AS (SELECT entity_id, year, sum(greatest(delta, 0)) AS gained, sum(greatest(-delta, 0)) AS lost FROM d GROUP BY 1, 2 HAVING sum(now) > 0 AND sum(before) > 0)
    SELECT entity_id, year, round(gained + 1e-9, 6) AS gained, round(lost + 1e-9, 6) AS lost FROM g""",
)
def agg11(spark, sf_dir):
    """Shares that segments won and lost against the year before; both years need revenue."""
    b = brands(spark, sf_dir)
    p = b.withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy("entity_id", "year")))
    sides = F.explode(F.array(F.struct(F.col("year").alias("year"), F.col("share").alias("now"), F.lit(0.0).alias("before")), F.struct((F.col("year") + 1).alias("year"), F.lit(0.0).alias("now"), F.col("share").alias("before"))))
    d = p.select("entity_id", "segment", sides.alias("x")).groupBy("entity_id", "x.year", "segment").agg(F.sum("x.now").alias("now"), F.sum("x.before").alias("before"))
    delta, none = F.col("now") - F.col("before"), F.lit(0.0)
    g = d.groupBy("entity_id", "year").agg(F.sum(F.greatest(delta, none)).alias("gained"), F.sum(F.greatest(-delta, none)).alias("lost"), F.sum("now").alias("now"), F.sum("before").alias("before"))
    return g.where("now > 0 and before > 0").select("entity_id", "year", rounded(F.col("gained")).alias("gained"), rounded(F.col("lost")).alias("lost"))


GROWTH = "g AS (SELECT entity_id, report_date, revenue / nullif(lag(revenue) OVER (PARTITION BY entity_id ORDER BY report_date), 0) - 1 AS growth FROM filings), c AS (SELECT *, CASE WHEN growth > 0.05 THEN 'up' WHEN growth < -0.05 THEN 'down' ELSE 'flat' END AS state FROM g WHERE growth IS NOT NULL)"


def growth_states(spark, sf_dir):
    g = filings(spark, sf_dir).select("entity_id", "report_date", (F.col("revenue") / F.nullif(F.lag("revenue").over(ordered(order="report_date")), F.lit(0.0)) - 1).alias("growth"))
    return g.where("growth is not null").withColumn("state", F.when(F.col("growth") > 0.05, "up").when(F.col("growth") < -0.05, "down").otherwise("flat"))


@query("agg41_surprise_transitions", f"WITH {GROWTH}, t AS (SELECT lag(state) OVER (PARTITION BY entity_id ORDER BY report_date) AS before, state FROM c), n AS (SELECT before, state, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2) SELECT before, state, n, round(n / sum(n) OVER (PARTITION BY before) + 1e-9, 6) AS probability FROM n")
def agg41(spark, sf_dir):
    """From one filing's growth state to the next one's."""
    t = growth_states(spark, sf_dir).select(F.lag("state").over(ordered(order="report_date")).alias("before"), "state").where("before is not null")
    n = t.groupBy("before", "state").agg(F.count("*").alias("n"))
    return n.select("before", "state", "n", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("before"))).alias("probability"))


@query("agg51_growth_entropy", f"WITH {GROWTH}, h AS (SELECT entity_id, CAST(floor(least(greatest(growth, -1), 0.999) * 5) AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT entity_id, n / sum(n) OVER (PARTITION BY entity_id) AS p FROM h) SELECT entity_id, count(*) AS bins, round(abs(sum(p * ln(p))) + 1e-9, 6) AS entropy FROM p GROUP BY 1")
def agg51(spark, sf_dir):
    """Entropy of the histogram of growth in ten bins from -1 to 1, the ends open."""
    bin_ = F.floor(F.least(F.greatest("growth", F.lit(-1.0)), F.lit(0.999)) * 5).cast("int")
    h = growth_states(spark, sf_dir).groupBy("entity_id", bin_.alias("bin")).agg(F.count("*").alias("n"))
    p = h.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("entity_id")))
    return p.groupBy("entity_id").agg(F.count("*").alias("bins"), rounded(F.abs(F.sum(F.col("p") * F.ln("p")))).alias("entropy"))


@query("agg57_leader_rank", "WITH t AS (SELECT entity_id, sum(revenue) AS revenue, sum(net) / sum(revenue) AS margin FROM filings GROUP BY 1), k AS (SELECT nation, entity_id, percent_rank() OVER (PARTITION BY nation ORDER BY revenue) AS r, percent_rank() OVER (PARTITION BY nation ORDER BY balance) AS b, percent_rank() OVER (PARTITION BY nation ORDER BY margin) AS m FROM t JOIN peers USING (entity_id)) SELECT nation, entity_id, round(0.4 * b + 0.4 * r + 0.2 * m + 1e-9, 6) AS score, 0.4 * b + 0.4 * r + 0.2 * m + 1e-12 >= 0.6 AS leader FROM k")
def agg57(spark, sf_dir):
    """Size, revenue and margin ranks within the nation in one score; leaders reach 0.6."""
    t = filings(spark, sf_dir).groupBy("entity_id").agg(F.sum("revenue").alias("revenue"), (F.sum("net") / F.nullif(F.sum("revenue"), F.lit(0.0))).alias("margin")).join(peers(spark, sf_dir), "entity_id")
    rank = lambda c: F.percent_rank().over(Window.partitionBy("nation").orderBy(c))
    score = 0.4 * F.col("b") + 0.4 * F.col("r") + 0.2 * F.col("m")
    k = t.select("nation", "entity_id", rank("revenue").alias("r"), rank("balance").alias("b"), rank("margin").alias("m"))
    return k.select("nation", "entity_id", rounded(score).alias("score"), (score + 1e-12 >= 0.6).alias("leader"))


@query("agg20_net_flow", "WITH f AS (SELECT entity_id, date, sum(CAST(sign(close - open) AS INTEGER) * volume) OVER (PARTITION BY entity_id ORDER BY date ROWS 89 PRECEDING) AS flow FROM px) SELECT entity_id, date, round(flow / nullif(max(abs(flow)) OVER (PARTITION BY entity_id), 0) + 1e-9, 6) AS net_flow FROM f")
def agg20(spark, sf_dir):
    """Signed volume of 90 rows over its greatest size."""
    f = prices(spark, sf_dir).select("entity_id", "date", F.sum(F.signum(F.col("close") - F.col("open")) * F.col("volume")).over(trailing(90)).alias("flow"))
    return f.select("entity_id", "date", rounded(F.col("flow") / F.nullif(F.max(F.abs("flow")).over(Window.partitionBy("entity_id")), F.lit(0.0))).alias("net_flow"))


@query("win84_momentum_streak", "WITH d AS (SELECT entity_id, report_date, CAST(sign(net - lag(net) OVER w) AS INTEGER) AS s FROM filings WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), l AS (SELECT *, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2 FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)) SELECT entity_id, report_date, CASE WHEN s = 1 AND s1 = 1 AND s2 = 1 THEN 0.8 WHEN s = -1 AND s1 = -1 AND s2 = -1 THEN -0.8 WHEN s = 1 AND s1 = 1 THEN 0.4 WHEN s = -1 AND s1 = -1 THEN -0.4 ELSE 0 END :: DOUBLE AS streak FROM l")
def win84(spark, sf_dir):
    """Steps of the last three filings: three or two in one direction."""
    w = ordered(order="report_date")
    d = filings(spark, sf_dir).select("entity_id", "report_date", F.signum(F.col("net") - F.lag("net").over(w)).cast("int").alias("s"))
    l = d.select("*", F.lag("s").over(w).alias("s1"), F.lag("s", 2).over(w).alias("s2"))
    run = lambda sign, k: F.expr(" and ".join(f"{c} = {sign}" for c in ("s", "s1", "s2")[:k]))
    return l.select("entity_id", "report_date", F.when(run(1, 3), 0.8).when(run(-1, 3), -0.8).when(run(1, 2), 0.4).when(run(-1, 2), -0.4).otherwise(0.0).alias("streak"))


@query("dq43_payout_regression", "WITH d AS (SELECT entity_id, tax AS y, lag(tax) OVER (PARTITION BY entity_id ORDER BY report_date) AS x FROM filings), r AS (SELECT entity_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM d WHERE x IS NOT NULL GROUP BY 1) SELECT entity_id, round(slope + 1e-9, 5) AS slope, round(intercept + 1e-9, 2) AS intercept FROM r")
def dq43(spark, sf_dir):
    """A payout on the one before it."""
    d = filings(spark, sf_dir).select("entity_id", F.col("tax").alias("y"), F.lag("tax").over(ordered(order="report_date")).alias("x")).where("x is not null")
    return d.groupBy("entity_id").agg(rounded(F.regr_slope("y", "x"), 5).alias("slope"), rounded(F.regr_intercept("y", "x"), 2).alias("intercept"))


@query("dq45_shrunk_means", "WITH g AS (SELECT region, nation, avg(balance) AS m, var_pop(balance) / count(*) AS v FROM peers GROUP BY 1, 2), t AS (SELECT *, avg(m) OVER r AS gm, count(*) OVER r AS k, sum(CASE WHEN v > 0 THEN power(m - gm0, 2) / v END) OVER r AS z FROM (SELECT *, avg(m) OVER (PARTITION BY region) AS gm0 FROM g) WINDOW r AS (PARTITION BY region)) SELECT region, nation, round(gm + (1 - least(greatest(coalesce((k - 2) / nullif(z, 0), 0), 0), 1)) * (m - gm) + 1e-9, 3) AS shrunk FROM t")
def dq45(spark, sf_dir):
    """National means drawn towards the region's mean, the more so the less they differ for their variance."""
    r, m, gm, v = Window.partitionBy("region"), F.col("m"), F.col("gm"), F.col("v")
    g = peers(spark, sf_dir).groupBy("region", "nation").agg(F.avg("balance").alias("m"), (F.var_pop("balance") / F.count("*")).alias("v"))
    t = g.withColumn("gm", F.avg("m").over(r)).select("*", F.count("*").over(r).alias("k"), F.sum(F.when(v > 0, F.pow(m - gm, 2) / v)).over(r).alias("z"))
    c = F.least(F.greatest(F.coalesce((F.col("k") - 2) / F.nullif(F.col("z"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return t.select("region", "nation", rounded(gm + (1 - c) * (m - gm), 3).alias("shrunk"))
