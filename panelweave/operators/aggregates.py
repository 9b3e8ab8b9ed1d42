"""Group aggregates: resampling, concentration, transitions, distributions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded
from panelweave.operators.windows import RET, returns
from panelweave.plans.views import peers, prices, table
from panelweave.registry import query


@query("agg01_peer_mean_median", "SELECT nation, date, count(*) AS n, round(avg(close) + 1e-9, 4) AS mean_close, round(median(close) + 1e-9, 4) AS median_close FROM px JOIN peers USING (entity_id) GROUP BY 1, 2")
def agg01(spark, sf_dir):
    px = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id")
    return px.groupBy("nation", "date").agg(F.count("*").alias("n"), rounded(F.avg("close"), 4).alias("mean_close"), rounded(F.median("close"), 4).alias("median_close"))


@query("agg02_groups_wide", "SELECT date, round(avg(close) FILTER (region = 'AFRICA') + 1e-9, 4) AS africa, round(avg(close) FILTER (region = 'AMERICA') + 1e-9, 4) AS america, round(avg(close) FILTER (region = 'ASIA') + 1e-9, 4) AS asia, round(avg(close) FILTER (region = 'EUROPE') + 1e-9, 4) AS europe FROM px JOIN peers USING (entity_id) GROUP BY 1")
def agg02(spark, sf_dir):
    px = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id")
    wide = px.groupBy("date").pivot("region", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).agg(rounded(F.avg("close"), 4))
    return wide.toDF(*[c.lower() for c in wide.columns])


REGIONS, PANEL = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), ("open", "high", "low", "close", "volume")
WIDE = {(r, v): f"{r}_{v}".lower().replace(" ", "_") for r in REGIONS for v in PANEL}


@query("agg02_groups_wide_all", f"SELECT date, {', '.join(f"round(avg({v}) FILTER (region = '{r}') + 1e-9, 4) AS {name}" for (r, v), name in WIDE.items())} FROM px JOIN peers USING (entity_id) GROUP BY 1")
def agg02_all(spark, sf_dir):
    """All five regions and all panel variables; agg02_groups_wide has four regions' close."""
    px = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id")
    wide = px.groupBy("date").pivot("region", list(REGIONS)).agg(*[rounded(F.avg(v), 4).alias(v) for v in PANEL])
    return wide.toDF("date", *WIDE.values())


@query("agg03_ohlcv_resample", "SELECT entity_id, CAST(date_trunc('month', date) AS DATE) AS month, round(arg_min(open, date) + 1e-9, 4) AS open, round(max(high) + 1e-9, 4) AS high, round(min(low) + 1e-9, 4) AS low, round(arg_max(close, date) + 1e-9, 4) AS close, sum(volume) AS volume FROM px GROUP BY 1, 2")
def agg03(spark, sf_dir):
    month = F.to_date(F.date_trunc("month", "date")).alias("month")
    return prices(spark, sf_dir).groupBy("entity_id", month).agg(rounded(F.min_by("open", "date"), 4).alias("open"), rounded(F.max("high"), 4).alias("high"), rounded(F.min("low"), 4).alias("low"), rounded(F.max_by("close", "date"), 4).alias("close"), F.sum("volume").alias("volume"))


@query("agg05_partial_period", "SELECT entity_id, CAST(date_trunc('month', max(date)) AS DATE) AS month, max(date) AS last_date, max(date) < last_day(max(date)) AS is_partial FROM px GROUP BY 1")
def agg05(spark, sf_dir):
    last = F.max("date")
    return prices(spark, sf_dir).groupBy("entity_id").agg(F.to_date(F.date_trunc("month", last)).alias("month"), last.alias("last_date"), (last < F.last_day(last)).alias("is_partial"))


@query("agg06_herfindahl", "WITH v AS (SELECT l_suppkey AS entity_id, l_partkey, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2), t AS (SELECT *, x / sum(x) OVER (PARTITION BY entity_id) AS share FROM v) SELECT entity_id, count(*) AS n, round(sum(share * share) + 1e-9, 8) AS hhi FROM t GROUP BY 1")
def agg06(spark, sf_dir):
    """Part concentration per supplier: sum of squares over the square of the sum, in one pass."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), "l_partkey").agg(F.sum("l_extendedprice").alias("x"))
    return v.groupBy("entity_id").agg(F.count("*").alias("n"), rounded(F.sum(F.col("x") * F.col("x")) / F.pow(F.sum("x"), F.lit(2.0)), 8).alias("hhi"))


@query("agg12_net_new_revenue", "WITH y AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey, year(l_shipdate) AS year FROM lineitem), c AS (SELECT l_suppkey AS entity_id, l_partkey, sum(l_extendedprice) AS x FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1, 2) SELECT entity_id, round(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM y WHERE y.entity_id = c.entity_id AND y.l_partkey = c.l_partkey AND y.year = 1997) THEN x ELSE 0 END) / sum(x) + 1e-9, 6) AS new_share FROM c GROUP BY 1")
def agg12(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate").isin(1997, 1998)).groupBy(F.col("l_suppkey").alias("entity_id"), "l_partkey").agg(F.sum(F.when(F.year("l_shipdate") == 1998, F.col("l_extendedprice"))).alias("x"), F.count_if(F.year("l_shipdate") == 1997).alias("before"))
    return li.where("x is not null").groupBy("entity_id").agg(rounded(F.sum(F.when(F.col("before") == 0, F.col("x")).otherwise(0.0)) / F.sum("x")).alias("new_share"))


YEARS = "p AS (SELECT l_suppkey AS entity_id, l_partkey, year(l_shipdate) AS year, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2, 3), u AS (SELECT entity_id, l_partkey, year, x, 1 AS now, 0 AS before FROM p UNION ALL SELECT entity_id, l_partkey, year + 1, 0, 0, 1 FROM p), d AS (SELECT entity_id, l_partkey, year, sum(x) AS x, max(now) AS now, max(before) AS before FROM u GROUP BY 1, 2, 3), t AS (SELECT min(year) AS a, max(year) AS b FROM p)"


def year_pairs(spark, sf_dir):
    """Revenue per supplier, part and year, with flags for sales in that year and in the one before; the first year has none before it."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), "l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("x"))
    sides = F.explode(F.array(F.struct("year", "x", F.lit(1).alias("now"), F.lit(0).alias("before")), F.struct((F.col("year") + 1).alias("year"), (F.col("x") * 0).alias("x"), F.lit(0).alias("now"), F.lit(1).alias("before"))))
    d = p.select("entity_id", "l_partkey", sides.alias("s")).groupBy("entity_id", "l_partkey", "s.year").agg(F.sum("s.x").alias("x"), F.max("s.now").alias("now"), F.max("s.before").alias("before"))
    t = table(spark, sf_dir, "lineitem").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b"))  # one row
    return d.join(F.broadcast(t)).where("year > a and year <= b").drop("a", "b")


@query("agg12_net_new_revenue_by_year", f"WITH {YEARS} SELECT entity_id, year, round(sum(CASE WHEN before = 0 THEN x ELSE 0 END) / sum(x) + 1e-9, 6) AS new_share FROM d, t WHERE year > a AND year <= b AND now = 1 GROUP BY 1, 2")
def agg12_by_year(spark, sf_dir):
    """Every year against the one before; agg12_net_new_revenue is its year 1998."""
    d = year_pairs(spark, sf_dir).where("now = 1")
    return d.groupBy("entity_id", "year").agg(rounded(F.sum(F.when(F.col("before") == 0, F.col("x")).otherwise(0.0)) / F.sum("x")).alias("new_share"))


@query("agg30_coverage", "SELECT 'o_totalprice' AS variable, round(avg((o_totalprice > 1000)::int), 6) AS coverage FROM orders UNION ALL SELECT 'o_orderpriority', round(avg((nullif(o_orderpriority, '5-LOW') IS NOT NULL)::int), 6) FROM orders")
def agg30(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 1000, 1).alias("o_totalprice"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    wide = o.agg(*[F.round(F.count(c) / F.count(F.lit(1)), 6).alias(c) for c in o.columns])
    return wide.unpivot([], o.columns, "variable", "coverage")


@query("agg31_series_summary", "SELECT entity_id, count(close) AS n, round(avg(close) + 1e-9, 4) AS mean, round(stddev_samp(close) + 1e-9, 4) AS std, round(min(close) + 1e-9, 4) AS lowest, round(max(close) + 1e-9, 4) AS highest, round(arg_max(close, date) + 1e-9, 4) AS latest FROM px GROUP BY 1")
def agg31(spark, sf_dir):
    return prices(spark, sf_dir).groupBy("entity_id").agg(F.count("close").alias("n"), rounded(F.avg("close"), 4).alias("mean"), rounded(F.stddev_samp("close"), 4).alias("std"), rounded(F.min("close"), 4).alias("lowest"), rounded(F.max("close"), 4).alias("highest"), rounded(F.max_by("close", "date"), 4).alias("latest"))


STATE = f"{RET}, s AS (SELECT entity_id, date, ret, CASE WHEN ret > 0.1 THEN 'up' WHEN ret < -0.1 THEN 'down' ELSE 'flat' END AS state FROM r WHERE ret IS NOT NULL)"


def states(spark, sf_dir):
    return returns(spark, sf_dir).where("ret is not null").select("entity_id", "date", "ret", F.when(F.col("ret") > 0.1, "up").when(F.col("ret") < -0.1, "down").otherwise("flat").alias("state"))


@query(
    "agg39_transition_matrix",
    f"""WITH {STATE}, p AS (SELECT lag(state) OVER (PARTITION BY entity_id ORDER BY date) AS a, state AS b FROM s), c AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT * FROM (VALUES ('up'), ('flat'), ('down')) t(a)), g AS (SELECT l.a, m.a AS b, coalesce(n, 0) + 1 AS n FROM l CROSS JOIN l AS m LEFT JOIN c ON c.a = l.a AND c.b = m.a) SELECT a AS from_state, b AS to_state, n, round(n / sum(n) OVER (PARTITION BY a) + 1e-9, 6) AS p FROM g""",
)
def agg39(spark, sf_dir):
    """Laplace-smoothed state transitions, dense over the three states."""
    pairs = states(spark, sf_dir).select(F.lag("state").over(ordered()).alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null").groupBy("from_state", "to_state").count()
    grid = spark.createDataFrame([(a, b) for a in ("up", "flat", "down") for b in ("up", "flat", "down")], "from_state string, to_state string")
    n = (F.coalesce("count", F.lit(0)) + 1).alias("n")
    dense = grid.join(pairs, ["from_state", "to_state"], "left").select("from_state", "to_state", n)
    return dense.select("*", rounded(F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("p"))


@query("agg38_regime_distributions", f"WITH {STATE} SELECT state, count(*) AS n, round(avg(ret) + 1e-9, 6) AS mean, round(stddev_samp(ret) + 1e-9, 6) AS std FROM s GROUP BY 1")
def agg38(spark, sf_dir):
    return states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), rounded(F.avg("ret")).alias("mean"), rounded(F.stddev_samp("ret")).alias("std"))


@query("agg47_covar_delta", f"WITH {RET}, q AS (SELECT entity_id, quantile_cont(ret, 0.05) AS var5 FROM r GROUP BY 1), m AS (SELECT date, avg(ret) AS market FROM r GROUP BY 1), j AS (SELECT r.entity_id, market, ret <= var5 AS tail FROM r JOIN q USING (entity_id) JOIN m USING (date) WHERE ret IS NOT NULL) SELECT entity_id, round(quantile_cont(market, 0.05) FILTER (tail) - quantile_cont(market, 0.05) + 1e-9, 5) AS delta FROM j GROUP BY 1")
def agg47(spark, sf_dir):
    """5 % quantile of the market on the entity's own tail days, less the unconditional one."""
    r = returns(spark, sf_dir)
    q = r.groupBy("entity_id").agg(F.percentile("ret", F.lit(0.05)).alias("var5"))
    m = r.groupBy("date").agg(F.avg("ret").alias("market"))
    j = r.where("ret is not null").join(q, "entity_id").join(m, "date")
    return j.groupBy("entity_id").agg(rounded(F.percentile(F.when(F.col("ret") <= F.col("var5"), F.col("market")), F.lit(0.05)) - F.percentile("market", F.lit(0.05)), 5).alias("delta"))


@query("agg49_benford", "WITH d AS (SELECT CAST(substr(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit FROM orders WHERE o_totalprice >= 1) SELECT digit, count(*) AS n, round(log10(1 + 1.0 / digit) + 1e-9, 6) AS expected, round(count(*) / sum(count(*)) OVER () + 1e-9, 6) AS observed FROM d GROUP BY 1")
def agg49(spark, sf_dir):
    d = table(spark, sf_dir, "orders").where("o_totalprice >= 1").select(F.substring(F.floor("o_totalprice").cast("string"), 1, 1).cast("int").alias("digit"))
    counts = d.groupBy("digit").agg(F.count("*").alias("n"))  # nine rows at most
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("digit", "n", rounded(F.log10(1 + 1 / F.col("digit"))).alias("expected"), rounded(F.col("n") / F.col("total")).alias("observed"))


@query("agg54_market_concentration", "WITH v AS (SELECT nation, entity_id, sum(volume * close) AS x FROM px JOIN peers USING (entity_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY x DESC, entity_id) AS place FROM v), c AS (SELECT nation, count(*) AS n, sum(x) FILTER (place <= 4) / sum(x) AS cr4 FROM k GROUP BY 1) SELECT nation, n, round(cr4 + 1e-9, 6) AS cr4, CASE WHEN cr4 > 0.8 THEN 'concentrated' WHEN cr4 > 0.5 THEN 'moderate' ELSE 'competitive' END AS market FROM c")
def agg54(spark, sf_dir):
    v = prices(spark, sf_dir).groupBy("entity_id").agg(F.sum(F.col("volume") * F.col("close")).alias("x")).join(peers(spark, sf_dir), "entity_id")
    k = v.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("x"), "entity_id")))
    c = k.groupBy("nation").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("place") <= 4, F.col("x"))) / F.sum("x")).alias("cr4"))
    return c.select("nation", "n", rounded(F.col("cr4")).alias("cr4"), F.when(F.col("cr4") > 0.8, "concentrated").when(F.col("cr4") > 0.5, "moderate").otherwise("competitive").alias("market"))


@query("agg61_data_characteristics", f"WITH {RET}, l AS (SELECT *, lag(ret) OVER (PARTITION BY entity_id ORDER BY date) AS before FROM r) SELECT entity_id, round(avg((ret IS NULL)::int) + 1e-9, 6) AS missing_rate, round(corr(ret, before) + 1e-9, 4) AS autocorr FROM l GROUP BY 1")
def agg61(spark, sf_dir):
    df = returns(spark, sf_dir)
    df = df.withColumn("before", F.lag("ret").over(ordered()))
    return df.groupBy("entity_id").agg(rounded(F.avg(F.col("ret").isNull().cast("int"))).alias("missing_rate"), rounded(F.corr("ret", "before"), 4).alias("autocorr"))


@query("agg62_grouping_sets", "SELECT region, nation, grouping(region, nation) AS level, count(*) AS n, round(avg(balance) + 1e-9, 4) AS mean_balance FROM peers GROUP BY GROUPING SETS ((region, nation), (region), ())")
def agg62(spark, sf_dir):
    p = peers(spark, sf_dir)
    return p.groupingSets([["region", "nation"], ["region"], []], "region", "nation").agg(F.grouping_id("region", "nation").alias("level"), F.count("*").alias("n"), rounded(F.avg("balance"), 4).alias("mean_balance"))


@query("agg15_event_windows", "WITH e AS (SELECT event_type, ts, max(ts) OVER () AS t FROM events) SELECT event_type, count(*) FILTER (ts > t - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (ts <= t - INTERVAL 7 DAY AND ts > t - INTERVAL 14 DAY) AS before_7d, count(*) AS n FROM e GROUP BY 1")
def agg15(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("t"))))  # one row
    at = F.col("ts") > F.col("t") - F.expr("interval 7 days")
    return e.groupBy("event_type").agg(F.count_if(at).alias("last_7d"), F.count_if(~at & (F.col("ts") > F.col("t") - F.expr("interval 14 days"))).alias("before_7d"), F.count("*").alias("n"))
