"""As-of, interval, anti and semi joins over panels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import asof_join, forward_fill, gated, rounded, safe_ratio, trailing
from panelweave.plans.views import filings, peers, prices, table
from panelweave.registry import query


@query(
    "flagship_panel",
    """WITH p AS (SELECT px.*, f.filing_date, f.revenue, f.net FROM px ASOF LEFT JOIN filings f ON px.entity_id = f.entity_id AND px.date >= f.filing_date),
    r AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY date)),
    v AS (SELECT *, CASE WHEN count(ret) OVER t >= 5 THEN stddev_samp(ret) OVER t END AS vol, close / max(close) OVER d - 1 AS drawdown, CASE WHEN abs(revenue) >= 1e-9 THEN net / revenue END AS margin
     FROM r WINDOW t AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING), d AS (PARTITION BY entity_id ORDER BY date ROWS 251 PRECEDING)),
    l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) = 1),
    k AS (SELECT nation, l.entity_id, date, round(close + 1e-9, 4) AS close, round(vol + 1e-9, 6) AS vol, round(drawdown + 1e-9, 6) AS drawdown, round(margin + 1e-9, 6) AS margin, row_number() OVER (PARTITION BY nation ORDER BY margin DESC NULLS LAST, l.entity_id) AS place FROM l JOIN peers USING (entity_id))
    SELECT * FROM k WHERE place <= 10""",
)
def flagship_panel(spark, sf_dir):
    """Point-in-time panel: as-of filings, returns, risk and margins, best ten suppliers of each nation by margin."""
    panel = asof_join(prices(spark, sf_dir), filings(spark, sf_dir), "entity_id", "date", "filing_date", ["revenue", "net"])
    w = Window.partitionBy("entity_id").orderBy("date")
    panel = panel.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    panel = panel.select("*", gated(F.stddev_samp("ret"), F.col("ret"), trailing(21), 5).alias("vol"), (F.col("close") / F.max("close").over(trailing(252)) - 1).alias("drawdown"), *safe_ratio(F.col("net"), F.col("revenue"), "margin")[:1])
    last = panel.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("date")))).where("n = 1")
    ranked = last.join(peers(spark, sf_dir), "entity_id").withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc_nulls_last("margin"), "entity_id")))
    return ranked.where("place <= 10").select("nation", "entity_id", "date", rounded(F.col("close"), 4).alias("close"), *[rounded(F.col(x)).alias(x) for x in ("vol", "drawdown", "margin")], "place")


@query("join01_asof_statement", "SELECT px.entity_id, px.date, f.filing_date, f.revenue, f.net, f.tax FROM px ASOF LEFT JOIN filings f ON px.entity_id = f.entity_id AND px.date >= f.filing_date")
def join01(spark, sf_dir):
    """Each day's latest filing."""
    return asof_join(prices(spark, sf_dir).select("entity_id", "date"), filings(spark, sf_dir), "entity_id", "date", "filing_date", ["revenue", "net", "tax"])


@query("join03_lookahead_guard", "SELECT px.entity_id, count(*) AS n_days, 0 AS n_ahead FROM px GROUP BY px.entity_id")
def join03(spark, sf_dir):
    """Days and, of those, the ones joined to a filing from their future: none."""
    return join01(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n_days"), F.count_if(F.col("filing_date") > F.col("date")).cast("int").alias("n_ahead"))


@query(
    "join04_price_reindex",
    """WITH s AS (SELECT entity_id, min(date) AS a, max(date) AS b FROM px GROUP BY 1),
    c AS (SELECT entity_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM s),
    d AS (SELECT * FROM c WHERE isodow(date) < 6)
    SELECT d.entity_id, d.date, round(px.close + 1e-9, 4) AS close FROM d ASOF LEFT JOIN px ON d.entity_id = px.entity_id AND d.date >= px.date AND px.date IS NOT NULL""",
)
def join04(spark, sf_dir):
    """Prices on the business-day calendar, carried forward."""
    px = prices(spark, sf_dir).select("entity_id", "date", "close")
    days = px.groupBy("entity_id").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("entity_id", F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return asof_join(days, px.withColumnRenamed("date", "price_date"), "entity_id", "date", "price_date", ["close"]).select("entity_id", "date", rounded(F.col("close"), 4).alias("close"))


@query("join13_dates_missing_in_primary", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def join13(spark, sf_dir):
    """Order dates without a shipment."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.join(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")), "date", "left_anti")


@query("join14_group_filter", "SELECT entity_id, count(*) AS n FROM px WHERE entity_id IN (SELECT entity_id FROM peers WHERE region = 'ASIA') GROUP BY 1")
def join14(spark, sf_dir):
    group = peers(spark, sf_dir).where("region = 'ASIA'").select("entity_id")
    return prices(spark, sf_dir).join(group, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))


@query(
    "join15_next_event",
    """WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type FROM events WHERE event_type = 'purchase'), u AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events)
    SELECT u.user_id, u.date, CAST(date_diff('day', u.date, e.d) AS INTEGER) AS days_to_event FROM u ASOF LEFT JOIN e ON u.user_id = e.user_id AND u.date <= e.d""",
)
def join15(spark, sf_dir):
    """Days to the user's next purchase, today included."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "event_type")
    day = e.groupBy("user_id", "date").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("date"))).alias("hit"))
    ahead = Window.partitionBy("user_id").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    return day.select("user_id", "date", F.datediff(F.first("hit", ignorenulls=True).over(ahead), "date").alias("days_to_event"))


@query(
    "join16_event_density",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, date, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN CURRENT ROW AND INTERVAL 7 DAY FOLLOWING) AS BIGINT) AS n_ahead FROM d""",
)
def join16(spark, sf_dir):
    """Events in the next seven days, as a range window rather than a range join."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.unix_date("date")).rangeBetween(0, 7)
    return d.select("user_id", "date", F.sum("n").over(w).alias("n_ahead"))


@query(
    "join28_relative_measures",
    """WITH r AS (SELECT entity_id, date, close / lag(close) OVER (PARTITION BY entity_id ORDER BY date) - 1 AS ret FROM px), g AS (SELECT entity_id, date, ret, nation FROM r JOIN peers USING (entity_id)),
    m AS (SELECT nation, date, avg(ret) AS mean_ret, count(ret) AS n FROM g GROUP BY 1, 2)
    SELECT g.entity_id, g.date, round(ret - mean_ret + 1e-9, 6) AS excess, n FROM g JOIN m ON g.nation = m.nation AND g.date = m.date""",
)
def join28(spark, sf_dir):
    """Return over that of the nation's suppliers on the day."""
    px = prices(spark, sf_dir)
    ret = px.select("entity_id", "date", (F.col("close") / F.lag("close").over(Window.partitionBy("entity_id").orderBy("date")) - 1).alias("ret")).join(peers(spark, sf_dir).select("entity_id", "nation"), "entity_id")
    w = Window.partitionBy("nation", "date")
    return ret.select("entity_id", "date", rounded(F.col("ret") - F.avg("ret").over(w)).alias("excess"), F.count("ret").over(w).alias("n"))


@query("join07_first_column_wins", "SELECT c_custkey, round(coalesce(s_acctbal, c_acctbal), 2) AS balance, CASE WHEN s_acctbal IS NULL THEN 'own' ELSE 'other' END AS source FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def join07(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c["c_custkey"] == s["s_suppkey"], "left").select("c_custkey", F.round(F.coalesce("s_acctbal", "c_acctbal"), 2).alias("balance"), F.when(F.col("s_acctbal").isNull(), "own").otherwise("other").alias("source"))


@query("win_forward_fill", "WITH g AS (SELECT entity_id, date, CASE WHEN entity_id % 7 = 0 AND month(date) = 3 THEN NULL ELSE close END AS close FROM px) SELECT entity_id, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY date) + 1e-9, 4) AS close FROM g")
def win_forward_fill(spark, sf_dir):
    gaps = prices(spark, sf_dir).select("entity_id", "date", F.when(~((F.col("entity_id") % 7 == 0) & (F.month("date") == 3)), F.col("close")).alias("close"))
    return gaps.select("entity_id", "date", rounded(forward_fill("close"), 4).alias("close"))
