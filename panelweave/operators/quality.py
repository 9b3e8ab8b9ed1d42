"""Data quality, reconciliation and missing data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded
from panelweave.plans.views import filings, table
from panelweave.registry import query


@query("dq01_lookahead_audit", "SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS known, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) > CAST(l_shipdate AS DATE)")
def dq01(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    known, date = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).where(known > date).select("l_orderkey", "l_linenumber", known.alias("known"), date.alias("date"))


@query("dq08_staleness", "SELECT entity_id, max(filing_date) AS newest, CAST(date_diff('day', max(filing_date), DATE '2001-12-31') AS INTEGER) AS age_days, date_diff('day', max(filing_date), DATE '2001-12-31') > 180 AS stale FROM filings GROUP BY 1")
def dq08(spark, sf_dir, at: str = "2001-12-31"):
    age = F.datediff(F.lit(at).cast("date"), F.max("filing_date"))
    return filings(spark, sf_dir).groupBy("entity_id").agg(F.max("filing_date").alias("newest"), age.alias("age_days"), (age > 180).alias("stale"))


@query("dq10_flow_reconciliation", "WITH q AS (SELECT entity_id, year(report_date) AS year, sum(revenue) AS quarters FROM filings GROUP BY 1, 2), y AS (SELECT l_suppkey AS entity_id, year(l_shipdate) AS year, sum(l_extendedprice) AS annual FROM lineitem GROUP BY 1, 2) SELECT entity_id, year, round(quarters / annual + 1e-9, 6) AS ratio, abs(quarters - annual) <= 0.05 * abs(annual) AS within FROM q JOIN y USING (entity_id, year)")
def dq10(spark, sf_dir):
    q = filings(spark, sf_dir).groupBy("entity_id", F.year("report_date").alias("year")).agg(F.sum("revenue").alias("quarters"))
    y = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("annual"))
    return q.join(y, ["entity_id", "year"]).select("entity_id", "year", rounded(F.col("quarters") / F.col("annual")).alias("ratio"), (F.abs(F.col("quarters") - F.col("annual")) <= 0.05 * F.abs("annual")).alias("within"))


@query("dq11_proportional_disaggregation", "WITH m AS (SELECT l_suppkey AS entity_id, year(l_shipdate) AS year, month(l_shipdate) AS month, sum(l_quantity) AS x, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT entity_id, year, month, round(x / sum(x) OVER w * sum(v) OVER w + 1e-9, 2) AS share FROM m WINDOW w AS (PARTITION BY entity_id, year)")
def dq11(spark, sf_dir):
    """An annual flow split by a monthly indicator."""
    w = Window.partitionBy("entity_id", "year")
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("v"))
    return m.select("entity_id", "year", "month", rounded(F.col("x") / F.sum("x").over(w) * F.sum("v").over(w), 2).alias("share"))


@query("dq14_identity_fill", "WITH g AS (SELECT entity_id, report_date, CASE WHEN entity_id % 3 <> 0 THEN revenue END AS revenue, CASE WHEN entity_id % 3 <> 1 THEN net END AS net, CASE WHEN entity_id % 3 <> 2 THEN revenue - net END AS cost FROM filings) SELECT entity_id, report_date, round(coalesce(revenue, net + cost) + 1e-9, 1) AS revenue, round(coalesce(net, revenue - cost) + 1e-9, 1) AS net, round(coalesce(cost, revenue - net) + 1e-9, 1) AS cost FROM g")
def dq14(spark, sf_dir):
    """revenue = net + cost: two known give the third; observed values stay."""
    g = filings(spark, sf_dir).select("entity_id", "report_date", F.expr("if(entity_id % 3 <> 0, revenue, null)").alias("revenue"), F.expr("if(entity_id % 3 <> 1, net, null)").alias("net"), F.expr("if(entity_id % 3 <> 2, revenue - net, null)").alias("cost"))
    return g.select("entity_id", "report_date", rounded(F.expr("coalesce(revenue, net + cost)"), 1).alias("revenue"), rounded(F.expr("coalesce(net, revenue - cost)"), 1).alias("net"), rounded(F.expr("coalesce(cost, revenue - net)"), 1).alias("cost"))


@query(
    "dq30_stock_interpolation",
    """WITH g AS (SELECT entity_id, report_date, CASE WHEN month(report_date) = 12 THEN revenue END AS x FROM filings),
    b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN report_date END) OVER p AS d0, last_value(x IGNORE NULLS) OVER p AS x0, min(CASE WHEN x IS NOT NULL THEN report_date END) OVER n AS d1, first_value(x IGNORE NULLS) OVER n AS x1 FROM g
     WINDOW p AS (PARTITION BY entity_id ORDER BY report_date), n AS (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT entity_id, report_date, round(CASE WHEN x IS NOT NULL THEN x WHEN d0 IS NULL THEN x1 WHEN d1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * date_diff('day', d0, report_date) / date_diff('day', d0, d1) END + 1e-9, 2) AS x FROM b""",
)
def dq30(spark, sf_dir):
    """Linear in time between observations, flat at the ends."""
    g = filings(spark, sf_dir).select("entity_id", "report_date", F.when(F.month("report_date") == 12, F.col("revenue")).alias("x"))
    base = ordered(order="report_date")
    p, n = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("x").isNotNull(), F.col("report_date"))
    b = g.select("*", F.max(seen).over(p).alias("d0"), F.last("x", True).over(p).alias("x0"), F.min(seen).over(n).alias("d1"), F.first("x", True).over(n).alias("x1"))
    return b.select("entity_id", "report_date", rounded(F.expr("case when x is not null then x when d0 is null then x1 when d1 is null then x0 else x0 + (x1 - x0) * datediff(report_date, d0) / datediff(d1, d0) end"), 2).alias("x"))


@query("dq21_disappearance", "WITH g AS (SELECT entity_id, report_date, CASE WHEN (entity_id + month(report_date)) % 5 <> 0 THEN revenue END AS x FROM filings) SELECT entity_id, report_date, CAST(x IS NULL AND count(x) OVER w >= 2 AS INTEGER) AS disappeared FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def dq21(spark, sf_dir):
    g = filings(spark, sf_dir).select("entity_id", "report_date", F.expr("if((entity_id + month(report_date)) % 5 <> 0, revenue, null)").alias("x"))
    return g.select("entity_id", "report_date", (F.col("x").isNull() & (F.count("x").over(ordered(order="report_date").rowsBetween(-4, -1)) >= 2)).cast("int").alias("disappeared"))


@query("dq28_pattern_means", "WITH g AS (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, nullif(c_mktsegment, 'BUILDING') AS b, c_acctbal FROM customer) SELECT CAST(a IS NULL AS INTEGER) || '' || CAST(b IS NULL AS INTEGER) AS pattern, count(*) AS n, round(avg(c_acctbal) + 1e-9, 4) AS mean FROM g GROUP BY 1")
def dq28(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select((~(F.col("c_acctbal") > 0)).cast("int").alias("a"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("b"), "c_acctbal")
    return g.groupBy(F.concat(F.col("a").cast("string"), F.col("b").cast("string")).alias("pattern")).agg(F.count("*").alias("n"), rounded(F.avg("c_acctbal"), 4).alias("mean"))
