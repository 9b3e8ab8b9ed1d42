"""Ratios, thresholds and scores as column expressions."""

from pyspark.sql import functions as F

from panelweave.core import asof_join, ordered, rounded, safe_ratio, trailing
from panelweave.plans.views import filings, peers, prices, table
from panelweave.registry import query


@query("proj01_safe_ratio", "SELECT entity_id, report_date, round(CASE WHEN abs(tax) >= 1e-9 THEN net / tax END + 1e-9, 4) AS net_to_tax, CAST(tax IS NULL OR net IS NULL OR abs(tax) < 1e-9 AS INTEGER) AS is_missing_net_to_tax, CAST(tax IS NULL OR abs(tax) < 1e-9 AS INTEGER) AS invalid_math_net_to_tax FROM filings")
def proj01(spark, sf_dir):
    ratio, missing, invalid = safe_ratio(F.col("net"), F.col("tax"), "net_to_tax")
    df = filings(spark, sf_dir).select("entity_id", "report_date", ratio, missing, invalid)
    return df.withColumn("net_to_tax", rounded(F.col("net_to_tax"), 4))


@query("proj02_missing_flags", "WITH g AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) SELECT *, CAST(balance IS NULL AS INTEGER) AS is_missing_balance, CAST(segment IS NULL AS INTEGER) AS is_missing_segment FROM g")
def proj02(spark, sf_dir):
    g = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return g.select("*", *[F.col(c).isNull().cast("int").alias(f"is_missing_{c}") for c in ("balance", "segment")])


@query("proj18_label_ladder", "SELECT s_suppkey, CASE WHEN s_acctbal >= 7500 THEN 'strong' WHEN s_acctbal >= 2500 THEN 'fair' WHEN s_acctbal >= 0 THEN 'weak' ELSE 'distressed' END AS label FROM supplier")
def proj18(spark, sf_dir):
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(b >= 7500, "strong").when(b >= 2500, "fair").when(b >= 0, "weak").otherwise("distressed").alias("label"))


@query("proj19_trapezoid", "SELECT p_partkey, round(CASE WHEN p_size <= 5 OR p_size >= 45 THEN 0.0 WHEN p_size < 15 THEN (p_size - 5) / 10.0 WHEN p_size <= 35 THEN 1.0 ELSE (45 - p_size) / 10.0 END, 4) AS membership FROM part")
def proj19(spark, sf_dir):
    x = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when((x <= 5) | (x >= 45), 0.0).when(x < 15, (x - 5) / 10.0).when(x <= 35, 1.0).otherwise((45 - x) / 10.0), 4).alias("membership"))


@query("proj20_piecewise_score", "WITH q AS (SELECT nation, quantile_cont(balance, 0.25) AS a, quantile_cont(balance, 0.5) AS b, quantile_cont(balance, 0.75) AS c FROM peers GROUP BY 1) SELECT entity_id, round(CASE WHEN balance <= a THEN 25 WHEN balance >= c THEN 75 WHEN balance < b THEN 25 + 25 * (balance - a) / (b - a) ELSE 50 + 25 * (balance - b) / nullif(c - b, 0) END + 1e-9, 4) AS score FROM peers JOIN q USING (nation)")
def proj20(spark, sf_dir):
    p = peers(spark, sf_dir)
    q = p.groupBy("nation").agg(*[F.percentile("balance", F.lit(v)).alias(k) for k, v in (("a", 0.25), ("b", 0.5), ("c", 0.75))])
    return p.join(q, "nation").select("entity_id", rounded(F.expr("case when balance <= a then 25d when balance >= c then 75d when balance < b then 25 + 25 * (balance - a) / (b - a) else 50 + 25 * (balance - b) / nullif(c - b, 0d) end"), 4).alias("score"))


@query(
    "sc_distress_flags",
    """WITH p AS (SELECT px.entity_id, px.date, close, f.filing_date, f.revenue, f.net FROM px ASOF LEFT JOIN filings f ON px.entity_id = f.entity_id AND px.date >= f.filing_date),
    d AS (SELECT *, close / max(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 251 PRECEDING) - 1 AS drawdown, net / revenue AS margin FROM p)
    SELECT entity_id, date, CAST(coalesce(drawdown < -0.4, false) AS INTEGER) AS deep_drawdown, CAST(coalesce(margin < 0.945, false) AS INTEGER) AS thin_margin, CAST(coalesce(date_diff('day', filing_date, date) > 80, false) AS INTEGER) AS stale_filing FROM d""",
)
def distress(spark, sf_dir):
    """Threshold flags on the point-in-time panel."""
    p = asof_join(prices(spark, sf_dir).select("entity_id", "date", "close"), filings(spark, sf_dir), "entity_id", "date", "filing_date", ["revenue", "net"])
    flag = lambda c, name: F.coalesce(c, F.lit(False)).cast("int").alias(name)
    p = p.withColumn("drawdown", F.col("close") / F.max("close").over(trailing(252)) - 1)
    return p.select("entity_id", "date", flag(F.col("drawdown") < -0.4, "deep_drawdown"), flag(F.col("net") / F.col("revenue") < 0.945, "thin_margin"), flag(F.datediff("date", "filing_date") > 80, "stale_filing"))


@query("win52_velocity", "SELECT entity_id, report_date, round((revenue - lag(revenue) OVER w) / nullif(abs(lag(revenue) OVER w), 0) + 1e-9, 6) AS velocity, CAST(coalesce((revenue - lag(revenue) OVER w) / nullif(abs(lag(revenue) OVER w), 0) < -0.3, false) AS INTEGER) AS falling FROM filings WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)")
def win52(spark, sf_dir):
    before = F.lag("revenue").over(ordered(order="report_date"))
    v = (F.col("revenue") - before) / F.nullif(F.abs(before), F.lit(0.0))
    return filings(spark, sf_dir).select("entity_id", "report_date", rounded(v).alias("velocity"), F.coalesce(v < -0.3, F.lit(False)).cast("int").alias("falling"))


@query("sc_srisk", "SELECT entity_id, round(greatest(0, 0.08 * revenue - 0.92 * net * 0.6) + 1e-9, 2) AS srisk FROM (SELECT entity_id, arg_max(revenue, report_date) AS revenue, arg_max(net, report_date) AS net FROM filings GROUP BY 1)")
def srisk(spark, sf_dir):
    last = filings(spark, sf_dir).groupBy("entity_id").agg(F.max_by("revenue", "report_date").alias("debt"), F.max_by("net", "report_date").alias("equity"))
    return last.select("entity_id", rounded(F.greatest(F.lit(0.0), 0.08 * F.col("debt") - 0.92 * F.col("equity") * 0.6), 2).alias("srisk"))
