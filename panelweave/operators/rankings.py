"""Ranks, top-k, de-duplication and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.core import rounded
from panelweave.operators.aggregates import YEARS, year_pairs
from panelweave.plans.views import filings, peers, prices, table
from panelweave.registry import query


@query("top01_keep_latest", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY 1, 2")
def top01(spark, sf_dir):
    """The latest order per customer and day: max_by combines before the shuffle, a window would not."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("date")).agg(F.max("o_orderkey").alias("o_orderkey"), F.round(F.max_by("o_totalprice", "o_orderkey"), 2).alias("o_totalprice"))


@query("top03_priority_pick", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey DESC) = 1")
def top03(spark, sf_dir):
    best = F.min_by(F.struct("o_orderkey", "o_orderpriority"), F.struct("o_orderpriority", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query("top09_sector_peers", "WITH k AS (SELECT nation, entity_id, balance, row_number() OVER (PARTITION BY nation ORDER BY balance DESC, entity_id) AS place FROM peers) SELECT nation, entity_id, round(balance, 2) AS balance, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5")
def top09(spark, sf_dir):
    w = Window.partitionBy("nation").orderBy(F.desc("balance"), "entity_id")
    return peers(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 5").select("nation", "entity_id", F.round("balance", 2).alias("balance"), "place")


@query("win60_peer_percentile", "SELECT nation, date, entity_id, round(100 * cume_dist() OVER (PARTITION BY nation, date ORDER BY close) + 1e-9, 6) AS percentile FROM px JOIN peers USING (entity_id) QUALIFY count(*) OVER (PARTITION BY nation, date) >= 2")
def win60(spark, sf_dir):
    w = Window.partitionBy("nation", "date")
    px = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id").withColumn("n", F.count("*").over(w))
    return px.select("nation", "date", "entity_id", rounded(100 * F.cume_dist().over(w.orderBy("close"))).alias("percentile"), "n").where("n >= 2").drop("n")


@query("win34_sector_rank", "SELECT nation, entity_id, report_date, CAST(rank() OVER (PARTITION BY nation, report_date ORDER BY revenue DESC) AS INTEGER) AS place FROM filings JOIN peers USING (entity_id)")
def win34(spark, sf_dir):
    w = Window.partitionBy("nation", "report_date").orderBy(F.desc("revenue"))
    return filings(spark, sf_dir).join(peers(spark, sf_dir), "entity_id").select("nation", "entity_id", "report_date", F.rank().over(w).alias("place"))


@query("set03_common_dates", "SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def set03(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).intersect(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate")))


@query("set04_new_and_gone", "WITH a AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey FROM lineitem WHERE year(l_shipdate) = 1998), b AS (SELECT DISTINCT l_suppkey AS entity_id, l_partkey FROM lineitem WHERE year(l_shipdate) = 1997) SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, count(*) FILTER (b.l_partkey IS NULL) AS n_new, count(*) FILTER (a.l_partkey IS NULL) AS n_gone FROM a FULL JOIN b ON a.entity_id = b.entity_id AND a.l_partkey = b.l_partkey GROUP BY 1")
def set04(spark, sf_dir):
    """One pass over both years instead of a full outer join of two scans."""
    pairs = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate").isin(1997, 1998)).groupBy(F.col("l_suppkey").alias("entity_id"), "l_partkey").agg(F.max(F.year("l_shipdate")).alias("b"), F.min(F.year("l_shipdate")).alias("a"))
    return pairs.groupBy("entity_id").agg(F.count_if(F.col("a") == 1998).alias("n_new"), F.count_if(F.col("b") == 1997).alias("n_gone"))


@query("set04_new_and_gone_by_year", f"WITH {YEARS} SELECT entity_id, year, count(*) FILTER (before = 0) AS n_new, count(*) FILTER (now = 0) AS n_gone FROM d, t WHERE year > a AND year <= b GROUP BY 1, 2")
def set04_by_year(spark, sf_dir):
    """Every year against the one before; set04_new_and_gone is its year 1998."""
    return year_pairs(spark, sf_dir).groupBy("entity_id", "year").agg(F.count_if(F.col("before") == 0).alias("n_new"), F.count_if(F.col("now") == 0).alias("n_gone"))


@query("set01_union_series", "SELECT 'order' AS kind, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'ship', CAST(l_shipdate AS DATE), count(*) FROM lineitem GROUP BY 2")
def set01(spark, sf_dir):
    count = lambda t, c, kind: table(spark, sf_dir, t).groupBy(F.to_date(c).alias("date")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "date", "n")
    return count("orders", "o_orderdate", "order").unionByName(count("lineitem", "l_shipdate", "ship"))
