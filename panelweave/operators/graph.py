"""Graph operators on edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.core import rounded
from panelweave.plans.views import table
from panelweave.registry import query
from panelweave.sources.files import scratch


def edges(spark, sf_dir) -> DataFrame:
    """Supplier to customer nation, weighted by sales: bounded fan-out per supplier."""
    li, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    sales = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return sales.groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


EDGES = "e AS (SELECT 's' || l_suppkey AS src, 'n' || c_nationkey AS dst, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("graph02_degree", f"WITH {EDGES}, d AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), n AS (SELECT count(DISTINCT node) AS n FROM d) SELECT node, count(*) AS degree, round(count(*) / (max(n) - 1) + 1e-9, 6) AS centrality FROM d, n GROUP BY 1")
def degree(spark, sf_dir):
    e = edges(spark, sf_dir)
    d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))  # one row
    return d.join(F.broadcast(n)).select("node", "degree", rounded(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


@query("graph05_weighted_exposure", f"WITH {EDGES}, s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM e) SELECT a.src, round(sum(a.share * 0.3) + 1e-9, 6) AS exposure FROM s a GROUP BY 1")
def exposure(spark, sf_dir):
    """Exposure of each supplier to a shock that reaches it through its customers' nations, by share of their purchases."""
    e = edges(spark, sf_dir)
    total = e.groupBy("dst").agg(F.sum("weight").alias("total"))
    return e.join(total, "dst").groupBy("src").agg(rounded(F.sum(F.col("weight") / F.col("total") * 0.3)).alias("exposure"))


@query("graph03_pagerank")
def pagerank(spark, sf_dir, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Ranks sum to one; dangling mass is spread evenly. Ends once a round changes the ranks by less than ``tol`` in all.

    Every fourth round is checkpointed and its change, one number, comes to the driver.
    """
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "ranks"))
    e = edges(spark, sf_dir)
    e = e.union(e.select("dst", "src", "weight")).toDF("src", "dst", "weight")
    e = e.join(e.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")).checkpoint()
    nodes = e.select(F.col("src").alias("node")).distinct().checkpoint()
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, rounds + 1):
        got = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got")).withColumnRenamed("dst", "node")
        last = k % 4 == 0
        known = ranks.withColumnRenamed("rank", "before") if last else nodes
        ranks = known.join(got, "node", "left").withColumn("rank", F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).drop("got")
        if last:
            ranks = ranks.checkpoint()
            change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
            ranks = ranks.drop("before")
            if change < tol:
                break
    return ranks
