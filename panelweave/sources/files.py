"""Sources and sinks: calendars, CSV and JSON lines, partitioned Parquet."""

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.plans.views import filings, peers, prices, table
from panelweave.registry import query


def read_csv(spark, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep)


def read_json_lines(spark, path: str, schema: str) -> DataFrame:
    """One record per line; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_panel(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Panel rows by hashed entity, so that one entity is in one folder and folders stay few."""
    df.withColumn("entity_bucket", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("entity_bucket").parquet(path)


@query("src01_parquet_scan", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 40 GROUP BY 1")
def src01(spark, sf_dir):
    """Column pruning and a pushed filter, one partial aggregation before the shuffle."""
    return table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("src08_business_calendar", "WITH s AS (SELECT min(date) AS a, max(date) AS b FROM px), d AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM s) SELECT date FROM d WHERE isodow(date) < 6")
def src08(spark, sf_dir):
    span = prices(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)


@query("src11_yearly_last", "SELECT o_custkey, year(o_orderdate) AS year, round(arg_max(o_totalprice, o_orderkey), 2) AS value FROM orders GROUP BY 1, 2")
def src11(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.max_by("o_totalprice", "o_orderkey"), 2).alias("value"))


def scratch(spark, label: str) -> str:
    """A new path in the folder that driver and executors share; only where all runs in one process, in one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from a new path that it is written to, so that many passes make it once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


EVENTS = "event_id long, user_id long, event_type string, value double"


@query("src02_csv_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def src02(spark, sf_dir):
    """Events written as CSV with a header and ``;``, and read back by a schema."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.csv(path, header=True, sep=";")
    return read_csv(spark, path, EVENTS, ";")


@query("src03_json_lines_round_trip", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def src03(spark, sf_dir):
    """Events written as lines of JSON, every tenth one broken, and read back without the broken ones."""
    path = scratch(spark, "lines")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    e.select(F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": 1, broken')).otherwise(F.to_json(F.struct("*")))).write.text(path)
    return read_json_lines(spark, path, EVENTS)


@query("src04_panel_sink", "SELECT entity_id, count(*) AS n, round(sum(volume) + 1e-6, 3) AS volume FROM px GROUP BY 1")
def src04(spark, sf_dir):
    path = scratch(spark, "panel")
    write_panel(prices(spark, sf_dir), path, 8)
    return spark.read.parquet(path).groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum("volume") + 1e-6, 3).alias("volume"))


@query("src05_aggregates_sink", "SELECT region, date, count(*) AS n, round(avg(close) + 1e-7, 4) AS mean_close FROM px JOIN peers USING (entity_id) GROUP BY 1, 2")
def src05(spark, sf_dir):
    path = scratch(spark, "aggregates")
    groups = prices(spark, sf_dir).join(peers(spark, sf_dir), "entity_id").groupBy("region", "date").agg(F.count("*").alias("n"), F.round(F.avg("close") + 1e-7, 4).alias("mean_close"))
    groups.write.mode("overwrite").partitionBy("region").parquet(path)
    return spark.read.parquet(path)


@query("src06_predictions_sink", "WITH l AS (SELECT entity_id, arg_max(close, date) AS close, max(date) AS run_date FROM px GROUP BY 1) SELECT entity_id, run_date, horizon, round(close * (1 - 0.01 * sqrt(horizon)) + 1e-7, 4) AS low, round(close + 1e-7, 4) AS point, round(close * (1 + 0.01 * sqrt(horizon)) + 1e-7, 4) AS high FROM l CROSS JOIN (VALUES (1), (5), (21)) AS t(horizon)")
def src06(spark, sf_dir):
    """A long table of bounds by horizon, and beside it a summary as lines of JSON."""
    path = scratch(spark, "predictions")
    last = prices(spark, sf_dir).groupBy("entity_id").agg(F.max_by("close", "date").alias("close"), F.max("date").alias("run_date"))
    long = last.withColumn("horizon", F.explode(F.array(*map(F.lit, (1, 5, 21)))))
    bound = lambda c: F.round(c + 1e-7, 4)
    width, close = 0.01 * F.sqrt("horizon"), F.col("close")
    long.select("entity_id", "run_date", "horizon", bound(close * (1 - width)).alias("low"), bound(close).alias("point"), bound(close * (1 + width)).alias("high")).write.parquet(f"{path}/table")
    spark.read.parquet(f"{path}/table").groupBy("horizon").agg(F.count("*").alias("n")).select(F.to_json(F.struct("*"))).write.text(f"{path}/summary")
    return spark.read.parquet(f"{path}/table")


@query("src07_quality_report_sink", "SELECT entity_id, count(*) AS n_filings, sum(CASE WHEN filing_date < report_date THEN 1 ELSE 0 END) AS n_ahead FROM filings GROUP BY 1")
def src07(spark, sf_dir):
    path = scratch(spark, "report")
    filings(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n_filings"), F.count_if(F.col("filing_date") < F.col("report_date")).alias("n_ahead")).write.json(path)
    return spark.read.schema("entity_id long, n_filings long, n_ahead long").json(path)
