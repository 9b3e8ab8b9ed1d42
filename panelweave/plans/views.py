"""Panel views of the tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open, high, low, close and volume per supplier."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("q"), F.struct(*LINE_ORDER).alias("k"))
    return rows.groupBy("entity_id", "date").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly flows per supplier with report and filing dates."""
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), quarter.alias("quarter"))
    out = rows.agg(F.round(F.sum("l_extendedprice") + 1e-6, 2).alias("revenue"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")) + 1e-6, 2).alias("net"), F.round(F.sum(F.expr("l_extendedprice * l_discount * l_tax")) + 1e-6, 2).alias("tax"))
    return out.select("entity_id", F.expr("add_months(quarter, 3) - interval 1 day").cast("date").alias("report_date"), F.expr("add_months(quarter, 3) + interval 44 days").cast("date").alias("filing_date"), "revenue", "net", "tax")


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("entity_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"))


PRICES = f"""px AS (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date, first(p ORDER BY {', '.join(LINE_ORDER)}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {', '.join(LINE_ORDER)}) AS close, sum(l_quantity) AS volume
 FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""
FILINGS = """filings AS (SELECT entity_id, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, CAST(q + INTERVAL 3 MONTH + INTERVAL 44 DAY AS DATE) AS filing_date, revenue, net, tax FROM
 (SELECT l_suppkey AS entity_id, date_trunc('quarter', l_shipdate) AS q, round(sum(l_extendedprice) + 1e-6, 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)) + 1e-6, 2) AS net, round(sum(l_extendedprice * l_discount * l_tax) + 1e-6, 2) AS tax FROM lineitem GROUP BY 1, 2))"""
PEERS = """peers AS (SELECT s_suppkey AS entity_id, n_name AS nation, r_name AS region, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def with_views(sql: str) -> str:
    """Puts the views that ``sql`` names before it."""
    from panelweave.plans.statements import DAY, FIN, MACRO

    known = {"day": (DAY, "px", "fin"), "fin": (FIN, "filings", "peers"), "macro": (MACRO,), "px": (PRICES,), "filings": (FILINGS,), "peers": (PEERS,)}
    wanted = {name for name in known if re.search(rf"\b(FROM|JOIN) {name}\b" if name in ("day", "fin", "macro") else name, sql)}
    for name in ("day", "fin"):
        wanted |= set(known[name][1:]) if name in wanted else set()
    used = [known[name][0] for name in ("px", "filings", "peers", "fin", "day", "macro") if name in wanted]
    head = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    return head + ", ".join(used) + (", " + sql[len(head) :] if sql.startswith("WITH ") else " " + sql) if used else sql
