"""Statement views: quarterly fields of every supplier, and the daily panel that knows them.

The tables hold no filings, so the fields are made from a supplier's shipments
and balance by fixed rules, with nulls and zeros where the operators must cope
with them. Each field is one expression that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.core import asof_join
from panelweave.plans.views import filings, peers, prices, table

#: Field -> expression, layer by layer: a layer may use what the layers before it made.
LAYERS: list[dict[str, str]] = [
    {
        "cost_of_revenue": "0.62 * net + 3 * tax",
        "sga_expenses": "0.11 * revenue + 0.01 * net",
        "research_and_development": "CASE WHEN entity_id % 4 <> 0 THEN 0.05 * net END",
        "depreciation": "0.03 * revenue",
        "interest_expense": "CASE WHEN entity_id % 5 = 0 THEN 0e0 ELSE tax END",
        "goodwill": "0.08 * net",
        "intangible_assets": "0.05 * net",
        "inventory": "0.15 * net + 2 * tax",
        "receivables": "CASE WHEN (entity_id + month(report_date)) % 9 <> 0 THEN 0.2 * revenue - 4 * tax END",
        "cash_and_equivalents": "CASE WHEN entity_id % 6 <> 0 THEN 3 * abs(balance) + 0.05 * net END",
        "current_liabilities": "0.3 * revenue + 0.05 * revenue * (entity_id % 7)",
        "short_term_debt": "CASE WHEN entity_id % 8 <> 0 THEN 0.1 * net END",
        "long_term_debt": "CASE WHEN entity_id % 8 > 1 THEN 0.5 * net + 5 * tax END",
        "ppe_net": "0.6 * net + 10 * abs(balance)",
        "capex": "-0.04 * revenue - tax",
        "shares_outstanding": "1e3 + 10 * entity_id + 5 * (year(report_date) - 1994)",
        "share_buybacks": "CASE WHEN entity_id % 7 = 0 THEN 0.02 * revenue ELSE 0e0 END",
        "accounts_payable": "0.12 * net",
    },
    {
        "gross_profit": "revenue - cost_of_revenue",
        "ebit": "revenue - cost_of_revenue - sga_expenses - coalesce(research_and_development, 0e0)",
        "current_assets": "coalesce(cash_and_equivalents, 0e0) + coalesce(receivables, 0e0) + inventory",
    },
    {
        "ebitda": "ebit + depreciation",
        "net_income": "0.79 * (ebit - interest_expense) - CASE WHEN entity_id % 11 = 0 THEN 0.25 * revenue ELSE 0e0 END",
        "total_assets": "current_assets + ppe_net + goodwill + intangible_assets",
        "total_liabilities": "current_liabilities + coalesce(long_term_debt, 0e0)",
    },
    {
        "operating_cash_flow": "net_income + depreciation - 0.05 * net * (entity_id % 5)",
        "total_equity": "total_assets - total_liabilities",
        "retained_earnings": "0.3 * total_assets - 0.2 * total_liabilities",
        "dividends_paid": "CASE WHEN entity_id % 3 = 0 THEN 0.3 * abs(net_income) ELSE 0e0 END",
    },
]
FIELDS = ["entity_id", "report_date", "filing_date", "revenue", *[x for layer in LAYERS for x in layer]]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and quarter with all fields."""
    balance = peers(spark, sf_dir).select("entity_id", "balance")
    df = filings(spark, sf_dir).join(balance, "entity_id")
    for layer in LAYERS:
        df = df.selectExpr("*", *[f"{e} AS {x}" for x, e in layer.items()])
    return df.select(*FIELDS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each day with the latest statement filed by then, and the market value."""
    df = asof_join(prices(spark, sf_dir), statements(spark, sf_dir), "entity_id", "date", "filing_date", [x for x in FIELDS if x not in ("entity_id", "filing_date")])
    return df.withColumn("market_cap", F.col("close") * F.col("shares_outstanding"))


#: Monthly indicators of a country, from the number n and the mean value v of the orders of its customers.
INDICATORS = {
    "gdp": "1e2 * n + v / 1e3",
    "inflation": "1e0 * (n % 5) + v / 1e6",
    "unemployment_rate": "3e0 + (n % 9) + v / 1e6",
    "credit_spread": "1e0 + (n % 6) + v / 1e6",
    "yield_long": "2e0 + 0.5 * (n % 5)",
    "yield_short": "1.5e0 + 0.6 * (n % 4)",
    "lending_rate": "2e0 + 0.8 * (n % 6)",
    "fx_volatility": "8e0 + (n % 14)",
    "spending": "6e1 * n + v / 2e3",
}


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per country and month."""
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"))
    months = orders.join(home, F.col("o_custkey") == F.col("c_custkey")).groupBy("country", F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"))
    df = months.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice") + 1e-6, 2).alias("v"))
    return df.selectExpr("country", "date", *[f"{e} AS {x}" for x, e in INDICATORS.items()])


def layered(source: str) -> str:
    sql = f"SELECT f.*, balance FROM {source} f JOIN peers USING (entity_id)"
    for layer in LAYERS:
        sql = f"SELECT *, {', '.join(f'{e} AS {x}' for x, e in layer.items())} FROM ({sql})"
    return sql


FIN = f"fin AS (SELECT {', '.join(FIELDS)} FROM ({layered('filings')}))"
DAY = f"day AS (SELECT *, close * shares_outstanding AS market_cap FROM (SELECT px.*, {', '.join('f.' + x for x in FIELDS if x != 'entity_id')} FROM px ASOF LEFT JOIN fin f ON px.entity_id = f.entity_id AND px.date >= f.filing_date))"
MACRO = f"macro AS (SELECT country, date, {', '.join(f'{e} AS {x}' for x, e in INDICATORS.items())} FROM (SELECT n_name AS country, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n, round(avg(o_totalprice) + 1e-6, 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2))"
