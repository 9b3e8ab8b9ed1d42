"""What users plug in: walk-forward models as columns, weighted aggregates, functions of a trailing window, text to rows, SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.core import ordered, rounded, trailing
from panelweave.plans.views import prices, table
from panelweave.registry import query

Model = Callable[[Column], Column]


def walk_forward(df: DataFrame, x: str, models: dict[str, Model]) -> DataFrame:
    """Each day and model: what the model, a column of the values so far, says of the next one, and its error."""
    later = F.lead(x).over(ordered())
    out = df.select("entity_id", "date", later.alias("later"), *[f(F.col(x)).alias(f"m{k}") for k, f in enumerate(models.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"m{k}").alias("predicted")) for k, name in enumerate(models)]))
    return out.select("entity_id", "date", "later", rows.alias("r")).select("entity_id", "date", "r.model", "r.predicted", (F.col("r.predicted") - F.col("later")).alias("error"))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(F.when(x.isNotNull(), w))


def kish(w: Column) -> Column:
    """The effective sample size of weights."""
    return F.sum(w) * F.sum(w) / F.sum(w * w)


def hhi(w: Column) -> Column:
    return F.sum(w * w) / (F.sum(w) * F.sum(w))


def rolling(x: str, rows: int, of: Callable[[pd.Series], float]) -> Column:
    """Any function of the last ``rows`` values, which reach Python as Arrow batches of arrays."""

    @F.pandas_udf("double")
    def apply(windows: pd.Series) -> pd.Series:
        return windows.map(of)

    return apply(F.collect_list(x).over(trailing(rows)))


def text_rows(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """A row for each match of ``pattern``."""
    return df.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("item"))


def register_sql_functions(spark) -> None:
    """Makes ``panel_ratio(a, b)`` callable from SQL in this session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION panel_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN abs(b) >= 1e-9 THEN a / b END")


@query("udf01_pluggable_models", "WITH f AS (SELECT entity_id, date, close AS a, avg(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 4 PRECEDING) AS b, lead(close) OVER (PARTITION BY entity_id ORDER BY date) AS later FROM px) SELECT entity_id, date, model, round(CASE model WHEN 'last' THEN a ELSE b END + 1e-7, 3) AS predicted, round(CASE model WHEN 'last' THEN a ELSE b END - later + 1e-7, 3) AS error FROM f CROSS JOIN (VALUES ('last'), ('mean')) AS t(model)")
def udf01(spark, sf_dir):
    df = walk_forward(prices(spark, sf_dir), "close", {"last": lambda x: x, "mean": lambda x: F.avg(x).over(trailing(5))})
    return df.select("entity_id", "date", "model", F.round(F.col("predicted") + 1e-7, 3).alias("predicted"), F.round(F.col("error") + 1e-7, 3).alias("error"))


@query("udf03_weighted_aggregates", "SELECT l_suppkey AS entity_id, round(sum(l_quantity * l_discount) / sum(l_quantity) + 1e-9, 6) AS mean_discount, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity) + 1e-6, 3) AS effective_n, round(sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)) + 1e-11, 8) AS hhi FROM lineitem GROUP BY 1")
def udf03(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id")).agg(rounded(weighted_mean(F.col("l_discount"), q)).alias("mean_discount"), F.round(kish(q) + 1e-6, 3).alias("effective_n"), F.round(hhi(q) + 1e-11, 8).alias("hhi"))


@query("udf04_rolling_array", "SELECT entity_id, date, round(max(close) OVER w - min(close) OVER w + 1e-7, 4) AS span FROM px WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING)")
def udf04(spark, sf_dir):
    return prices(spark, sf_dir).select("entity_id", "date", F.round(rolling("close", 21, lambda x: float(max(x) - min(x))) + 1e-7, 4).alias("span"))


@query("udf05_text_to_rows", """SELECT page_id, item, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '[a-z]+="[^"<>]+"')) AS item FROM pages) GROUP BY 1, 2""")
def udf05(spark, sf_dir):
    return text_rows(table(spark, sf_dir, "pages"), "html", '[a-z]+="[^"<>]+"', "page_id").groupBy("page_id", "item").agg(F.count("*").alias("n"))


@query("scal22_segment_text", "SELECT page_id, regexp_extract(item, '^([A-Za-z]+)', 1) AS name, sum(CAST(regexp_extract(item, '([0-9]{1,9})$', 1) AS BIGINT)) AS revenue FROM (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z]+[^A-Za-z0-9<>]{1,3}[0-9]{1,9}')) AS item FROM pages) GROUP BY 1, 2")
def scal22(spark, sf_dir):
    """Lines of a page that read as a name and a number."""
    rows = text_rows(table(spark, sf_dir, "pages"), "html", "[A-Za-z]+[^A-Za-z0-9<>]{1,3}[0-9]{1,9}", "page_id")
    return rows.groupBy("page_id", F.regexp_extract("item", "^([A-Za-z]+)", 1).alias("name")).agg(F.sum(F.regexp_extract("item", "([0-9]{1,9})$", 1).cast("long")).alias("revenue"))


@query("udf06_sql_function", "SELECT o_custkey, round(sum(o_totalprice) / nullif(count(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) + 1e-7, 4) AS ratio FROM orders GROUP BY 1")
def udf06(spark, sf_dir):
    register_sql_functions(spark)
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("a"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("b"))
    return spark.sql("SELECT o_custkey, round(panel_ratio(a, b) + 1e-7, 4) AS ratio FROM {o}", o=o)
