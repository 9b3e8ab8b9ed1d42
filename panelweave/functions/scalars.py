"""Text, number and date parsers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.core import rounded
from panelweave.plans.views import table
from panelweave.registry import query

#: Sentiment words, a parameter of the score.
POSITIVE, NEGATIVE = ("the", "of", "and"), ("this", "that", "with")


def parse_number(c: Column) -> Column:
    """Text to double: thousands separators, parentheses or minus for negative, currency signs; dashes and the rest give null."""
    t = F.trim(c)
    bare = F.regexp_replace(t, r"[(),$€£%\s]", "")
    value = bare.try_cast("double")
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


@query("scal01_parse_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS value FROM orders")
def scal01(spark, sf_dir):
    """Prices written out in three ways and read back."""
    price = F.format_number(F.round("o_totalprice", 2), 2)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("-")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("($"), price, F.lit(")"))).otherwise(price)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_number(text).alias("value"))


@query("scal17_normalise_name", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '^the ', ''), ' (inc|corp|ltd|llc)\\.?$', '')) AS name FROM part")
def scal17(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), "^the ", ""), r" (inc|corp|ltd|llc)\.?$", "")).alias("name"))


@query("scal18_keyword_sentiment", "WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(text), '[ \\n]+')) AS words FROM documents), c AS (SELECT doc_id, len(list_intersect(words, ['the', 'of', 'and'])) AS pos, len(list_intersect(words, ['this', 'that', 'with'])) AS neg FROM w) SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(neg AS INTEGER) AS neg, round(CASE WHEN pos + neg = 0 THEN 0 ELSE (pos - neg) / (pos + neg) END, 6) AS score FROM c")
def scal18(spark, sf_dir):
    words = F.array_distinct(F.split(F.lower("text"), "[ \\n]+"))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    d = d.select("doc_id", *[F.size(F.array_intersect("w", F.array(*map(F.lit, x)))).alias(n) for n, x in (("pos", POSITIVE), ("neg", NEGATIVE))])
    return d.select("*", F.round(F.when(F.col("pos") + F.col("neg") == 0, 0.0).otherwise((F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))), 6).alias("score"))


@query("scal11_frequency_from_gap", "WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1, 2), g AS (SELECT o_custkey, date_diff('day', lag(date) OVER (PARTITION BY o_custkey ORDER BY date), date) AS gap FROM d) SELECT o_custkey, round(median(gap), 1) AS gap, CASE WHEN median(gap) < 120 THEN 'quarterly' WHEN median(gap) < 250 THEN 'semiannual' WHEN median(gap) < 500 THEN 'annual' ELSE 'unknown' END AS frequency FROM g GROUP BY 1")
def scal11(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date")).distinct()
    g = d.select("o_custkey", F.datediff("date", F.lag("date").over(Window.partitionBy("o_custkey").orderBy("date"))).alias("gap")).groupBy("o_custkey").agg(F.median("gap").alias("gap"))
    m = F.col("gap")
    return g.select("o_custkey", F.round("gap", 1).alias("gap"), F.when(m < 120, "quarterly").when(m < 250, "semiannual").when(m < 500, "annual").otherwise("unknown").alias("frequency"))


@query("scal33_pseudo_observations", "SELECT s_nationkey, s_suppkey, round(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) / (count(*) OVER (PARTITION BY s_nationkey) + 1) + 1e-9, 6) AS u FROM supplier")
def scal33(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", rounded(F.rank().over(w.orderBy("s_acctbal")) / (F.count("*").over(w) + 1)).alias("u"))


@query("scal_event_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
