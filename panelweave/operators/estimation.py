"""Missing and doubtful data: audits, repairs, identities, imputation by regression, frequencies and proxies."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.survival import DEBT
from panelweave.registry import query
from panelweave.sources.files import written
from panelweave.sqlops import rounded, select, sql_query

W = "(PARTITION BY entity_id ORDER BY date)"
WQ = "(PARTITION BY entity_id ORDER BY report_date)"
GAPPY = "g AS (SELECT * FROM {fin_gaps})"
FLAGS = "f AS (SELECT * FROM {fin_flagged})"
MISSING = "SELECT entity_id, column_name, sum(CASE WHEN flag <> absent THEN 1 ELSE 0 END) AS wrong FROM (SELECT entity_id, 'revenue' AS column_name, is_missing_revenue AS flag, CAST(revenue IS NULL AS INT) AS absent FROM f UNION ALL SELECT entity_id, 'capex', is_missing_capex, CAST(capex IS NULL AS INT) FROM f) u GROUP BY entity_id, column_name"
INVALID = "SELECT entity_id, column_name, sum(CASE WHEN flag = 1 AND there = 1 THEN 1 ELSE 0 END) AS wrong FROM (SELECT entity_id, 'revenue' AS column_name, invalid_math_revenue AS flag, CAST(revenue IS NOT NULL AS INT) AS there FROM f UNION ALL SELECT entity_id, 'capex', invalid_math_capex, CAST(capex IS NOT NULL AS INT) FROM f) u GROUP BY entity_id, column_name"
AHEAD = "SELECT entity_id, 'report_date' AS column_name, sum(CASE WHEN report_date > filing_date THEN 1 ELSE 0 END) AS wrong FROM f GROUP BY entity_id"
sql_query("dq02_missing_flag_audit", f"WITH {FLAGS}, a AS ({MISSING}) SELECT entity_id, column_name, CAST(wrong AS BIGINT) AS wrong FROM a")
sql_query("dq03_invalid_math_audit", f"WITH {FLAGS}, a AS ({INVALID}) SELECT entity_id, column_name, CAST(wrong AS BIGINT) AS wrong FROM a")
RUN = f"{FLAGS}, m AS ({MISSING}), i AS ({INVALID}), l AS ({AHEAD}), a AS (SELECT 'missing_flag' AS test, * FROM m UNION ALL SELECT 'invalid_math', * FROM i UNION ALL SELECT 'look_ahead', * FROM l)"
sql_query("dq04_quality_run", f"WITH {RUN} SELECT test, column_name, CAST(sum(wrong) AS BIGINT) AS wrong, CASE WHEN sum(wrong) = 0 THEN 'pass' WHEN test = 'look_ahead' THEN 'error' ELSE 'warning' END AS status FROM a GROUP BY test, column_name")
sql_query("dq05_quality_by_entity", f"WITH {RUN} SELECT entity_id, count(*) AS n_checks, CAST(sum(CASE WHEN wrong > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(wrong) AS BIGINT) AS n_wrong FROM a GROUP BY entity_id")
# A filing date before its report date is set to the day after it.
REPAIRED = "SELECT entity_id, report_date, CASE WHEN filing_date < report_date THEN CAST(report_date + INTERVAL 1 DAY AS DATE) ELSE filing_date END AS filing_date, CAST(filing_date < report_date AS INT) AS repaired, revenue FROM"
sql_query("dq07_filing_date_repair", f"WITH rp AS ({REPAIRED} {{fin_misdated}}) SELECT entity_id, report_date, filing_date, repaired FROM rp")
AMENDED = f"am AS ({REPAIRED} {{fin_amended}})"
sql_query("top02_duplicate_filings", f"WITH {AMENDED}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, report_date ORDER BY filing_date DESC) AS place FROM am) SELECT entity_id, report_date, filing_date, {rounded({'revenue': 'revenue'}, 3)} FROM k WHERE place = 1")
sql_query("top01_restatements", f"WITH {AMENDED}, k AS (SELECT *, row_number() OVER w AS place, lead(revenue) OVER w AS before FROM am WINDOW w AS (PARTITION BY entity_id, report_date ORDER BY filing_date DESC)) SELECT entity_id, report_date, filing_date, CAST(coalesce(abs(RAT(revenue - before, before)) > 0.1, false) AS INT) AS restated FROM k WHERE place = 1")
sql_query("dq09_statement_reconciliation", f"WITH {AMENDED}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, report_date ORDER BY filing_date DESC) AS place FROM am), s AS (SELECT entity_id, count(*) AS n_filings, CAST(sum(repaired) AS BIGINT) AS n_repaired, max(filing_date) AS newest FROM k WHERE place = 1 GROUP BY entity_id) SELECT *, CAST(DAYS(newest, CAST('2002-06-30' AS DATE)) > 180 AS INT) AS stale FROM s")
sql_query("dq12_stock_benchmarking", f"WITH a AS (SELECT entity_id, year(report_date) AS year, max_by(inventory, report_date) * 1.04 AS annual, max_by(inventory, report_date) AS last FROM {{fin}} GROUP BY entity_id, year(report_date)) SELECT f.entity_id, f.report_date, {rounded({'inventory': 'f.inventory * RAT(a.annual, a.last)'}, 3)} FROM {{fin}} f JOIN a ON a.entity_id = f.entity_id AND a.year = year(f.report_date)")
sql_query("dq13_revenue_ratio_scaling", f"WITH a AS (SELECT entity_id, year(report_date) AS year, sum(revenue) AS revenue, sum(sga_expenses) AS sga FROM {{fin}} GROUP BY entity_id, year(report_date)) SELECT f.entity_id, f.report_date, {rounded({'sga_scaled': 'a.sga * RAT(f.revenue, a.revenue)'}, 3)} FROM {{fin}} f JOIN a ON a.entity_id = f.entity_id AND a.year = year(f.report_date)")
# Two passes over the identities: what the first fills can serve the second. Observed values stay.
IDENTITY = "coalesce(revenue, gross_profit + cost_of_revenue) AS revenue, coalesce(cost_of_revenue, revenue - gross_profit) AS cost_of_revenue, coalesce(gross_profit, revenue - cost_of_revenue) AS gross_profit, coalesce(total_assets, total_liabilities + total_equity) AS total_assets, coalesce(total_liabilities, total_assets - total_equity) AS total_liabilities, coalesce(total_equity, total_assets - total_liabilities) AS total_equity, operating_cash_flow, capex"
FILLED = f"{GAPPY}, p1 AS (SELECT entity_id, report_date, {IDENTITY}, operating_cash_flow - abs(capex) AS free_cash_flow FROM g), p2 AS (SELECT entity_id, report_date, {IDENTITY}, coalesce(free_cash_flow, operating_cash_flow - abs(capex)) AS free_cash_flow FROM p1)"
FIELDS = ["revenue", "cost_of_revenue", "gross_profit", "total_assets", "total_liabilities", "total_equity"]
sql_query("dq14_identity_fill_all", f"WITH {FILLED} SELECT entity_id, report_date, {rounded({x: x for x in (*FIELDS, 'free_cash_flow')}, 3)} FROM p2")
sql_query("dq15_one_identity", f"WITH {GAPPY} SELECT entity_id, report_date, {rounded({'total_equity': 'coalesce(total_equity, total_assets - total_liabilities)'}, 3)}, CASE WHEN total_equity IS NOT NULL THEN 'observed' WHEN total_assets IS NOT NULL AND total_liabilities IS NOT NULL THEN 'identity' ELSE 'missing' END AS source FROM g")
# What identities leave open is predicted from past rows alone: a regression on total assets over the rows before.
IMPUTED = f"{FILLED}, o AS (SELECT g.entity_id, g.report_date, g.revenue AS observed, p2.revenue AS by_identity, p2.total_assets AS x FROM g JOIN p2 ON p2.entity_id = g.entity_id AND p2.report_date = g.report_date), m AS (SELECT *, CASE WHEN count(observed) OVER w >= 4 THEN regr_intercept(observed, x) OVER w + regr_slope(observed, x) OVER w * x END AS by_regression, avg(observed) OVER w AS by_mean, regr_r2(observed, x) OVER w AS r2 FROM o WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
sql_query("dq17_regression_imputer", f"WITH {IMPUTED} SELECT entity_id, report_date, {rounded({'predicted': 'by_regression'}, 2)}, {rounded({'confidence': 'CASE WHEN by_regression IS NOT NULL THEN greatest(0.1e0, least(0.9e0, r2)) END'}, 4)} FROM m WHERE observed IS NULL")
SOURCE = "CASE WHEN observed IS NOT NULL THEN 'observed' WHEN by_identity IS NOT NULL THEN 'identity' WHEN by_regression IS NOT NULL THEN 'regression' WHEN by_mean IS NOT NULL THEN 'mean' ELSE 'missing' END"
CONFIDENCE = "CASE WHEN observed IS NOT NULL THEN 1e0 WHEN by_identity IS NOT NULL THEN 0.95e0 WHEN by_regression IS NOT NULL THEN greatest(0.1e0, least(0.9e0, r2)) WHEN by_mean IS NOT NULL THEN 0.3e0 ELSE 0e0 END"
sql_query("dq16_estimation_columns", f"WITH {IMPUTED} SELECT entity_id, report_date, {rounded({'revenue_observed': 'observed', 'revenue_estimated': 'CASE WHEN observed IS NULL THEN coalesce(by_identity, by_regression, by_mean) END', 'revenue_final': 'coalesce(observed, by_identity, by_regression, by_mean)'}, 2)}, {SOURCE} AS revenue_source, {rounded({'revenue_confidence': CONFIDENCE}, 4)} FROM m")
sql_query("dq18_estimation_run", f"WITH {IMPUTED} SELECT {SOURCE} AS source, count(*) AS n, {rounded({'share': 'count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)'})} FROM m GROUP BY {SOURCE}")
sql_query("dq49_estimation_coverage", f"WITH {IMPUTED} SELECT entity_id, count(*) AS n, count(observed) AS n_observed, count(coalesce(observed, by_identity, by_regression, by_mean)) AS n_final, {rounded({'coverage_before': 'count(observed) / CAST(count(*) AS DOUBLE)', 'coverage_after': 'count(coalesce(observed, by_identity, by_regression, by_mean)) / CAST(count(*) AS DOUBLE)'})} FROM m GROUP BY entity_id")
sql_query("dq26_estimate_blend", f"WITH {IMPUTED} SELECT entity_id, report_date, {rounded({'blended': '(coalesce(0.5 * by_regression, 0e0) + coalesce(0.3 * by_mean, 0e0)) / nullif(CASE WHEN by_regression IS NOT NULL THEN 0.5e0 ELSE 0e0 END + CASE WHEN by_mean IS NOT NULL THEN 0.3e0 ELSE 0e0 END, 0e0)'}, 2)} FROM m WHERE observed IS NULL")
CLASSES = f"{GAPPY}, k AS (SELECT entity_id, report_date, revenue, gross_profit, count(revenue) OVER b AS seen, count(*) OVER b AS n, avg(gross_profit) OVER b AS mean, stddev_samp(gross_profit) OVER b AS sd FROM g WINDOW b AS (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), cl AS (SELECT *, CASE WHEN revenue IS NOT NULL THEN 'observed' WHEN gross_profit > mean + 1.5 * sd THEN 'MNAR' WHEN n >= 4 AND seen * 2 >= n THEN 'MAR' ELSE 'MCAR' END AS class FROM k)"
sql_query("dq20_missingness_classes", f"WITH {CLASSES} SELECT entity_id, report_date, class FROM cl")
sql_query("dq19_split_routing", f"WITH {CLASSES}, r AS (SELECT *, avg(revenue) OVER (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS near FROM cl) SELECT entity_id, report_date, class, {rounded({"revenue": "CASE class WHEN 'observed' THEN revenue WHEN 'MNAR' THEN near * 0.9 ELSE near END"}, 2)} FROM r")
sql_query("dq22_suspicious_aggregation", f"WITH {CLASSES} SELECT entity_id, report_date, CAST(revenue IS NULL AND coalesce(gross_profit > mean + 1.5 * sd, false) AS INT) AS suspicious FROM cl")
sql_query("dq23_peer_coverage", f"WITH {GAPPY} SELECT p.region, {rounded({x: f'count(g.{x}) / CAST(count(*) AS DOUBLE)' for x in FIELDS})} FROM g JOIN {{peers}} p ON p.entity_id = g.entity_id GROUP BY p.region")
sql_query("dq29_sensitivity_bounds", f"WITH {GAPPY}, q AS (SELECT entity_id, percentile_cont(0.1) WITHIN GROUP (ORDER BY revenue) AS low, percentile_cont(0.9) WITHIN GROUP (ORDER BY revenue) AS high, avg(revenue) AS mean, count(*) AS n, count(revenue) AS seen FROM g GROUP BY entity_id) SELECT entity_id, {rounded({'pessimistic_mean': '(seen * mean + (n - seen) * low) / n', 'optimistic_mean': '(seen * mean + (n - seen) * high) / n', 'tipping_shift': 'CASE WHEN n > seen THEN (mean - low) / mean END'}, 3)} FROM q")
# A quarter's flow spread over its trading days; the last rate goes on after the last filing.
sql_query("dq31_flow_distribution", f"WITH d AS (SELECT entity_id, date, CAST(date_trunc('quarter', date) AS DATE) AS quarter FROM {{px}}), n AS (SELECT entity_id, quarter, count(*) AS days FROM d GROUP BY entity_id, quarter), f AS (SELECT entity_id, CAST(date_trunc('quarter', report_date) AS DATE) AS quarter, CASE WHEN report_date < CAST('2001-01-01' AS DATE) THEN revenue END AS revenue FROM {{fin}}), r AS (SELECT d.entity_id, d.date, f.revenue / n.days AS rate FROM d JOIN n ON n.entity_id = d.entity_id AND n.quarter = d.quarter LEFT JOIN f ON f.entity_id = d.entity_id AND f.quarter = d.quarter) SELECT entity_id, date, {rounded({'revenue_per_day': 'LASTSEEN(rate) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'}, 3)} FROM r")
NEAR = "nb AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN date END) OVER p AS d0, LASTSEEN(x) OVER p AS x0, min(CASE WHEN x IS NOT NULL THEN date END) OVER n AS d1, min_by(x, date) FILTER (WHERE x IS NOT NULL) OVER n AS x1 FROM s WINDOW p AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
LINEAR = "CASE WHEN d0 IS NULL THEN x1 WHEN d1 IS NULL THEN x0 WHEN d0 = d1 THEN x0 ELSE x0 + (x1 - x0) * DAYS(d0, date) / DAYS(d0, d1) END"
STOCK = "s AS (SELECT DISTINCT x.entity_id, x.date, f.x FROM (SELECT entity_id, date FROM {px} UNION SELECT entity_id, report_date FROM {fin}) x LEFT JOIN (SELECT entity_id, report_date, inventory AS x FROM {fin}) f ON f.entity_id = x.entity_id AND f.report_date = x.date)"
NEARBY = NEAR.replace("min_by(x, date) FILTER (WHERE x IS NOT NULL) OVER n AS x1", "NEXTSEEN(x) OVER n AS x1")
sql_query("dq48_daily_interpolation", f"WITH {STOCK}, {NEARBY} SELECT entity_id, date, {rounded({'inventory': LINEAR}, 3)} FROM nb")
sql_query("dq33_interpolation_confidence", f"WITH {STOCK}, {NEARBY} SELECT entity_id, date, {rounded({'confidence': 'greatest(0.1e0, least(0.95e0, 0.95 * greatest(0.3e0, 1 - least(coalesce(DAYS(d0, date), 400), coalesce(DAYS(date, d1), 400)) / 180e0)))'}, 5)} FROM nb")
sql_query("dq32_interpolate_monthly", f"WITH {STOCK}, {NEARBY}, m AS (SELECT entity_id, MONTH_OF(date) AS month, max_by({LINEAR}, date) AS x FROM nb GROUP BY entity_id, MONTH_OF(date)) SELECT entity_id, month, {rounded({'inventory': 'x'}, 3)} FROM m")
FLOWS = ["revenue", "net_income", "operating_cash_flow", "capex", "ebit", "dividends_paid"]
STOCKS = ["total_assets", "total_equity", "inventory", "receivables", "cash_and_equivalents", "goodwill"]
sql_query("dq34_stock_flow_class", f"SELECT p_partkey % 12 AS k, min(name) AS name, min(CASE WHEN name IN ({', '.join(repr(x) for x in FLOWS)}) THEN 'flow' WHEN name IN ({', '.join(repr(x) for x in STOCKS)}) THEN 'stock' ELSE 'unknown' END) AS class, count(*) AS n FROM {{part}} JOIN (VALUES {', '.join(f'({k}, {n!r})' for k, n in enumerate([*FLOWS, *STOCKS[:5], 'other']))}) AS t(id, name) ON p_partkey % 12 = id GROUP BY p_partkey % 12")
# Suppliers that trade on few days stand for private companies.
PRIVATE = "pc AS (SELECT p.entity_id, count(x.close) AS n_prices, CAST(count(x.close) < 520 AS INT) AS is_private FROM {peers} p LEFT JOIN {px} x ON x.entity_id = p.entity_id GROUP BY p.entity_id)"
sql_query("dq35_private_detection", f"WITH {PRIVATE} SELECT entity_id, n_prices, is_private FROM pc")
PROXIES = f"pr AS (SELECT entity_id, report_date, total_equity AS equity_value, RAT(total_equity - lag(total_equity) OVER {WQ}, abs(lag(total_equity) OVER {WQ})) AS equity_return, RAT(total_equity, max(total_equity) OVER (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS equity_drawdown FROM {{fin}}), pv AS (SELECT *, CASE WHEN count(equity_return) OVER w >= 3 THEN stddev_samp(equity_return) OVER w END AS financial_volatility FROM pr WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS 7 PRECEDING))"
sql_query("dq36_private_proxies", f"WITH {PROXIES} SELECT entity_id, report_date, {rounded({'equity_value': 'equity_value'}, 2)}, {rounded({x: x for x in ('equity_return', 'equity_drawdown', 'financial_volatility')})} FROM pv")
sql_query("dq37_proxy_resolve", f"WITH {PRIVATE}, {PROXIES}, q AS (SELECT entity_id, CAST(date_trunc('quarter', date) AS DATE) AS quarter, max_by(close, date) AS close FROM {{px}} GROUP BY entity_id, CAST(date_trunc('quarter', date) AS DATE)) SELECT pv.entity_id, pv.report_date, CASE WHEN is_private = 1 THEN 'proxy' ELSE 'market' END AS source, {rounded({'close': 'CASE WHEN is_private = 1 THEN equity_value ELSE close END'}, 2)} FROM pv JOIN pc ON pc.entity_id = pv.entity_id LEFT JOIN q ON q.entity_id = pv.entity_id AND q.quarter = CAST(date_trunc('quarter', pv.report_date) AS DATE)")
DIV = "dv AS (SELECT entity_id, report_date, dividends_paid AS d, lag(dividends_paid) OVER (PARTITION BY entity_id ORDER BY report_date) AS d0, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {fin} WHERE dividends_paid > 0)"
sql_query("dq38_dividend_cagr", f"WITH {DIV} SELECT entity_id, {rounded({'cagr': 'CASE WHEN count(*) > 1 AND min_by(d, report_date) > 0 THEN pow(max_by(d, report_date) / min_by(d, report_date), 365.25e0 / greatest(DAYS(min(report_date), max(report_date)), 1)) - 1 END'})} FROM dv GROUP BY entity_id")
sql_query("dq39_dividend_stability", f"WITH {DIV}, g AS (SELECT entity_id, d / d0 - 1 AS growth, exp(-back / 8e0) AS w FROM dv WHERE d0 > 0), a AS (SELECT entity_id, count(*) AS n, sum(CASE WHEN growth >= -0.001 THEN w ELSE 0e0 END) / sum(w) AS up, sum(w * growth) / sum(w) AS mean, sum(w * growth * growth) / sum(w) AS square FROM g GROUP BY entity_id) SELECT entity_id, {rounded({'stability': 'CASE WHEN n < 3 THEN 0.5e0 ELSE 0.6 * up + 0.4 * greatest(0e0, 1 - sqrt(greatest(0e0, square - mean * mean)) / 0.10) END'})} FROM a")
sql_query("dq40_implied_earnings", f"SELECT entity_id, report_date, {rounded({'implied_earnings': '(dividends_paid + share_buybacks) / 0.35', 'implied_payout_gap': 'RAT((dividends_paid + share_buybacks) / 0.35, net_income) - 1'}, 4)} FROM {{fin}} WHERE dividends_paid + share_buybacks > 0")
sql_query("dq41_payment_frequency", f"WITH {DIV}, y AS (SELECT entity_id, year(report_date) AS year, count(*) AS n FROM dv GROUP BY entity_id, year(report_date)), m AS (SELECT entity_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(n AS DOUBLE)) AS n FROM y GROUP BY entity_id) SELECT entity_id, n AS per_year, CASE WHEN n >= 11 THEN 'monthly' WHEN n >= 3.5 THEN 'quarterly' WHEN n >= 1.5 THEN 'semiannual' ELSE 'annual' END AS frequency FROM m")
sql_query("dq42_dupont_fields", f"WITH f AS (SELECT f.*, p.region FROM {{fin}} f JOIN {{peers}} p ON p.entity_id = f.entity_id), s AS (SELECT region, avg(RAT(net_income, revenue)) AS margin, avg(RAT(revenue, total_assets)) AS turnover, avg(RAT(total_assets, total_equity)) AS multiplier FROM f GROUP BY region) SELECT f.entity_id, f.report_date, {rounded({'revenue_implied': 'RAT(net_income, margin)', 'assets_implied': 'RAT(RAT(net_income, margin), turnover)', 'equity_implied': 'RAT(RAT(RAT(net_income, margin), turnover), multiplier)'}, 2)} FROM f JOIN s ON s.region = f.region")
sql_query("dq43_lintner", f"WITH {DIV}, m AS (SELECT entity_id, count(*) AS n, regr_slope(d - d0, d0) AS slope, regr_intercept(d - d0, d0) AS base FROM dv WHERE d0 IS NOT NULL GROUP BY entity_id) SELECT entity_id, n, {rounded({'speed': '-slope', 'implied_target': 'RAT(base, -slope)'}, 4)} FROM m")
sql_query("dq44_pe_regression", f"WITH q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM {{day}}), u AS (SELECT entity_id, RAT(close * shares_outstanding, 4 * net_income) AS pe, RAT(4 * dividends_paid, market_cap) AS yield FROM q WHERE back = 1), m AS (SELECT regr_slope(pe, yield) AS slope, regr_intercept(pe, yield) AS base FROM u) SELECT entity_id, {rounded({'pe': 'pe', 'pe_fitted': 'base + slope * yield'}, 4)} FROM u CROSS JOIN m")
sql_query("dq46_mar_bundle", f"WITH {CLASSES}, r AS (SELECT *, avg(revenue) OVER (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS near, avg(revenue) OVER (PARTITION BY entity_id ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM cl) SELECT entity_id, report_date, {rounded({'blended': '0.6 * near + 0.4 * far'}, 2)} FROM r WHERE class = 'MAR'")
sql_query("dq47_mnar_bundle", f"WITH {CLASSES}, b AS (SELECT entity_id, percentile_cont(0.1) WITHIN GROUP (ORDER BY revenue) AS low, percentile_cont(0.9) WITHIN GROUP (ORDER BY revenue) AS high, avg(revenue) AS mean FROM cl GROUP BY entity_id) SELECT cl.entity_id, cl.report_date, {rounded({'low': 'b.low', 'middle': 'b.mean', 'high': 'b.high'}, 2)} FROM cl JOIN b ON b.entity_id = cl.entity_id WHERE class = 'MNAR'")
PROXY = "px2 AS (SELECT entity_id, report_date, RAT(dividends_paid, revenue) AS dividend, RAT(share_buybacks, revenue) AS buyback, RAT(cash_and_equivalents, current_liabilities) AS liquidity FROM {fin})"
sql_query("dq50_proxy_bundle", f"WITH {PROXY} SELECT entity_id, report_date, {rounded({'dividend_proxy': 'dividend', 'buyback_proxy': 'buyback', 'liquidity_proxy': 'liquidity', 'confidence': '0.4 * CASE WHEN dividend > 0 THEN 1 ELSE 0.5 END + 0.3 * CASE WHEN buyback > 0 THEN 1 ELSE 0.5 END + 0.3 * CASE WHEN liquidity IS NOT NULL THEN 1 ELSE 0 END'}, 5)} FROM px2")
sql_query("dq51_proxy_tier_scores", f"WITH {PROXY}, b AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY liquidity) AS a, percentile_cont(0.5) WITHIN GROUP (ORDER BY liquidity) AS m, percentile_cont(0.75) WITHIN GROUP (ORDER BY liquidity) AS z FROM px2) SELECT entity_id, report_date, CASE WHEN liquidity IS NULL THEN NULL WHEN liquidity >= z THEN 85e0 WHEN liquidity >= m THEN 65e0 WHEN liquidity >= a THEN 40e0 ELSE 15e0 END AS score FROM px2 CROSS JOIN b")


def quantiles(df: DataFrame, column: str, shares: Sequence[float], edge: float = 2e-4) -> list[float | None]:
    """Exact interpolated quantiles of a whole column, in bounded memory: a sketch gives bounds round each, and only the values between them are ranked."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    n, out = rows.count(), []
    for share in shares if n else ():
        place, width, found = share * (n - 1), edge, None
        low, high = math.floor(place), math.ceil(place)
        while found is None:
            a, b = rows.agg(F.percentile_approx("x", [max(0.0, share - width), min(1.0, share + width)], 10_000)).first()[0]
            below = rows.where(F.col("x") < a).count()
            counted = rows.where(F.col("x").between(a, b)).groupBy("x").count().withColumn("upto", F.sum("count").over(Window.orderBy("x")) + below)
            x, y, last = counted.agg(F.min(F.when(F.col("upto") > low, F.col("x"))), F.min(F.when(F.col("upto") > high, F.col("x"))), F.max("upto")).first()
            if below <= low and last > high:
                found = x if low == high else (high - place) * x + (place - low) * y
            width *= 8
        out.append(found)
    return out or [None] * len(shares)


@query("dq51_proxy_tier_scores")
def dq51(spark, sf_dir):
    rows = written(select(f"WITH {PROXY} SELECT entity_id, report_date, liquidity FROM px2", spark, sf_dir), "liquidity")
    a, m, z = (F.lit(v).cast("double") for v in quantiles(rows, "liquidity", (0.25, 0.5, 0.75)))
    x = F.col("liquidity")
    return rows.select("entity_id", "report_date", F.when(x.isNull(), None).when(x >= z, 85.0).when(x >= m, 65.0).when(x >= a, 40.0).otherwise(15.0).alias("score"))


# The reference frequency of a series from the gaps of its dates.
GAPS = "gp AS (SELECT entity_id, statement, DAYS(lag(report_date) OVER (PARTITION BY entity_id, statement ORDER BY report_date), report_date) AS gap FROM {statement_dates}), gm AS (SELECT entity_id, statement, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(gap AS DOUBLE)) AS gap, count(gap) AS n FROM gp GROUP BY entity_id, statement), gf AS (SELECT *, CASE WHEN gap < 120 THEN 'quarterly' WHEN gap < 250 THEN 'semiannual' WHEN gap < 500 THEN 'annual' ELSE 'unknown' END AS frequency FROM gm)"
sql_query("scal12_native_frequency", f"WITH {GAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, statement) AS place FROM gf) SELECT entity_id, frequency FROM k WHERE place = 1")
sql_query("set07_observed_frequencies", f"WITH {GAPS} SELECT DISTINCT entity_id, frequency FROM gf")
LOGLIK = lambda mean, sd, prior: f"ln({prior}) - ln({sd}e0) - (gap - {mean}) * (gap - {mean}) / (2e0 * {sd} * {sd})"
sql_query("scal10_gap_bayes", f"WITH {GAPS}, l AS (SELECT entity_id, statement, {LOGLIK(91, 12, 0.6)} AS q, {LOGLIK(182, 20, 0.15)} AS s, {LOGLIK(365, 30, 0.25)} AS a FROM gm WHERE gap IS NOT NULL) SELECT entity_id, statement, CASE WHEN q >= s AND q >= a THEN 'quarterly' WHEN s >= a THEN 'semiannual' ELSE 'annual' END AS frequency FROM l")
CALENDAR = "ec AS (SELECT entity_id, max(filing_date) AS last, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(gap AS DOUBLE)) AS gap, count(*) AS n, min(filing_date) AS first FROM (SELECT entity_id, filing_date, DAYS(lag(filing_date) OVER (PARTITION BY entity_id ORDER BY filing_date), filing_date) AS gap FROM {fin}) x GROUP BY entity_id)"
sql_query("scal13_expected_next_filing", f"WITH {CALENDAR} SELECT entity_id, last, NEAREST(gap) AS gap_days, DAYS(last, CAST('2002-08-01' AS DATE)) - NEAREST(gap) AS days_overdue, CAST(DAYS(last, CAST('2002-08-01' AS DATE)) > gap AS INT) AS overdue FROM ec")
sql_query("scal14_filing_calendar", f"WITH {CALENDAR} SELECT entity_id, n AS received, CAST(floor(DAYS(first, last) / gap + 0.5) AS BIGINT) + 1 AS expected, DAYS(last, CAST('2002-08-01' AS DATE)) AS age_days FROM ec")
LADDER = "(VALUES ('quarterly', 1), ('semiannual', 2), ('annual', 3)) AS t(period_type, priority)"
sql_query("top04_statement_priority", f"WITH s AS (SELECT entity_id, report_date, period_type, priority, filing_date, CASE priority WHEN 1 THEN revenue WHEN 2 THEN revenue * 2 ELSE revenue * 4 END AS value FROM {{fin}} CROSS JOIN {LADDER} WHERE (priority = 1 AND month(report_date) <> 6) OR (priority = 2 AND month(report_date) IN (6, 12)) OR (priority = 3 AND month(report_date) = 12)), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, report_date ORDER BY priority, filing_date DESC) AS place FROM s) SELECT entity_id, report_date, period_type, {rounded({'value': 'value'}, 2)} FROM k WHERE place = 1")
