"""Fund-style analysis of statements: quality, leverage, growth, value, and the scorecard made of them.

``q`` holds the quarters of a supplier with its market value; ``back`` counts
them from the latest, and scores look at the last eight.
"""

from panelweave.operators.health import QUARTERS, VALUE
from panelweave.operators.survival import DEBT, normal_cdf
from panelweave.sqlops import rounded, sql_query

LAST8 = f"{QUARTERS}, e AS (SELECT *, -CAST(back AS DOUBLE) AS k, {DEBT} AS debt, operating_cash_flow - abs(capex) AS fcf FROM q WHERE back <= 8)"
WQ = "(PARTITION BY entity_id ORDER BY report_date)"


def clamp(e: str) -> str:
    return f"greatest(0e0, least(100e0, {e}))"


def latest(*columns: str) -> str:
    return ", ".join(f"max(CASE WHEN back = 1 THEN {c} END) AS {c}" for c in columns)


RISK = "CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'elevated' ELSE 'low' END"
GRADE = "CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'fair' ELSE 'weak' END"
sql_query("anal81_last_filings", f"WITH q AS (SELECT entity_id, report_date, receivables, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {{fin}} WHERE receivables IS NOT NULL) SELECT entity_id, report_date, CAST(back AS INT) AS back, {rounded({'receivables': 'receivables'}, 3)} FROM q WHERE back <= 8")
sql_query("anal82_qoq_yoy", f"SELECT entity_id, report_date, {rounded({'qoq': f'RAT(revenue - lag(revenue) OVER {WQ}, lag(revenue) OVER {WQ})', 'yoy': f'RAT(revenue - lag(revenue, 4) OVER {WQ}, lag(revenue, 4) OVER {WQ})'})} FROM {{fin}}")
sql_query("anal84_qoq_change", f"SELECT entity_id, report_date, {rounded({x: f'RAT({x} - lag({x}) OVER {WQ}, lag({x}) OVER {WQ})' for x in ('ebit', 'net_income', 'operating_cash_flow')})} FROM {{fin}}")
sql_query("anal83_ols_slope", f"WITH q AS (SELECT entity_id, report_date, revenue, CAST(row_number() OVER {WQ} AS DOUBLE) AS k FROM {{fin}}) SELECT entity_id, report_date, {rounded({'slope_8': 'CASE WHEN count(revenue) OVER w >= 4 THEN regr_slope(revenue, k) OVER w END'}, 3)} FROM q WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS 7 PRECEDING)")
sql_query("anal85_latest_value", f"SELECT entity_id, {rounded({x: f'max_by({x}, report_date) FILTER (WHERE {x} IS NOT NULL)' for x in ('receivables', 'cash_and_equivalents', 'revenue')}, 3)} FROM {{fin}} GROUP BY entity_id")
sql_query("anal86_data_readiness", "SELECT entity_id, count(*) AS n_filings, count(receivables) AS n_receivables, count(cash_and_equivalents) AS n_cash, count(research_and_development) AS n_research, CASE WHEN count(*) >= 8 AND count(cash_and_equivalents) >= 4 AND count(receivables) >= 4 THEN 'ready' WHEN count(*) >= 4 THEN 'partial' ELSE 'insufficient' END AS readiness FROM {fin} GROUP BY entity_id")
sql_query(
    "anal53_fcf_quality",
    f"""WITH {LAST8}, a AS (SELECT entity_id, avg(RAT(operating_cash_flow, net_income)) AS conversion, avg(RAT(net_income - operating_cash_flow, total_assets)) AS accruals, regr_slope(RAT(fcf, revenue), k) AS trend, stddev_samp(RAT(abs(capex), revenue)) AS wobble, count(*) AS n FROM e GROUP BY entity_id),
    s AS (SELECT *, 0.40 * {clamp("50 * conversion")} + 0.30 * {clamp("50 - 1000 * accruals")} + 0.20 * {clamp("50 + 5000 * trend")} + 0.10 * {clamp("100 - 1000 * wobble")} AS score FROM a WHERE n >= 4)
    SELECT entity_id, {rounded({"conversion": "conversion", "accruals": "accruals", "trend": "trend", "score": "score"}, 4)}, {GRADE} AS label FROM s""",
)
# Discretionary accruals are what total accruals leave over after a regression on the change of sales, within the region.
JONES = f"""{QUARTERS}, j AS (SELECT q.entity_id, q.report_date, back, p.region, RAT(net_income - operating_cash_flow, total_assets) AS ta, RAT(revenue - lag(revenue) OVER w - coalesce(receivables - lag(receivables) OVER w, 0e0), total_assets) AS ds, RAT(ppe_net, total_assets) AS ppe FROM q JOIN {{peers}} p ON p.entity_id = q.entity_id WINDOW w AS (PARTITION BY q.entity_id ORDER BY report_date)),
 b AS (SELECT region, regr_slope(ta, ds) AS slope, regr_intercept(ta, ds) AS base FROM j GROUP BY region)"""
sql_query("anal54_accruals_forensics", f"WITH {JONES} SELECT j.entity_id, j.report_date, {rounded({'total_accruals': 'ta', 'discretionary_accruals': 'ta - (base + slope * ds)'}, 5)}, CAST(coalesce(abs(ta - (base + slope * ds)) > 0.05, false) AS INT) AS red_flag FROM j JOIN b ON j.region = b.region")
sql_query(
    "anal55_dechow_f",
    f"""WITH p AS (SELECT *, lag(total_assets) OVER w AS a0, lag(receivables) OVER w AS r0, lag(inventory) OVER w AS i0, lag(revenue) OVER w AS s0, lag(net_income) OVER w AS n0, lag(operating_cash_flow) OVER w AS o0 FROM {{fin}} WINDOW w AS {WQ}),
    x AS (SELECT entity_id, report_date, RAT(net_income - operating_cash_flow, (total_assets + a0) / 2) AS rsst, RAT(receivables - r0, (total_assets + a0) / 2) AS d_rec, RAT(inventory - i0, (total_assets + a0) / 2) AS d_inv, RAT(total_assets - ppe_net - coalesce(cash_and_equivalents, 0e0), total_assets) AS soft, RAT(revenue - s0, s0) AS d_sales, RAT(net_income, total_assets) - RAT(n0, a0) AS d_roa FROM p),
    f AS (SELECT *, -7.893 + 0.790 * coalesce(rsst, 0e0) + 2.518 * coalesce(d_rec, 0e0) + 1.191 * coalesce(d_inv, 0e0) + 1.979 * soft + 0.171 * coalesce(d_sales, 0e0) - 0.932 * coalesce(d_roa, 0e0) AS z FROM x)
    SELECT entity_id, report_date, {rounded({"f_score": "exp(z) / (1 + exp(z)) / 0.0037"}, 4)}, CASE WHEN exp(z) / (1 + exp(z)) / 0.0037 > 1.85 THEN 'high' WHEN exp(z) / (1 + exp(z)) / 0.0037 > 1 THEN 'elevated' ELSE 'normal' END AS risk FROM f""",
)
sql_query(
    "anal56_real_activity",
    f"""WITH {QUARTERS}, j AS (SELECT q.entity_id, q.report_date, p.region, RAT(operating_cash_flow, total_assets) AS cfo, RAT(cost_of_revenue + inventory - lag(inventory) OVER w, total_assets) AS prod, RAT(sga_expenses + coalesce(research_and_development, 0e0), total_assets) AS disc, RAT(revenue, total_assets) AS s FROM q JOIN {{peers}} p ON p.entity_id = q.entity_id WINDOW w AS (PARTITION BY q.entity_id ORDER BY report_date)),
    b AS (SELECT region, {", ".join(f"regr_slope({y}, s) AS {y}_b, regr_intercept({y}, s) AS {y}_a" for y in ("cfo", "prod", "disc"))} FROM j GROUP BY region)
    SELECT j.entity_id, j.report_date, {rounded({f"abnormal_{y}": f"{y} - ({y}_a + {y}_b * s)" for y in ("cfo", "prod", "disc")}, 5)} FROM j JOIN b ON j.region = b.region""",
)
# Bad news shows in earnings more than good news: the difference of the slopes on quarters of falling and rising prices.
sql_query(
    "anal57_conservatism",
    f"""WITH {QUARTERS}, r AS (SELECT entity_id, RAT(net_income, market_cap) AS y, RAT(close, lag(close) OVER w) - 1 AS x FROM q WINDOW w AS (PARTITION BY entity_id ORDER BY report_date))
    SELECT entity_id, count(x) AS n, {rounded({"good": "regr_slope(CASE WHEN x >= 0 THEN y END, x)", "bad": "regr_slope(CASE WHEN x < 0 THEN y END, x)", "asymmetry": "regr_slope(CASE WHEN x < 0 THEN y END, x) - regr_slope(CASE WHEN x >= 0 THEN y END, x)"}, 4)} FROM r GROUP BY entity_id""",
)
sql_query(
    "anal58_earnings_smoothing",
    f"""WITH p AS (SELECT *, net_income - lag(net_income) OVER {WQ} AS d, revenue - lag(revenue) OVER {WQ} AS dr FROM {{fin}}), a AS (SELECT entity_id, stddev_samp(net_income) / nullif(stddev_samp(operating_cash_flow), 0) AS ratio, avg(CASE WHEN d > 0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END) AS up, PEARSON(net_income - operating_cash_flow, operating_cash_flow) AS link FROM p GROUP BY entity_id),
    s AS (SELECT *, 0.5 * {clamp("100 * (1 - ratio)")} + 0.3 * {clamp("200 * (up - 0.5)")} + 0.2 * {clamp("-100 * link")} AS score FROM a)
    SELECT entity_id, {rounded({"smoothing_ratio": "ratio", "share_up": "up", "accruals_cash_corr": "link", "score": "score"}, 4)}, {RISK} AS label FROM s""",
)
sql_query(
    "anal59_dividend_burn",
    f"""WITH {LAST8}, a AS (SELECT entity_id, avg(CASE WHEN abs(fcf) > 1e-6 THEN abs(dividends_paid) / fcf END) AS coverage, avg(fcf) AS mean_fcf, avg(abs(dividends_paid)) AS mean_div, avg(CASE WHEN abs(fcf) > 1e-6 THEN (interest_expense + abs(dividends_paid)) / fcf END) AS service, regr_slope(current_assets - current_liabilities, k) AS drain FROM e GROUP BY entity_id),
    s AS (SELECT *, {clamp("0.4 * CASE WHEN mean_fcf < 0 AND mean_div > 0 THEN 95e0 WHEN coverage > 1.5 THEN least(100e0, coverage * 40) ELSE least(100e0, greatest(0e0, coverage * 60)) END + 0.3 * CASE WHEN coalesce(service, 0e0) = 0 THEN 50e0 ELSE least(100e0, greatest(0e0, service * 50)) END + 0.2 * CASE WHEN drain < 0 THEN 70e0 ELSE 30e0 END + 0.1 * 50")} AS score FROM a)
    SELECT entity_id, {rounded({"dividend_fcf_coverage": "coverage", "debt_service_coverage": "service", "risk_score": "score"}, 4)}, CAST(coalesce(drain < 0, false) AS INT) AS working_capital_drain, {RISK} AS label FROM s""",
)
sql_query(
    "anal60_return_spread",
    f"""WITH {LAST8}, a AS (SELECT entity_id, RAT(operating_cash_flow, total_assets) AS croa, RAT(ebit * 0.75, total_equity + debt - coalesce(cash_and_equivalents, 0e0)) AS roic, RAT(revenue, total_assets) AS turnover, RAT(total_assets, total_equity) AS multiplier FROM e WHERE back = 1)
    SELECT entity_id, {rounded({"croa": "croa", "roic": "roic", "dupont_asset_turnover": "turnover", "dupont_equity_multiplier": "multiplier"})}, {rounded({"spread_bps": "(croa - roic) * 10000"}, 2)}, CASE WHEN (croa - roic) * 10000 > 50 THEN 'healthy' WHEN (croa - roic) * 10000 < -100 THEN 'concerning' ELSE 'neutral' END AS quality FROM a""",
)
sql_query(
    "anal61_operating_leverage",
    f"""WITH {LAST8}, c AS (SELECT entity_id, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS r, RAT(ebit - lag(ebit) OVER w, lag(ebit) OVER w) AS o, RAT(net_income - lag(net_income) OVER w, lag(net_income) OVER w) AS n FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)),
    d AS (SELECT entity_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN abs(r) > 0.001 THEN o / r END) AS dol, percentile_cont(0.5) WITHIN GROUP (ORDER BY CASE WHEN abs(o) > 0.001 THEN n / o END) AS dfl FROM c GROUP BY entity_id)
    SELECT entity_id, {rounded({"dol": "dol", "dfl": "dfl", "dtl": "dol * dfl"}, 4)}, CASE WHEN abs(dol) > 5 THEN 'extreme' WHEN abs(dol) > 3 THEN 'high' WHEN abs(dol) > 1.5 THEN 'moderate' ELSE 'low' END AS earnings_sensitivity FROM d""",
)
sql_query(
    "anal62_off_balance_risk",
    f"""WITH s AS (SELECT entity_id, report_date, RAT(goodwill, total_assets) AS g, RAT(intangible_assets, total_assets) AS i, {clamp("(RAT(sga_expenses, revenue) - 0.15) / 0.25 * 100")} AS a FROM {{fin}}), t AS (SELECT *, {clamp("0.35 * least(100e0, g / 0.3 * 100) + 0.25 * least(100e0, i / 0.3 * 100) + 0.20 * CASE WHEN a = 0 THEN 50e0 ELSE a END + 0.20 * 50")} AS score FROM s)
    SELECT entity_id, report_date, {rounded({"goodwill_to_assets": "g", "intangibles_to_assets": "i", "risk_score": "score"}, 5)}, {RISK} AS label FROM t""",
)
sql_query(
    "anal63_asset_quality",
    f"""WITH d AS (SELECT entity_id, report_date, RAT(receivables, revenue / 90) AS dso, RAT(inventory, cost_of_revenue / 90) AS dio FROM {{fin}}), c AS (SELECT *, RAT(dso - lag(dso) OVER {WQ}, abs(lag(dso) OVER {WQ})) * 100 AS cd, RAT(dio - lag(dio) OVER {WQ}, abs(lag(dio) OVER {WQ})) * 100 AS ci FROM d),
    s AS (SELECT *, {clamp(f"0.30 * {clamp('coalesce(cd, 0e0) * 3 + 50')} + 0.25 * {clamp('coalesce(ci, 0e0) * 3 + 50')} + 0.45 * 50")} AS score FROM c)
    SELECT entity_id, report_date, {rounded({"dso": "dso", "dso_change_pct": "cd", "inventory_days": "dio", "inventory_days_change_pct": "ci", "deterioration_score": "score"}, 4)}, {RISK} AS label FROM s""",
)
#: Shocks of sales, margin and interest.
SHOCKS = "(VALUES ('base_case', 0e0, 0e0, 1e0, 1e0), ('revenue_miss', 0.15e0, 0.02e0, 0.85e0, 1e0), ('systemic_crisis', 0.25e0, 0.04e0, 0.85e0, 1.3e0)) AS t(scenario, sales, margin, kept, interest)"
STRESS = f"""{LAST8}, b AS (SELECT entity_id, scenario, debt, ebit, ebitda, interest_expense * interest AS ie, kept, CASE WHEN scenario = 'base_case' THEN 4 * ebitda ELSE 4 * revenue * (1 - sales) * greatest(ebitda / revenue - margin, 0.01e0) END AS stressed FROM e CROSS JOIN {SHOCKS} WHERE back = 1 AND debt > 0 AND revenue > 0)"""
sql_query("anal64_leverage_stress", f"WITH {STRESS} SELECT entity_id, scenario, {rounded({'debt_to_ebitda': 'CASE WHEN ebitda > 0 THEN RAT(debt, stressed) END', 'interest_coverage': 'RAT(CASE WHEN ebitda <= 0 OR kept = 1 THEN ebit ELSE stressed / 4 * kept END, ie)'}, 4)}, CAST(ebitda <= 0 OR coalesce(RAT(debt, stressed) > 5.5, false) AS INT) AS covenant_breach FROM b")
sql_query(
    "anal65_momentum_composite",
    f"""WITH {LAST8}, c AS (SELECT *, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS r FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), d AS (SELECT *, r - lag(r) OVER (PARTITION BY entity_id ORDER BY report_date) AS accel FROM c),
    a AS (SELECT entity_id, max(CASE WHEN back = 1 THEN accel END) AS accel, regr_slope(RAT(net_income, revenue), k) AS margin, regr_slope(RAT(operating_cash_flow, revenue), k) AS conversion FROM d GROUP BY entity_id),
    p AS (SELECT entity_id, max_by(momentum, date) AS price FROM (SELECT entity_id, date, RAT(close, lag(close, 62) OVER (PARTITION BY entity_id ORDER BY date)) - 1 AS momentum FROM {{px}}) m GROUP BY entity_id),
    s AS (SELECT a.*, price, {clamp(f"0.30 * {clamp('50 + 500 * coalesce(accel, 0e0)')} + 0.25 * {clamp('50 + 5000 * coalesce(margin, 0e0)')} + 0.15 * {clamp('50 + 5000 * coalesce(conversion, 0e0)')} + 0.05 * 50 + 0.25 * {clamp('50 + 200 * coalesce(price, 0e0)')}")} AS score FROM a LEFT JOIN p ON p.entity_id = a.entity_id)
    SELECT entity_id, {rounded({"revenue_acceleration": "accel", "margin_trend_slope": "margin", "fcf_conversion_trend": "conversion", "price_momentum": "price", "score": "score"}, 5)}, {GRADE} AS label, CAST(coalesce(accel < -0.01 AND margin < 0, false) AS INT) AS inflection_detected FROM s""",
)
sql_query(
    "anal66_growth_quality",
    f"""WITH {LAST8}, y AS (SELECT *, RAT(revenue - lag(revenue, 4) OVER w, lag(revenue, 4) OVER w) AS yoy, goodwill - lag(goodwill) OVER w AS jump, (ebit - lag(ebit, 4) OVER w) AS d_ebit, (total_assets - lag(total_assets, 4) OVER w) AS d_assets FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)),
    a AS (SELECT entity_id, max(CASE WHEN back = 1 THEN yoy END) AS total, CASE WHEN max(jump) > 0 AND avg(revenue) > 1e-6 THEN least(1e0, max(jump) / avg(revenue)) ELSE 0e0 END AS bought, max(CASE WHEN back = 1 THEN RAT(0.75 * d_ebit, d_assets) END) AS roic FROM y GROUP BY entity_id),
    s AS (SELECT *, {clamp("0.50 * 100 * (1 - bought) + 0.50 * 50")} AS score FROM a)
    SELECT entity_id, {rounded({"organic_growth_pct": "total * (1 - bought)", "inorganic_growth_pct": "CASE WHEN total > 0 THEN bought * total ELSE 0e0 END", "organic_fraction": "1 - bought", "incremental_roic": "roic", "score": "score"}, 5)}, {GRADE} AS label FROM s""",
)
# Chances start from a standard normal beyond 1.5 and move by a tenth with the sign of the last three surprises.
sql_query(
    "anal67_earnings_surprise",
    f"""WITH x AS (SELECT entity_id, report_date, RAT(net_income, shares_outstanding) AS eps FROM {{fin}}), s AS (SELECT *, eps - lag(eps, 4) OVER {WQ} AS surprise FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM s WHERE surprise IS NOT NULL),
    a AS (SELECT entity_id, count(*) AS n, avg(surprise) AS mean, avg(CASE WHEN surprise > 0 THEN 1e0 ELSE 0e0 END) AS beat_rate, avg(CASE WHEN back <= 3 THEN surprise END) AS recent FROM b GROUP BY entity_id), p AS (SELECT *, 0.0668072 + CASE WHEN recent > 0 THEN 0.1 WHEN recent < 0 THEN -0.1 ELSE 0 END AS up, 0.0668072 - CASE WHEN recent > 0 THEN 0.1 WHEN recent < 0 THEN -0.1 ELSE 0 END AS down FROM a WHERE n >= 4)
    SELECT entity_id, n, {rounded({"mean_surprise": "mean", "beat_rate": "beat_rate", "p_beat": "greatest(0e0, up)", "p_miss": "greatest(0e0, down)", "p_inline": "greatest(0e0, 1 - greatest(0e0, up) - greatest(0e0, down))"}, 5)} FROM p""",
)
# A grid of growth and discount rates instead of drawn ones.
GRID = "(VALUES (0.02e0), (0.035e0), (0.05e0), (0.065e0), (0.08e0)) AS g(growth) CROSS JOIN (VALUES (0.08e0), (0.09e0), (0.10e0), (0.11e0)) AS w(wacc)"
PRESENT = " + ".join(f"fcf * pow((1 + growth) / (1 + wacc), {t})" for t in range(1, 6))
DCF = f"{LAST8}, a AS (SELECT entity_id, sum(CASE WHEN back <= 4 THEN fcf END) AS fcf, {latest('debt', 'cash_and_equivalents', 'shares_outstanding', 'close')} FROM e GROUP BY entity_id), v AS (SELECT a.*, growth, wacc, ({PRESENT} + fcf * pow(1 + growth, 5) * 1.025 / (wacc - 0.025) / pow(1 + wacc, 5) - debt + coalesce(cash_and_equivalents, 0e0)) / shares_outstanding AS value FROM a CROSS JOIN {GRID} WHERE fcf > 0)"
sql_query("anal68_dcf_value", f"WITH {DCF} SELECT entity_id, count(*) AS n_grid, {rounded({f'intrinsic_p{p}': f'percentile_cont({p / 100}) WITHIN GROUP (ORDER BY value)' for p in (10, 25, 50, 75, 90)}, 4)}, {rounded({'upside_pct': '(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) / max(close) - 1) * 100'}, 3)} FROM v GROUP BY entity_id")
sql_query(
    "anal69_valuation_quality",
    f"""WITH {LAST8}, a AS (SELECT p.region, e.entity_id, RAT(close, 4 * net_income / shares_outstanding) AS pe, {clamp("50 * RAT(operating_cash_flow, net_income)")} AS quality FROM e JOIN {{peers}} p ON p.entity_id = e.entity_id WHERE back = 1), r AS (SELECT *, 100 * cume_dist() OVER (PARTITION BY region ORDER BY pe) AS place FROM a WHERE pe IS NOT NULL)
    SELECT entity_id, {rounded({"quality_score": "quality", "valuation_percentile": "place"}, 3)}, CASE WHEN place < 40 AND quality > 60 THEN 'undervalued' WHEN place < 40 THEN 'value_trap' WHEN quality > 60 THEN 'fair' ELSE 'overvalued' END AS quadrant FROM r""",
)
sql_query(
    "anal70_peg_and_spread",
    f"""WITH {LAST8}, y AS (SELECT *, RAT(revenue - lag(revenue, 4) OVER w, lag(revenue, 4) OVER w) AS growth, sum(fcf) OVER (PARTITION BY entity_id ORDER BY report_date ROWS 3 PRECEDING) AS ttm FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), a AS (SELECT entity_id, RAT(close, 4 * net_income / shares_outstanding) AS pe, growth, RAT(ttm, market_cap) * 100 AS yield, RAT(4 * interest_expense, debt) * 100 AS cost FROM y WHERE back = 1)
    SELECT entity_id, {rounded({"peg_raw": "CASE WHEN abs(growth) > 0.001 THEN pe / (growth * 100) END", "fcf_yield_pct": "yield", "debt_cost_pct": "cost", "fcf_spread_bps": "(yield - cost) * 100"}, 4)}, CAST(coalesce((yield - cost) * 100 > 200, false) AS INT) AS cheap_flag FROM a""",
)
sql_query(
    "anal71_eva",
    f"""WITH {QUARTERS}, v AS (SELECT entity_id, report_date, back, 4 * ebit * (1 - greatest(0e0, least(0.5e0, 0.21e0))) AS nopat, total_assets - current_liabilities AS capital, market_cap - total_equity AS mva FROM q), e AS (SELECT *, nopat - 0.09 * capital AS eva FROM v)
    SELECT entity_id, report_date, {rounded({"eva": "eva", "mva": "mva"}, 2)}, {rounded({"roic_spread": "RAT(nopat, capital) - 0.09"})}, {rounded({"eva_momentum": f"RAT(eva - lag(eva, 4) OVER {WQ}, lag(capital, 4) OVER {WQ})"})} FROM e""",
)
sql_query(
    "anal72_sum_of_parts",
    """WITH s AS (SELECT l_suppkey AS entity_id, p_type, sum(l_extendedprice) AS revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_type), m AS (SELECT *, CASE WHEN p_type LIKE 'PROMO%' THEN 3e0 WHEN p_type LIKE 'ECONOMY%' THEN 1e0 WHEN p_type LIKE 'STANDARD%' THEN 1.5e0 ELSE 2e0 END AS multiple FROM s)
    SELECT entity_id, count(*) AS n_parts, round(sum(revenue * multiple) + 1e-5, 2) AS value, round(sum(revenue * multiple) / sum(revenue) + 1e-9, 6) AS mean_multiple FROM m GROUP BY entity_id""",
)
sql_query("anal73_sustainable_growth", f"SELECT entity_id, report_date, {rounded({'payout': 'RAT(dividends_paid, net_income)', 'roe': 'RAT(4 * net_income, total_equity)', 'sustainable_growth': 'RAT(4 * net_income, total_equity) * (1 - greatest(0e0, least(1e0, coalesce(RAT(dividends_paid, net_income), 0e0))))'})} FROM {{fin}}")
#: Metric -> (tier, its score, weight): fixed values of the scorecard.
CARD = {
    "current": ("liquidity", clamp("40 * RAT(current_assets, current_liabilities)"), 1), "cash": ("liquidity", clamp("100 * RAT(coalesce(cash_and_equivalents, 0e0), current_liabilities)"), 1), "fcf_margin": ("liquidity", clamp("50 + 200 * RAT(fcf, revenue)"), 2),
    "leverage": ("solvency", clamp("100 - 25 * RAT(debt, total_equity)"), 2), "coverage": ("solvency", clamp("10 * coalesce(RAT(ebit, interest_expense), 10e0)"), 1), "equity": ("solvency", clamp("100 * RAT(total_equity, total_assets)"), 1),
    "gross": ("profitability", clamp("150 * RAT(gross_profit, revenue)"), 1), "net": ("profitability", clamp("50 + 250 * RAT(net_income, revenue)"), 2), "roa": ("profitability", clamp("50 + 500 * RAT(net_income, total_assets)"), 1),
    "conversion": ("quality", clamp("50 * RAT(operating_cash_flow, net_income)"), 2), "accruals": ("quality", clamp("50 - 500 * RAT(net_income - operating_cash_flow, total_assets)"), 1), "soft": ("quality", clamp("100 - 100 * RAT(goodwill + intangible_assets, total_assets) / 0.3"), 1),
    "turnover": ("efficiency", clamp("100 * RAT(revenue, total_assets)"), 1), "capex": ("efficiency", clamp("100 - 500 * RAT(abs(capex), revenue)"), 1), "sga": ("efficiency", clamp("100 - 300 * RAT(sga_expenses, revenue)"), 1),
}
SCORECARD = f"""{LAST8}, u AS (SELECT entity_id, metric, tier, weight, CASE metric {" ".join(f"WHEN '{k}' THEN {s}" for k, (_, s, _) in CARD.items())} END AS score FROM e CROSS JOIN (VALUES {", ".join(f"('{k}', '{t}', {w}e0)" for k, (t, _, w) in CARD.items())}) AS t(metric, tier, weight) WHERE back = 1),
 s AS (SELECT entity_id, tier, sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS tier_score FROM u GROUP BY entity_id, tier), c AS (SELECT entity_id, avg(tier_score) AS score, count(tier_score) AS n_tiers FROM s GROUP BY entity_id)"""
sql_query("anal74_thesis_scorecard", f"WITH {SCORECARD} SELECT s.entity_id, s.tier, {rounded({'tier_score': 's.tier_score', 'composite': 'c.score'}, 4)}, CASE WHEN c.score >= 80 THEN 'A' WHEN c.score >= 65 THEN 'B' WHEN c.score >= 50 THEN 'C' WHEN c.score >= 35 THEN 'D' ELSE 'F' END AS grade FROM s JOIN c ON s.entity_id = c.entity_id")
sql_query("anal75_position_signal", f"WITH {SCORECARD}, g AS (SELECT entity_id, greatest(-1e0, least(1e0, (score - 50) / 40)) AS signal FROM c) SELECT entity_id, {rounded({'signal': 'signal', 'size_pct': 'least(5e0, abs(signal) * 5)'}, 5)}, CASE WHEN signal > 0.5 THEN 'strong_long' WHEN signal > 0.15 THEN 'long' WHEN signal < -0.5 THEN 'strong_short' WHEN signal < -0.15 THEN 'short' ELSE 'neutral' END AS label FROM g")
ITEMS = ["receivables", "inventory", "goodwill", "debt", "cash_and_equivalents"]
sql_query(
    "anal42_balance_sheet_velocity",
    f"""WITH {LAST8}, u AS (SELECT entity_id, report_date, back, item, CASE item {" ".join(f"WHEN '{x}' THEN {x}" for x in ITEMS)} END AS value FROM e CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in ITEMS)}) AS t(item)),
    c AS (SELECT *, RAT(value - lag(value) OVER w, lag(value) OVER w) AS change FROM u WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity_id, item ORDER BY report_date)), d AS (SELECT *, change - lag(change) OVER (PARTITION BY entity_id, item ORDER BY report_date) AS accel, row_number() OVER (PARTITION BY entity_id, item ORDER BY report_date DESC) AS place FROM c)
    SELECT entity_id, item, {rounded({"latest_qoq_pct": "change * 100", "acceleration": "accel * 100"}, 3)}, CASE WHEN accel > 0.02 THEN 'accelerating' WHEN accel < -0.02 THEN 'decelerating' ELSE 'stable' END AS flag FROM d WHERE place = 1""",
)
sql_query(
    "anal43_forensic_cashflow",
    f"""WITH {LAST8}, c AS (SELECT *, RAT(accounts_payable, revenue / 90) AS days, RAT(abs(capex), revenue) AS capex_ratio, RAT(receivables - lag(receivables) OVER w, lag(receivables) OVER w) AS dr, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS ds FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)),
    a AS (SELECT entity_id, CAST(coalesce(regr_slope(days, k) > 1, false) AS INT) AS supplier_financing, CAST(coalesce(max(CASE WHEN back = 1 THEN dr END) < -0.15 AND max(CASE WHEN back = 1 THEN ds END) > -0.05, false) AS INT) AS receivables_factoring, CAST(coalesce(regr_slope(capex_ratio, k) < -0.005, false) AS INT) AS capex_reclassification, CAST(coalesce(RAT(stddev_samp(operating_cash_flow), avg(abs(operating_cash_flow))) < 0.3 * RAT(stddev_samp(revenue), avg(abs(revenue))), false) AS INT) AS wc_smoothing FROM c GROUP BY entity_id)
    SELECT *, least(100, 30 * (supplier_financing + receivables_factoring + capex_reclassification + wc_smoothing)) AS risk_score FROM a""",
)
sql_query(
    "anal44_insider_alignment",
    f"""WITH {LAST8}, c AS (SELECT entity_id, RAT(sga_expenses - lag(sga_expenses) OVER w, lag(sga_expenses) OVER w) AS s, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS r, RAT(total_equity - lag(total_equity) OVER w, lag(total_equity) OVER w) AS q, RAT(net_income - lag(net_income) OVER w, lag(net_income) OVER w) AS n FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)),
    a AS (SELECT entity_id, {clamp("50 - 500 * (avg(s) - avg(r))")} AS discipline, CASE WHEN avg(q) > avg(n) + 0.02 THEN 20e0 ELSE 80e0 END AS dilution FROM c GROUP BY entity_id)
    SELECT entity_id, {rounded({"sga_discipline": "discipline", "no_dilution": "dilution", "score": "(discipline + dilution) / 2"}, 3)}, CASE WHEN (discipline + dilution) / 2 > 65 THEN 'aligned' WHEN (discipline + dilution) / 2 < 35 THEN 'misaligned' ELSE 'neutral' END AS label FROM a""",
)
sql_query(
    "anal45_capital_cycle",
    f"""WITH {LAST8}, a AS (SELECT e.entity_id, max(p.region) AS region, regr_slope(RAT(abs(capex), revenue), k) AS slope, max(CASE WHEN back = 1 THEN RAT(abs(capex), revenue) END) AS own FROM e JOIN {{peers}} p ON p.entity_id = e.entity_id GROUP BY e.entity_id), s AS (SELECT region, percentile_cont(0.5) WITHIN GROUP (ORDER BY own) AS median FROM a GROUP BY region)
    SELECT a.entity_id, {rounded({"capex_trend_slope": "slope", "own_intensity": "own", "sector_median_intensity": "median"})}, CASE WHEN slope > 0.005 THEN 'late_cycle' WHEN slope < -0.005 THEN 'early_cycle' ELSE 'mid_cycle' END AS cycle_position FROM a JOIN s ON a.region = s.region""",
)
sql_query(
    "anal46_earnings_torpedo",
    f"""WITH {LAST8}, c AS (SELECT *, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS r, RAT(net_income - lag(net_income) OVER w, abs(lag(net_income) OVER w)) AS n FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), d AS (SELECT *, r - lag(r) OVER (PARTITION BY entity_id ORDER BY report_date) AS accel FROM c),
    f AS (SELECT entity_id, CAST(coalesce(RAT(close, 4 * net_income / shares_outstanding) > 30, false) AS INT) AS high_pe, CAST(coalesce(accel < -0.01, false) AS INT) AS slowing, CAST(coalesce(n > 0.05 AND r < 0.02, false) AS INT) AS by_buybacks FROM d WHERE back = 1)
    SELECT *, least(100, 25 * (high_pe + slowing + by_buybacks)) AS torpedo_risk FROM f""",
)
sql_query(
    "anal47_implied_cost_of_capital",
    f"""WITH {LAST8}, y AS (SELECT *, RAT(revenue - lag(revenue, 4) OVER w, lag(revenue, 4) OVER w) AS g FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), a AS (SELECT entity_id, RAT(net_income / shares_outstanding, close) AS ep, greatest(0.01e0, least(0.2e0, coalesce(g, 0.05e0))) AS g FROM y WHERE back = 1 AND net_income > 0 AND close > 0), b AS (SELECT *, 0.5 * (0.03 + ep) AS a FROM a)
    SELECT entity_id, {rounded({"implied_cost_of_capital": "CASE WHEN a * a + ep * (g - 0.03) >= 0 THEN a + sqrt(greatest(0e0, a * a + ep * (g - 0.03))) END"}, 5)} FROM b""",
)
DD = "((ln(v / debt) + (0.04 + 0.5 * sv * sv) * years) / (sv * sqrt(years)) - sv * sqrt(years))"
sql_query(
    "anal49_default_term_structure",
    f"""WITH r AS (SELECT *, RAT(close, lag(close) OVER (PARTITION BY entity_id ORDER BY date)) - 1 AS ret FROM {{day}}), s AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) * sqrt(252e0) AS vol, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM r),
    b AS (SELECT entity_id, {DEBT} AS debt, market_cap + {DEBT} AS v, vol * market_cap / (market_cap + {DEBT}) AS sv FROM s WHERE back = 1 AND vol > 0 AND {DEBT} > 0), h AS (SELECT entity_id, years, {DD} AS dd FROM b CROSS JOIN (VALUES (1e0), (2e0), (3e0), (5e0)) AS t(years))
    SELECT entity_id, CAST(years AS INT) AS years, {rounded({"distance_to_default": "dd", "default_probability": normal_cdf("(-dd)")}, 5)} FROM h""",
)
sql_query(
    "anal50_moat_score",
    f"""WITH {QUARTERS}, g AS (SELECT *, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS r FROM q WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)), h AS (SELECT *, r - lag(r) OVER (PARTITION BY entity_id ORDER BY report_date) AS accel FROM g WHERE back <= 12),
    a AS (SELECT entity_id, greatest(0e0, 1 - least(1e0, stddev_samp(RAT(gross_profit, revenue)) * 10)) * 100 AS pricing, {clamp("50 + 2000 * avg(accel)")} AS network, (1 - least(1e0, RAT(stddev_samp(revenue), avg(revenue)))) * 100 AS switching, avg(RAT(gross_profit, revenue)) AS gm FROM h GROUP BY entity_id), k AS (SELECT a.*, 100 * cume_dist() OVER (PARTITION BY region ORDER BY gm) AS cost FROM a JOIN {{peers}} p ON p.entity_id = a.entity_id)
    SELECT entity_id, {rounded({"pricing_power": "pricing", "cost_advantage": "cost", "network_effects": "network", "switching_costs": "switching", "moat_score": "0.3 * pricing + 0.25 * cost + 0.2 * network + 0.25 * switching"}, 3)} FROM k""",
)
sql_query("anal51_governance", f"WITH {LAST8}, a AS (SELECT entity_id, {clamp('100 - 400 * stddev_samp(RAT(net_income, revenue))')} AS steady, {clamp('100 - 100 * avg(RAT(share_buybacks, revenue)) / 0.02')} AS restraint, {clamp('50 * avg(RAT(operating_cash_flow, net_income))')} AS honest FROM e GROUP BY entity_id) SELECT entity_id, {rounded({'steady_margins': 'steady', 'restraint': 'restraint', 'cash_backed': 'honest', 'governance_score': '0.4 * steady + 0.3 * restraint + 0.3 * honest'}, 3)} FROM a")
sql_query("anal52_capital_allocation", f"WITH {LAST8}, a AS (SELECT entity_id, sum(dividends_paid) AS d, sum(share_buybacks) AS b, sum(abs(capex)) AS c, sum(operating_cash_flow) AS o FROM e GROUP BY entity_id) SELECT entity_id, {rounded({'payout': 'RAT(d, o)', 'buyback': 'RAT(b, o)', 'reinvestment': 'RAT(c, o)'}, 5)}, CASE WHEN o <= 0 THEN 'burning' WHEN d + b + c > o THEN 'overspending' WHEN c > d + b THEN 'reinvesting' ELSE 'returning' END AS style FROM a")
sql_query("anal80_naive_bayes", f"WITH {LAST8}, a AS (SELECT entity_id, ln(0.1 / 0.9) + CASE WHEN RAT(current_assets, current_liabilities) < 1 THEN ln(3e0) ELSE ln(0.8e0) END + CASE WHEN net_income < 0 THEN ln(2.5e0) ELSE ln(0.7e0) END + CASE WHEN debt > 2 * total_equity THEN ln(2e0) ELSE ln(0.9e0) END AS odds FROM e WHERE back = 1) SELECT entity_id, {rounded({'posterior': '1 / (1 + exp(-odds))'})} FROM a")
sql_query("anal98_catalyst_regime", "WITH d AS (SELECT px.entity_id, px.date, min(f.filing_date) AS next, max(g.filing_date) AS last FROM {px} px LEFT JOIN {filings} f ON f.entity_id = px.entity_id AND f.filing_date >= px.date AND f.filing_date < px.date + INTERVAL 100 DAY LEFT JOIN {filings} g ON g.entity_id = px.entity_id AND g.filing_date < px.date AND g.filing_date >= px.date - INTERVAL 100 DAY GROUP BY px.entity_id, px.date) SELECT entity_id, date, CASE WHEN DAYS(date, CAST(next AS DATE)) <= 10 THEN 'zone' WHEN DAYS(date, CAST(next AS DATE)) <= 30 THEN 'pre' WHEN DAYS(CAST(last AS DATE), date) <= 5 THEN 'post' ELSE 'normal' END AS catalyst_regime FROM d")
# The same measure at two frequencies, and what they say together.
FREQ = f"{QUARTERS}, y AS (SELECT entity_id, 'A' AS freq, CAST(year(report_date) AS INT) AS period, sum(revenue) AS revenue, sum(net_income) AS net_income, sum(operating_cash_flow) AS ocf, sum(capex) AS capex, max_by(total_assets, report_date) AS total_assets, max_by({DEBT}, report_date) AS debt, sum(ebitda) AS ebitda FROM {{fin}} GROUP BY entity_id, year(report_date)), z AS (SELECT entity_id, 'Q' AS freq, CAST(4 * year(report_date) + quarter(report_date) AS INT) AS period, revenue, net_income, operating_cash_flow AS ocf, capex, total_assets, {DEBT} AS debt, 4 * ebitda AS ebitda FROM {{fin}}), b AS (SELECT * FROM y UNION ALL SELECT * FROM z), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, freq ORDER BY period DESC) AS back, RAT(revenue - lag(revenue) OVER w, lag(revenue) OVER w) AS growth FROM b WINDOW w AS (PARTITION BY entity_id, freq ORDER BY period))"
SHARE = "CASE freq WHEN 'Q' THEN 0.6e0 ELSE 0.4e0 END"
sql_query("anal89_momentum_multi", f"WITH {FREQ} SELECT entity_id, {rounded({'momentum': f'sum({SHARE} * growth) / sum({SHARE})'})} FROM n WHERE back = 1 AND growth IS NOT NULL GROUP BY entity_id")
sql_query("anal90_dcf_multi", f"WITH {FREQ}, v AS (SELECT entity_id, freq, avg(ocf - abs(capex)) * CASE freq WHEN 'Q' THEN 4 ELSE 1 END / 0.065 AS value, var_samp((ocf - abs(capex)) * CASE freq WHEN 'Q' THEN 4 ELSE 1 END) AS variance FROM n WHERE back <= 8 GROUP BY entity_id, freq) SELECT entity_id, {rounded({'value': 'sum(value / variance) / sum(1 / variance)'}, 1)} FROM v WHERE variance > 1e-9 GROUP BY entity_id")
sql_query("anal91_leverage_multi", f"WITH {FREQ}, v AS (SELECT entity_id, freq, RAT(debt, ebitda) AS x FROM n WHERE back = 1) SELECT entity_id, {rounded({'worst_debt_to_ebitda': 'max(x)'}, 4)}, CAST(coalesce(max(x) > 5.5, false) AS INT) AS any_breach, CAST(count(DISTINCT x > 5.5) > 1 AS INT) AS divergence FROM v GROUP BY entity_id")
sql_query("anal92_frequency_coherence", f"WITH {FREQ}, v AS (SELECT entity_id, count(DISTINCT sign(growth)) AS directions, avg(growth) AS mean, stddev_pop(growth) AS sd FROM n WHERE back = 1 AND growth IS NOT NULL GROUP BY entity_id), c AS (SELECT entity_id, 0.6 * CASE WHEN directions = 1 THEN 1 ELSE 0 END + 0.4 * greatest(0e0, 1 - coalesce(RAT(sd, abs(mean)), 1e0)) AS coherence FROM v) SELECT entity_id, {rounded({'coherence': 'coherence'})}, CASE WHEN coherence >= 0.7 THEN 'merge' ELSE 'keep_apart' END AS verdict FROM c")
sql_query("anal93_fcf_quality_multi", f"WITH {FREQ}, v AS (SELECT entity_id, freq, {clamp('50 * avg(RAT(ocf, net_income))')} AS score FROM n WHERE back <= 8 GROUP BY entity_id, freq) SELECT entity_id, {rounded({'score': f'sum({SHARE} * score) / sum({SHARE})'}, 4)} FROM v GROUP BY entity_id")
sql_query("anal94_accruals_multi", f"WITH {FREQ}, v AS (SELECT entity_id, avg(CASE WHEN freq = 'A' THEN RAT(net_income - ocf, total_assets) END) AS annual, avg(CASE WHEN freq = 'Q' AND back <= 8 THEN RAT(net_income - ocf, total_assets) END) AS quarterly FROM n GROUP BY entity_id) SELECT entity_id, {rounded({'jones_accruals': 'coalesce(annual, quarterly)', 'recent_accruals': 'coalesce(quarterly, annual)'})} FROM v")
sql_query("anal95_growth_multi", f"WITH {FREQ} SELECT entity_id, {rounded({"annual_growth": "max(CASE WHEN freq = 'A' AND back = 2 THEN growth END)", "quarterly_growth": "max(CASE WHEN freq = 'Q' AND back = 1 THEN growth END)"})} FROM n GROUP BY entity_id")
sql_query("anal87_fund_table", f"WITH {SCORECARD}, f AS (SELECT entity_id, RAT(operating_cash_flow, total_assets) AS croa, RAT(debt, 4 * ebitda) AS leverage, RAT(net_income, revenue) AS margin, RAT(close, 4 * net_income / shares_outstanding) AS pe FROM e WHERE back = 1) SELECT c.entity_id, {rounded({'composite': 'c.score', 'croa': 'croa', 'leverage': 'leverage', 'net_margin': 'margin', 'pe': 'pe'}, 5)}, CASE WHEN c.score > 58 THEN 'long' WHEN c.score < 42 THEN 'short' ELSE 'neutral' END AS signal FROM c JOIN f ON c.entity_id = f.entity_id")
