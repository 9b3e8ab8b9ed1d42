"""Ratios of statements and prices: leverage, liquidity, cash, margins, value, credit and forensic signs."""

from panelweave.sqlops import ratios, rounded, sql_query

DEBT = "(coalesce(short_term_debt, 0e0) + coalesce(long_term_debt, 0e0))"
NET_DEBT = f"({DEBT} - coalesce(cash_and_equivalents, 0e0))"
QUICK = "(CASE WHEN cash_and_equivalents IS NOT NULL OR receivables IS NOT NULL THEN coalesce(cash_and_equivalents, 0e0) + coalesce(receivables, 0e0) END)"
FCF = "(operating_cash_flow - abs(capex))"
EV = f"(market_cap + {DEBT} - coalesce(cash_and_equivalents, 0e0))"
#: A quarter's flow as a year's.
YEAR = 4

sql_query(
    "win18_solvency",
    f"""SELECT entity_id, report_date, {rounded({"total_debt_asof": DEBT, "net_debt": NET_DEBT}, 4)},
    CAST(short_term_debt IS NULL AND long_term_debt IS NULL AS INT) AS is_missing_total_debt_asof,
    CAST(short_term_debt IS NULL AND long_term_debt IS NULL AND cash_and_equivalents IS NULL AS INT) AS is_missing_net_debt,
    {ratios({"debt_to_equity_signed": (DEBT, "total_equity"), "debt_to_equity_abs": (DEBT, "abs(total_equity)"), "net_debt_to_ebitda": (NET_DEBT, f"{YEAR} * ebitda")})} FROM {{fin}}""",
)
sql_query(
    "win19_liquidity",
    f"""SELECT entity_id, report_date, {ratios({"current_ratio": ("current_assets", "current_liabilities"), "quick_ratio": (QUICK, "current_liabilities"), "cash_ratio": ("cash_and_equivalents", "current_liabilities")})} FROM {{fin}}""",
)
# The latest four steps of a value that is filed again and again: a step is a row that differs from the one before.
STEPS = """s AS (SELECT *, CASE WHEN before IS NULL OR x <> before THEN x END AS step FROM (SELECT *, LASTSEEN(x) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g) a WHERE x IS NOT NULL),
 q AS (SELECT entity_id, date, sum(step) OVER w AS total, count(step) OVER w AS n FROM s WHERE step IS NOT NULL WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 3 PRECEDING)),
 t AS (SELECT entity_id, date, CASE WHEN n < 4 THEN total * (4e0 / n) ELSE total END AS ttm FROM q)"""
sql_query(
    "win02_ttm_of_steps",
    f"""WITH g AS (SELECT entity_id, date, revenue AS x FROM {{day}}), {STEPS}
    SELECT g.entity_id, g.date, round(LASTSEEN(t.ttm) OVER (PARTITION BY g.entity_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 2) AS revenue_ttm
    FROM g LEFT JOIN t ON g.entity_id = t.entity_id AND g.date = t.date""",
)
sql_query(
    "win20_cash_reality",
    f"""WITH g AS (SELECT entity_id, report_date AS date, {FCF} AS x FROM {{fin}}), {STEPS},
    r AS (SELECT g.entity_id, g.date AS report_date, g.x AS fcf, LASTSEEN(t.ttm) OVER (PARTITION BY g.entity_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ttm FROM g LEFT JOIN t ON g.entity_id = t.entity_id AND g.date = t.date),
    m AS (SELECT entity_id, report_date, max_by(market_cap, date) AS market_cap FROM {{day}} WHERE report_date IS NOT NULL GROUP BY entity_id, report_date)
    SELECT r.entity_id, r.report_date, {rounded({"free_cash_flow": "fcf", "free_cash_flow_ttm_asof": "ttm"}, 4)}, {ratios({"fcf_yield": ("ttm", "market_cap")})}
    FROM r LEFT JOIN m ON r.entity_id = m.entity_id AND r.report_date = m.report_date""",
)
CAPS = {"gross_margin": ("gross_profit", "revenue", 1.5), "operating_margin": ("ebit", "revenue", 1), "net_margin": ("net_income", "revenue", 1)}
sql_query(
    "proj08_margin_plausibility",
    "SELECT entity_id, report_date, "
    + ", ".join(f"round(CASE WHEN abs(RAT({a}, {b})) <= {cap} THEN RAT({a}, {b}) END + 1e-9, 6) AS {x}, CAST(coalesce(abs(RAT({a}, {b})) > {cap}, true) AS INT) AS is_missing_{x}, CAST(coalesce(abs({b}) < 1e-9, true) OR coalesce(abs(RAT({a}, {b})) > {cap}, false) AS INT) AS invalid_math_{x}" for x, (a, b, cap) in CAPS.items())
    + " FROM {fin_misfiled}",
)
sql_query("win_return_on_equity", f"SELECT entity_id, report_date, {ratios({'roe': (f'{YEAR} * net_income', 'total_equity')})} FROM {{fin}}")
sql_query(
    "win21_valuation",
    f"""WITH g AS (SELECT *, RAT({YEAR} * net_income, shares_outstanding) AS eps FROM {{day}} WHERE report_date IS NOT NULL)
    SELECT entity_id, date, {rounded({"enterprise_value": EV}, 2)}, {ratios({"pe_ratio_calc": ("close", "eps"), "earnings_yield_calc": ("eps", "close"), "ps_ratio_calc": ("market_cap", f"{YEAR} * revenue"), "ev_to_ebitda": (EV, f"{YEAR} * ebitda"), "pb_ratio": ("market_cap", "total_equity")})} FROM g""",
)
sql_query("win22_interest_coverage", f"SELECT entity_id, report_date, {ratios({'interest_coverage': ('ebit', 'interest_expense')})} FROM {{fin}}")
sql_query("win23_return_on_assets", f"SELECT entity_id, report_date, {ratios({'roa': (f'{YEAR} * net_income', 'total_assets')})} FROM {{fin}}")
sql_query("win24_per_share", f"SELECT entity_id, report_date, {ratios({'eps_calc': ('net_income', 'shares_outstanding'), 'book_value_per_share': ('total_equity', 'shares_outstanding'), 'revenue_per_share': ('revenue', 'shares_outstanding')})} FROM {{fin}}")
sql_query(
    "win03_ttm_growth_all",
    f"""WITH t AS (SELECT entity_id, report_date, sum(revenue) OVER w AS revenue_ttm, sum(net_income) OVER w AS net_income_ttm, sum(ebitda) OVER w AS ebitda_ttm FROM {{fin}} WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS 3 PRECEDING)),
    p AS (SELECT *, lag(revenue_ttm, 4) OVER w AS r0, lag(net_income_ttm, 4) OVER w AS n0 FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY report_date))
    SELECT entity_id, report_date, {rounded({"revenue_ttm": "revenue_ttm", "net_income_ttm": "net_income_ttm", "ebitda_ttm": "ebitda_ttm"}, 3)}, {ratios({"revenue_growth_yoy": ("revenue_ttm - r0", "abs(r0)"), "earnings_growth_yoy": ("net_income_ttm - n0", "abs(n0)")})} FROM p""",
)
sql_query(
    "win03_annual_growth",
    f"""WITH t AS (SELECT entity_id, year(report_date) AS year, sum(revenue) AS revenue, sum(net_income) AS net_income FROM {{fin}} GROUP BY entity_id, year(report_date)),
    p AS (SELECT *, lag(revenue) OVER w AS r0, lag(net_income) OVER w AS n0 FROM t WINDOW w AS (PARTITION BY entity_id ORDER BY year))
    SELECT entity_id, CAST(year AS INT) AS year, {ratios({"revenue_growth_yoy": ("revenue - r0", "abs(r0)"), "earnings_growth_yoy": ("net_income - n0", "abs(n0)")})} FROM p""",
)
# Seasonal surprise against the same quarter of the year before, in units of the surprises so far; it decays by half in 30 days after a filing.
sql_query(
    "win08_earnings_quality",
    f"""WITH g AS (SELECT entity_id, report_date, filing_date, RAT({YEAR} * (net_income - operating_cash_flow), total_assets) AS accruals, RAT(net_income, shares_outstanding) AS eps FROM {{fin}}),
    s AS (SELECT *, eps - lag(eps, 4) OVER (PARTITION BY entity_id ORDER BY report_date) AS surprise FROM g),
    d AS (SELECT *, CASE WHEN count(surprise) OVER w >= 4 THEN stddev_samp(surprise) OVER w END AS sd FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY report_date ROWS 7 PRECEDING))
    SELECT entity_id, report_date, {rounded({"accruals": "accruals", "accruals_signal": "-accruals", "eps_surprise_proxy": "surprise"})}, {rounded({"sue_score": "RAT(surprise, sd)", "pead_signal": "RAT(surprise, sd) * exp(-0.693 * 15 / 30)"}, 4)} FROM d""",
)
RET = "r AS (SELECT *, RAT(close, lag(close) OVER w) - 1 AS ret FROM {day} WINDOW w AS (PARTITION BY entity_id ORDER BY date))"
sql_query(
    "win10_merton_distance",
    f"""WITH {RET}, v AS (SELECT *, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w * sqrt(252e0) END AS vol, {DEBT} AS debt FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING)),
    a AS (SELECT *, market_cap + debt AS assets, vol * market_cap / (market_cap + debt) AS sigma FROM v WHERE market_cap > 0 AND debt > 0),
    d AS (SELECT *, CASE WHEN sigma > 1e-9 THEN greatest(-10e0, least(20e0, (ln(assets / debt) - sigma * sigma / 2) / sigma)) END AS dd FROM a)
    SELECT entity_id, date, {rounded({"merton_dd": "dd", "merton_dd_change_21d": "dd - lag(dd, 21) OVER (PARTITION BY entity_id ORDER BY date)"}, 4)} FROM d""",
)
sql_query(
    "win15_credit_signals",
    f"""WITH g AS (SELECT *, RAT(current_assets, current_liabilities) AS cr, RAT({DEBT}, abs(total_equity)) AS de, RAT(receivables, revenue / 90) AS dso, RAT(inventory, cost_of_revenue / 90) AS dio, RAT(accounts_payable, cost_of_revenue / 90) AS dpo FROM {{fin}})
    SELECT entity_id, report_date, {rounded({"cash_burn_rate_monthly": "greatest(0e0, -operating_cash_flow) / 3", "debt_maturity_pressure": f"RAT(short_term_debt, {DEBT})", "dso": "dso", "dio": "dio", "dpo": "dpo", "cash_conversion_cycle": "dso + dio - dpo"}, 4)},
    {rounded({"covenant_proximity_max": "greatest(greatest(0e0, least(1e0, 1 - cr)), greatest(0e0, least(1e0, (de - 3) / 3)))"})} FROM g""",
)
sql_query(
    "win17_forensic_divergences",
    f"""WITH p AS (SELECT *, lag(revenue) OVER w AS r0, lag(receivables) OVER w AS c0, lag(inventory) OVER w AS i0, lag(sga_expenses) OVER w AS s0 FROM {{fin}} WINDOW w AS (PARTITION BY entity_id ORDER BY report_date))
    SELECT entity_id, report_date, {rounded({"receivables_vs_revenue": "RAT(receivables - c0, abs(c0)) - RAT(revenue - r0, abs(r0))", "inventory_vs_revenue": "RAT(inventory - i0, abs(i0)) - RAT(revenue - r0, abs(r0))", "capex_to_depreciation": "RAT(abs(capex), depreciation)", "soft_assets": "RAT(total_assets - ppe_net - coalesce(cash_and_equivalents, 0e0), total_assets)", "cash_conversion": "RAT(operating_cash_flow, net_income)"})} FROM p""",
)
sql_query(
    "win86_operational_efficiency",
    f"""WITH g AS (SELECT entity_id, report_date, RAT({YEAR} * revenue, total_assets) AS asset_turnover, RAT({YEAR} * cost_of_revenue, inventory) AS inventory_turnover, RAT({YEAR} * revenue, receivables) AS receivables_turnover FROM {{fin}})
    SELECT entity_id, report_date, {rounded({x: x for x in ("asset_turnover", "inventory_turnover", "receivables_turnover")})}, {rounded({x + "_change": f"{x} - lag({x}, 4) OVER w" for x in ("asset_turnover", "inventory_turnover", "receivables_turnover")})} FROM g WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)""",
)
sql_query(
    "win85_input_cost_pressure",
    f"""WITH g AS (SELECT entity_id, report_date, RAT(cost_of_revenue, revenue) AS y, row_number() OVER (PARTITION BY entity_id ORDER BY report_date) AS k, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {{fin}})
    SELECT entity_id, count(y) AS n, {rounded({"slope_per_year": f"CASE WHEN count(y) >= 4 THEN regr_slope(y, CAST(k AS DOUBLE)) * {YEAR} END"})} FROM g WHERE back <= 8 GROUP BY entity_id""",
)
sql_query(
    "win83_rd_acceleration",
    f"""WITH g AS (SELECT entity_id, report_date AS date, research_and_development AS x FROM {{fin}}), {STEPS.split(", q AS")[0].rstrip().rstrip(",")},
    k AS (SELECT entity_id, date, step, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM s WHERE step IS NOT NULL)
    SELECT entity_id, CAST(count(*) AS BIGINT) AS n_steps, {rounded({"rd_acceleration": "CASE WHEN count(*) >= 3 THEN RAT(max(CASE WHEN back = 1 THEN step END), avg(CASE WHEN back > 1 THEN step END)) END"})} FROM k GROUP BY entity_id""",
)
sql_query(
    "win92_revenue_diversification",
    f"""WITH g AS (SELECT entity_id, report_date, RAT(gross_profit, revenue) AS m FROM {{fin}}), p AS (SELECT *, m - lag(m, 4) OVER (PARTITION BY entity_id ORDER BY report_date) AS change FROM g)
    SELECT entity_id, report_date, {rounded({"margin": "m", "margin_change": "change"})}, CASE WHEN change > 0.02 THEN 'richer mix' WHEN change < -0.02 THEN 'poorer mix' WHEN change IS NOT NULL THEN 'stable' END AS mix FROM p""",
)
sql_query("fc63_cash_runway", f"SELECT entity_id, report_date, {rounded({'runway_days': 'CASE WHEN operating_cash_flow < 0 THEN RAT(cash_and_equivalents, -operating_cash_flow / 3) * 30 END'}, 3)} FROM {{fin}}")
sql_query("graph06_srisk", f"SELECT entity_id, date, {rounded({'srisk': f'greatest(0e0, 0.08 * {DEBT} - 0.92 * market_cap * 0.6)'}, 3)} FROM {{day}} WHERE market_cap IS NOT NULL")
