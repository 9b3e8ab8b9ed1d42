"""Frames that the tables lack, made from them by fixed rules: holes, dirt, raw texts and labels for operators to work on.

Operators name these frames and take any frame with the same columns instead;
no rule of this kind is inside an operator's text.
"""

#: Where each field of a statement has no value.
HOLES = {
    "revenue": "CASE WHEN (entity_id + month(report_date)) % 11 <> 0 THEN revenue END", "cost_of_revenue": "CASE WHEN entity_id % 3 <> 0 THEN cost_of_revenue END", "gross_profit": "CASE WHEN (entity_id + year(report_date)) % 4 <> 0 THEN gross_profit END",
    "total_assets": "CASE WHEN entity_id % 5 <> 1 THEN total_assets END", "total_liabilities": "CASE WHEN entity_id % 5 <> 2 THEN total_liabilities END", "total_equity": "CASE WHEN entity_id % 5 <> 3 THEN total_equity END",
    "operating_cash_flow": "operating_cash_flow", "capex": "CASE WHEN quarter(report_date) <> 3 THEN capex END",
}
#: Names that vendors give to fields, one of them for each order line.
RAW = ["totalRevenue", "SALES", "Net Income", "Assets", "capitalExpenditure", "mystery", "total_assets", "StockholdersEquity", "NetIncomeLoss"]
_P2 = "lpad(CAST({} AS VARCHAR(9)), 2, '0')".format
_DAY = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd FROM {orders}"
_CASES = lambda of, names: f"CASE {of} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names[:-1])) + f" ELSE '{names[-1]}' END"

FIXTURES = {
    "fin_gaps": f"SELECT entity_id, report_date, filing_date, {', '.join(f'{e} AS {k}' for k, e in HOLES.items())} FROM {{fin}}",
    "fin_flagged": "SELECT g.*, CASE WHEN entity_id % 4 = 0 THEN 0 ELSE CAST(revenue IS NULL AS INT) END AS is_missing_revenue, CAST(capex IS NULL AS INT) AS is_missing_capex, CASE WHEN entity_id % 6 = 0 AND revenue IS NOT NULL THEN 1 ELSE 0 END AS invalid_math_revenue, 0 AS invalid_math_capex FROM {fin_gaps} g",
    "fin_misdated": "SELECT entity_id, report_date, CASE WHEN (entity_id + month(report_date)) % 5 = 0 THEN CAST(report_date - INTERVAL 3 DAY AS DATE) ELSE filing_date END AS filing_date, revenue FROM {fin}",
    "fin_amended": "SELECT * FROM {fin_misdated} UNION ALL SELECT entity_id, report_date, CAST(filing_date + INTERVAL 63 DAY AS DATE), revenue * 1.15 FROM {fin_misdated} WHERE entity_id % 3 = 0",
    # revenue of every ninth supplier is as filed at another frequency, so that some margins are impossible
    "fin_misfiled": "SELECT entity_id, report_date, gross_profit, ebit, net_income, CASE WHEN entity_id % 9 = 0 THEN revenue / 8 ELSE revenue END AS revenue FROM {fin}",
    "statement_dates": "SELECT entity_id, 'income' AS statement, report_date FROM {fin} UNION ALL SELECT entity_id, 'balance', report_date FROM {fin} WHERE quarter(report_date) % 2 = 0 UNION ALL SELECT entity_id, 'cashflow', report_date FROM {fin} WHERE quarter(report_date) = 4",
    "profiles": f"SELECT entity_id, nation, region, balance, {_CASES('entity_id % 6', ['technology', 'energy', 'banking', 'retail', 'healthcare', 'utilities'])} AS sector FROM {{peers}}",
    "raw_lines": f"SELECT l_suppkey AS entity_id, raw, l_extendedprice AS value FROM {{lineitem}} JOIN (VALUES {', '.join(f'({k}, {n!r})' for k, n in enumerate(RAW))}) AS t(k, raw) ON l_orderkey % {len(RAW)} = k",
    "raw_concepts": "SELECT raw, entity_id, value, CASE WHEN entity_id % 2 = 0 THEN concat('us-gaap:', raw) ELSE raw END AS concept FROM {raw_lines}",
    "raw_period_types": f"SELECT entity_id, report_date, {_CASES('entity_id % 6', [' 10-Q', 'q', 'Quarter ', '10-K', 'H1', 'odd'])} AS raw FROM {{fin}}",
    "raw_dates": f"SELECT o_orderkey, concat(CAST(y - 1911 AS VARCHAR(9)), '/', {_P2('m')}, '/', {_P2('dd')}) AS roc, concat('H', CAST(y - 1988 AS VARCHAR(9)), '.', {_P2('m')}, '.', {_P2('dd')}) AS era FROM ({_DAY}) dt",
    "raw_periods": f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(y AS VARCHAR(9)) WHEN 1 THEN concat(CAST(y AS VARCHAR(9)), '-', {_P2('m')}) ELSE concat(CAST(y AS VARCHAR(9)), '-Q', CAST(quarter(d) AS VARCHAR(9))) END AS period FROM ({_DAY}) dt",
    "raw_since": f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(y AS VARCHAR(9)) WHEN 1 THEN concat(CAST(y AS VARCHAR(9)), '-', {_P2('m')}) WHEN 2 THEN 'current' ELSE CAST(d AS VARCHAR(12)) END AS raw FROM ({_DAY}) dt",
    "raw_horizons": f"SELECT o_orderkey, concat(CAST(o_custkey % 9 + 1 AS VARCHAR(9)), {_CASES('o_orderkey % 4', ['d', 'w', 'm', 'y'])}) AS horizon FROM {{orders}}",
    "raw_amounts": "SELECT concat(CASE WHEN l_orderkey % 2 = 0 THEN '(' ELSE '' END, CASE WHEN k >= 1000 THEN concat(CAST(CAST(floor(k / 1000) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(k % 1000 AS VARCHAR(9)), 3, '0')) ELSE CAST(k AS VARCHAR(20)) END, CASE WHEN l_orderkey % 2 = 0 THEN ')' ELSE '' END) AS raw FROM (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS k FROM {lineitem}) t",
    "raw_sectors": f"SELECT s_suppkey, {_CASES('s_suppkey % 6', ['Electronic Computers', 'Crude Petroleum', 'State Commercial Banks', 'Retail-Variety Stores', 'Pharmaceutical Preparations', 'Electric Services'])} AS raw FROM {{supplier}}",
    # a member counts from some days after its first one, and every second member until some days before its last one; ends may be open
    "memberships": "SELECT entity_id, min(date) + INTERVAL 200 DAY AS begins, CASE WHEN entity_id % 2 = 1 THEN max(date) - INTERVAL 300 DAY END AS ends FROM {px} GROUP BY entity_id",
    "annual_reports": "SELECT entity_id, year(report_date) AS year, sum(revenue) * (1 + 0.01 * (entity_id % 5 - 2)) AS annual FROM {fin} GROUP BY entity_id, year(report_date)",
    "tiers": "SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier FROM {peers}",
    "trending": "SELECT entity_id, CAST(entity_id % 2 = 0 AS INT) AS trends FROM {peers}",
    "kept_entities": "SELECT entity_id FROM {peers} WHERE entity_id % 10 = 0",
    "targets": "SELECT entity_id FROM {peers} WHERE entity_id % 10 = 0",
    "level_overrides": "SELECT entity_id, 'debt_to_equity' AS metric, 4e0 AS level FROM {peers} WHERE entity_id % 10 = 0",
    "expert_weights": "SELECT entity_id, 'last' AS model, 0.5e0 AS weight FROM {peers} WHERE entity_id % 2 = 0 UNION ALL SELECT entity_id, 'expert', 0.1e0 FROM {peers} WHERE entity_id % 3 = 0",
}
