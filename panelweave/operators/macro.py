"""Countries, peers and events around a panel: macro joins, conflict, competition, flows, sector and cross-asset signals."""

from panelweave.operators.names import resolved
from panelweave.operators.survival import DEBT
from panelweave.sqlops import ratios, rounded, sql_query

W = "(PARTITION BY entity_id ORDER BY date)"
RET = f"r AS (SELECT *, RAT(close, lag(close) OVER {W}) - 1 AS ret FROM {{px}})"
HOME = "h AS (SELECT r.*, p.nation AS country, p.region FROM r JOIN {peers} p ON p.entity_id = r.entity_id)"

sql_query("join02_asof_fill", f"SELECT entity_id, date, CAST(receivables IS NULL AND LASTSEEN(receivables) OVER w IS NOT NULL AS INT) AS filled, {rounded({'receivables': 'coalesce(receivables, LASTSEEN(receivables) OVER w)'}, 3)} FROM {{day}} WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
PANEL_COLUMNS = {x: x for x in ("close", "volume", "revenue", "total_assets", "operating_cash_flow")}
sql_query("join05_entity_panel", f"SELECT d.entity_id, d.date, d.report_date, p.nation, p.region, p.sector, {rounded(PANEL_COLUMNS, 3)}, {', '.join(f'CAST({x} IS NULL AS INT) AS is_missing_{x}' for x in PANEL_COLUMNS)} FROM {{day}} d JOIN {{profiles}} p ON p.entity_id = d.entity_id")
sql_query("join06_all_entities", "SELECT p.region, d.entity_id, count(*) AS n_days, count(d.report_date) AS n_known, min(d.date) AS first_day, max(d.date) AS last_day FROM {day} d JOIN {peers} p ON p.entity_id = d.entity_id GROUP BY p.region, d.entity_id")
sql_query("join08_macro_merge", f"WITH {RET}, {HOME} SELECT h.entity_id, h.date, {rounded({'inflation': 'm.inflation', 'unemployment_rate': 'm.unemployment_rate', 'return_1d': 'ret', 'real_return_1d': 'ret - m.inflation / 100 / 252'})} FROM h LEFT JOIN {{macro}} m ON m.country = h.country AND m.date = MONTH_OF(h.date)")
sql_query(
    "join09_enrichment",
    f"""WITH {RET}, {HOME}, f AS (SELECT country, date, CAST(credit_spread > 5 OR fx_volatility > 20 AS INT) AS stressed FROM {{macro}}), g AS (SELECT country, date, greatest(0e0, least(1e0, (gdp - 100) / 400)) AS protection FROM {{macro}})
    SELECT h.entity_id, h.date, coalesce(f.stressed, 0) AS stressed, {rounded({"gdp": "m.gdp", "protection": "g.protection"}, 4)} FROM h LEFT JOIN {{macro}} m ON m.country = h.country AND m.date = MONTH_OF(h.date) LEFT JOIN f ON f.country = h.country AND f.date = MONTH_OF(h.date) LEFT JOIN g ON g.country = h.country AND g.date = MONTH_OF(h.date)""",
)
# Yearly values of odd years only, so that even years take the one before; the calendar and the values are united and carried forward.
YEARLY = """y AS (SELECT country, CAST(year(date) AS INT) AS year, max_by(gdp, date) AS gdp, max_by(inflation, date) AS inflation FROM {macro} GROUP BY country, year(date)), o AS (SELECT * FROM y WHERE year % 2 = 1),
 k AS (SELECT DISTINCT p.nation AS country, CAST(year(x.date) AS INT) AS year FROM {px} x JOIN {peers} p ON p.entity_id = x.entity_id), u AS (SELECT country, year, 0 AS side, gdp, inflation, year AS known FROM o UNION ALL SELECT country, year, 1, NULL, NULL, NULL FROM k),
 c AS (SELECT country, year, side, LASTSEEN(gdp) OVER w AS gdp, LASTSEEN(inflation) OVER w AS inflation, LASTSEEN(known) OVER w AS known FROM u WINDOW w AS (PARTITION BY country ORDER BY year, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), a AS (SELECT * FROM c WHERE side = 1)"""
sql_query("join10_yearly_to_daily", f"WITH {YEARLY} SELECT x.entity_id, x.date, a.known AS gdp_year, {rounded({'gdp': 'a.gdp'}, 4)} FROM {{px}} x JOIN {{peers}} p ON p.entity_id = x.entity_id LEFT JOIN a ON a.country = p.nation AND a.year = year(x.date)")
sql_query("join11_multi_indicator", f"WITH {YEARLY} SELECT x.entity_id, x.date, {rounded({'gdp': 'a.gdp', 'inflation': 'a.inflation'}, 4)}, CAST(a.gdp IS NULL AS INT) AS is_missing_gdp, CAST(a.inflation IS NULL AS INT) AS is_missing_inflation FROM {{px}} x JOIN {{peers}} p ON p.entity_id = x.entity_id LEFT JOIN a ON a.country = p.nation AND a.year = year(x.date)")
sql_query("join12_relationship_validity", f"SELECT p.region, x.date, count(*) AS members, {rounded({'mean_close': 'avg(x.close)'}, 4)} FROM {{px}} x JOIN {{memberships}} v ON v.entity_id = x.entity_id AND x.date >= v.begins AND (v.ends IS NULL OR x.date <= v.ends) JOIN {{peers}} p ON p.entity_id = x.entity_id GROUP BY p.region, x.date")
sql_query(
    "join18_frequency_backfill",
    f"""WITH g AS (SELECT entity_id, report_date, year(report_date) AS year, CASE WHEN quarter(report_date) <> 2 THEN revenue END AS revenue, CASE WHEN quarter(report_date) <> 2 THEN inventory END AS inventory FROM {{fin}}), a AS (SELECT entity_id, year(report_date) AS year, sum(revenue) AS revenue, max_by(inventory, report_date) AS inventory FROM {{fin}} GROUP BY entity_id, year(report_date)), p AS (SELECT *, lag(inventory) OVER (PARTITION BY entity_id ORDER BY year) AS known FROM a)
    SELECT g.entity_id, g.report_date, CAST(g.revenue IS NULL AS INT) AS backfilled, {rounded({"revenue": "coalesce(g.revenue, p.revenue / 4)", "inventory": "coalesce(g.inventory, p.known)"}, 3)} FROM g LEFT JOIN p ON p.entity_id = g.entity_id AND p.year = g.year""",
)
# Blocked by country; the best candidate of each query by score.
sql_query(
    "join19_entity_resolution",
    f"""WITH b AS (SELECT s_suppkey, c_custkey, CASE WHEN s_suppkey = c_custkey THEN 40 ELSE 0 END + 30 * (1 - levenshtein(s_name, c_name) / CAST(greatest(length(s_name), length(c_name)) AS DOUBLE)) + 15 + CASE WHEN (s_acctbal > 0) = (c_acctbal > 0) THEN 15 ELSE 0 END AS score FROM {{supplier}} JOIN {{customer}} ON s_nationkey = c_nationkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(score, 6) DESC, c_custkey) AS place FROM b) SELECT s_suppkey, c_custkey, {rounded({"score": "score"}, 4)}, CAST(score >= 70 AS INT) AS accepted FROM k WHERE place = 1""",
    resolved,
)
LOG = f"""{RET}, n AS (SELECT *, row_number() OVER {W} AS k, avg(ret) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) AS drift, stddev_samp(ret) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) AS sd, lead(close, 5) OVER {W} AS later, lead(date, 5) OVER {W} AS target_date FROM r),
 g AS (SELECT entity_id, date AS run_date, target_date, close, close * (1 + 5 * drift) AS predicted, close * 1.645 * sd * sqrt(5e0) AS width, later AS actual FROM n WHERE k % 21 = 0 AND drift IS NOT NULL)"""
sql_query("join23_fill_actuals", f"WITH {LOG} SELECT entity_id, run_date, target_date, {rounded({'predicted': 'predicted', 'actual': 'actual'}, 4)}, CAST(sign(predicted - close) AS INT) AS predicted_direction, CAST(sign(actual - close) AS INT) AS actual_direction, CAST(sign(predicted - close) = sign(actual - close) AS INT) AS hit FROM g")
sql_query("join24_forward_return", f"WITH {LOG} SELECT entity_id, run_date, {rounded({'actual_return': 'RAT(actual, close) - 1'})} FROM g")
sql_query("join25_retrospective", f"WITH {LOG} SELECT entity_id, run_date, {rounded({'error': 'predicted - actual', 'pct_error': '100 * RAT(predicted - actual, actual)'}, 4)}, CAST(abs(predicted - actual) <= width AS INT) AS in_bounds FROM g WHERE actual IS NOT NULL")
sql_query("join26_reverse_stress", f"WITH q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back, {DEBT} AS debt FROM {{fin}}), s AS (SELECT entity_id, a, b, sqrt(a * a + b * b) AS distance FROM q CROSS JOIN (VALUES (0e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) AS x(a) CROSS JOIN (VALUES (0e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0)) AS y(b) WHERE back = 1 AND (current_assets * (1 - a) / (current_liabilities * (1 + b)) < 1 OR debt * (1 + b) > 3 * (total_equity - a * total_assets))) SELECT entity_id, {rounded({'distance': 'min(distance)'})}, count(*) AS n_breaching FROM s GROUP BY entity_id")
sql_query("join27_relative_metrics", f"WITH g AS (SELECT p.region, d.date, d.entity_id, RAT(d.net_income, d.revenue) AS margin, RAT(d.current_assets, d.current_liabilities) AS cr FROM {{day}} d JOIN {{peers}} p ON p.entity_id = d.entity_id), a AS (SELECT region, date, avg(margin) AS m, avg(cr) AS c FROM g GROUP BY region, date) SELECT g.entity_id, g.date, {rounded({'margin_minus_group': 'g.margin - a.m', 'current_ratio_over_group': 'RAT(g.cr, a.c)'})} FROM g JOIN a ON a.region = g.region AND a.date = g.date")
sql_query(
    "agg04_resample_with_partial_flag",
    f"""WITH f AS (SELECT x.*, freq, CAST(CASE freq WHEN 'W' THEN date_trunc('week', date) WHEN 'M' THEN date_trunc('month', date) WHEN 'Q' THEN date_trunc('quarter', date) ELSE date_trunc('year', date) END AS DATE) AS period FROM {{px}} x CROSS JOIN (VALUES ('W'), ('M'), ('Q'), ('A')) AS t(freq) WHERE date <= CAST('2000-05-17' AS DATE)),
    g AS (SELECT entity_id, freq, period, min_by(open, date) AS open, max(high) AS high, min(low) AS low, max_by(close, date) AS close, sum(volume) AS volume FROM f GROUP BY entity_id, freq, period)
    SELECT entity_id, freq, period, {rounded({x: x for x in ("open", "high", "low", "close", "volume")}, 4)}, CAST(CASE freq WHEN 'W' THEN period + INTERVAL 7 DAY WHEN 'M' THEN period + INTERVAL 1 MONTH WHEN 'Q' THEN period + INTERVAL 3 MONTH ELSE period + INTERVAL 12 MONTH END > CAST('2000-05-18' AS DATE) AS INT) AS is_partial_period FROM g""",
)
BUYERS = "b AS (SELECT l_suppkey AS entity_id, n_name AS country, count(*) AS n, sum(l_extendedprice) AS v FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY l_suppkey, n_name)"
sql_query("agg08_country_hhi", f"WITH {BUYERS}, s AS (SELECT entity_id, country, n / sum(CAST(n AS DOUBLE)) OVER (PARTITION BY entity_id) AS share FROM b) SELECT entity_id, count(*) AS n_countries, {rounded({'hhi': 'sum(share * share)'})} FROM s GROUP BY entity_id")
sql_query("agg09_market_share_hhi", "WITH e AS (SELECT l_partkey % 50 AS market, l_suppkey AS entity_id, sum(l_extendedprice) AS v FROM {lineitem} GROUP BY l_partkey % 50, l_suppkey), s AS (SELECT market, v / sum(v) OVER (PARTITION BY market) AS share FROM e) SELECT market, count(*) AS n, round(sum(share * share) + 1e-9, 6) AS hhi FROM s GROUP BY market")
#: Urgent finished orders stand for events of conflict in the buyer's country, their value for what they cost.
CONFLICT = """ev AS (SELECT n_name AS country, CAST(o_orderdate AS DATE) AS date, floor(o_totalprice / 5e4) AS fatalities, o_custkey % 3 + 1 AS kind FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), z AS (SELECT max(date) AS today FROM ev),
 cw AS (SELECT country, sum(CASE WHEN DAYS(date, today) <= 30 THEN 1 ELSE 0 END) AS e30, sum(CASE WHEN DAYS(date, today) <= 90 THEN 1 ELSE 0 END) AS e90, sum(CASE WHEN DAYS(date, today) > 90 AND DAYS(date, today) <= 180 THEN 1 ELSE 0 END) AS p90, sum(CASE WHEN DAYS(date, today) <= 30 THEN fatalities ELSE 0 END) AS f30, max(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS war, count(*) AS n FROM ev CROSS JOIN z GROUP BY country)"""
EVENT_SCORE = "(CASE WHEN e30 = 0 THEN 0e0 WHEN e30 < 10 THEN e30 / 20e0 WHEN e30 < 50 THEN 0.5 + (e30 - 10) / 80e0 ELSE least(0.8 + (e30 - 50) / 750e0, 1e0) END)"
INTENSITY = f"round(least(1e0, greatest(0e0, 0.4 * {EVENT_SCORE} + 0.2 * least(1e0, log10(f30 + 1e0) / 4) + 0.25 * CASE WHEN war = 1 AND e90 > 5 THEN 0.6e0 ELSE 0.2e0 END)) + 1e-9, 3)"
sql_query("proj22_conflict_intensity", f"WITH {CONFLICT} SELECT country, {INTENSITY} AS intensity FROM cw")
sql_query("agg15_conflict_windows_full", f"WITH {CONFLICT} SELECT country, CAST(e30 AS BIGINT) AS events_30d, CAST(e90 AS BIGINT) AS events_90d, CAST(f30 AS BIGINT) AS fatalities_30d, CASE WHEN war = 1 AND e90 > 50 THEN 'interstate_war' WHEN war = 1 THEN 'civil_war' WHEN e90 = 0 THEN 'none' ELSE 'low_intensity' END AS conflict_type, CASE WHEN p90 > 0 AND e90 / CAST(p90 AS DOUBLE) > 1.5 THEN 'escalating' WHEN p90 > 0 AND e90 / CAST(p90 AS DOUBLE) < 0.5 THEN 'de-escalating' WHEN p90 = 0 AND e90 > 10 THEN 'escalating' ELSE 'stable' END AS trend FROM cw")
sql_query("agg16_conflict_assessment", f"WITH {CONFLICT} SELECT country, {INTENSITY} AS intensity, CASE WHEN {INTENSITY} > 0.7 THEN 'high' WHEN {INTENSITY} > 0.3 THEN 'medium' ELSE 'low' END AS risk, CAST({INTENSITY} > 0.7 AS INT) AS country_conflict_flag FROM cw")
ASSESSED = f"{CONFLICT}, ci AS (SELECT country, {INTENSITY} AS intensity FROM cw)"
sql_query("agg17_linked_conflict", f"WITH {ASSESSED} SELECT p.region, count(*) AS n, {rounded({'mean_risk': 'avg(coalesce(intensity, 0e0))', 'max_risk': 'max(coalesce(intensity, 0e0))', 'exposed_share': 'avg(CASE WHEN intensity > 0.1 THEN 1e0 ELSE 0e0 END)'})} FROM {{peers}} p LEFT JOIN ci ON ci.country = p.nation GROUP BY p.region")
sql_query("agg18_product_weighted_conflict", f"WITH {ASSESSED}, {BUYERS} SELECT b.entity_id, {rounded({'exposure': 'sum(v * coalesce(intensity, 0e0)) / sum(v)'})} FROM b LEFT JOIN ci ON ci.country = b.country GROUP BY b.entity_id")
sql_query("agg14_geographic_columns", f"WITH {ASSESSED}, {BUYERS}, s AS (SELECT b.*, v / sum(v) OVER (PARTITION BY entity_id) AS share FROM b) SELECT s.entity_id, count(*) AS n_countries, {rounded({"geo_hhi": "sum(share * share)", "top_share": "max(share)", "china_share": "sum(CASE WHEN s.country LIKE 'CHINA%' THEN share ELSE 0e0 END)", "conflict_share": "sum(CASE WHEN intensity > 0.1 THEN share ELSE 0e0 END)"})} FROM s LEFT JOIN ci ON ci.country = s.country GROUP BY s.entity_id")
sql_query("agg19_supply_chain_stress", f"WITH {ASSESSED}, q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {{fin}}), g AS (SELECT p.region, avg(coalesce(intensity, 0e0)) AS geo, avg(CASE WHEN current_assets < current_liabilities OR net_income < 0 THEN 1e0 ELSE 0e0 END) AS weak FROM q JOIN {{peers}} p ON p.entity_id = q.entity_id LEFT JOIN ci ON ci.country = p.nation WHERE back = 1 GROUP BY p.region) SELECT region, {rounded({'stress_score': '0.5 * geo + 0.5 * weak'})}, CAST(0.5 * geo + 0.5 * weak > 0.5 AS INT) AS supply_chain_stress_flag FROM g")
sql_query("agg68_conflict_z_score", f"WITH {CONFLICT}, d AS (SELECT country, e30, (n - e30) / 60e0 AS base FROM cw) SELECT country, {rounded({'z_score': 'CASE WHEN base > 1 THEN 1 / (1 + exp(-(e30 - base) / sqrt(base))) ELSE least(1e0, log10(e30 + 1e0) / 2) END'})} FROM d")
sql_query("agg75_conflict_on_panel", f"WITH {ASSESSED} SELECT x.entity_id, x.date, coalesce(ci.intensity, 0e0) AS conflict_intensity_score, CAST(coalesce(ci.intensity, 0e0) > 0.1 AS INT) AS country_conflict_flag FROM {{px}} x JOIN {{peers}} p ON p.entity_id = x.entity_id LEFT JOIN ci ON ci.country = p.nation")
sql_query("agg76_time_varying_conflict", f"WITH {ASSESSED}, s AS (SELECT country, min(date) + INTERVAL 365 DAY AS start FROM ev GROUP BY country) SELECT x.entity_id, x.date, CASE WHEN x.date < s.start OR s.start IS NULL THEN 0e0 ELSE coalesce(ci.intensity, 0e0) END AS conflict_intensity_score FROM {{px}} x JOIN {{peers}} p ON p.entity_id = x.entity_id LEFT JOIN ci ON ci.country = p.nation LEFT JOIN s ON s.country = p.nation")
# Firms of a region compete: one row per firm, against the sums of its market.
MARKET = """k AS (SELECT entity_id, max_by(close, date) AS close FROM {px} GROUP BY entity_id), q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {fin}),
 fm AS (SELECT p.region, q.entity_id, q.revenue, RAT(q.ebit, q.revenue) AS margin, k.close * q.shares_outstanding AS cap, q.revenue / sum(q.revenue) OVER (PARTITION BY p.region) AS share, count(*) OVER (PARTITION BY p.region) AS n, sum(q.revenue) OVER (PARTITION BY p.region) AS total, avg(RAT(q.ebit, q.revenue)) OVER (PARTITION BY p.region) AS mean_margin FROM q JOIN k ON k.entity_id = q.entity_id JOIN {peers} p ON p.entity_id = q.entity_id WHERE back = 1)"""
PRESSURE = "greatest(0e0, least(1e0, 0.3 * (1 - 1 / (1 + (n - 1) / 5e0)) + 0.4 * (1 - least(1e0, 3 * share)) + 0.3 * CASE WHEN n * mean_margin - margin > 0 THEN greatest(0e0, 1 - margin * (n - 1) / (n * mean_margin - margin)) ELSE 0.3e0 END))"
sql_query("agg55_competitive_pressure", f"WITH {MARKET}, c AS (SELECT region, entity_id, {PRESSURE} AS pressure FROM fm WHERE n > 1) SELECT region, entity_id, {rounded({'pressure': 'pressure'})}, CASE WHEN pressure > 0.7 THEN 'high' WHEN pressure > 0.4 THEN 'moderate' ELSE 'low' END AS label FROM c")
COURNOT = f"{MARKET}, c AS (SELECT *, CASE WHEN margin > 0 THEN 1 - margin ELSE 0.8e0 END AS cost FROM fm WHERE n > 1), e AS (SELECT *, greatest(0e0, 1 - cost) AS quantity FROM c)"
sql_query("agg56_cournot", f"WITH {COURNOT} SELECT region, entity_id, {rounded({'equilibrium_share': 'coalesce(RAT(quantity, sum(quantity) OVER (PARTITION BY region)), 1e0 / n)', 'equilibrium_price': 'greatest(0e0, 1 - sum(quantity) OVER (PARTITION BY region) / (n + 1))'})} FROM e")
sql_query("agg79_competitive_bundle", f"WITH {MARKET} SELECT region, entity_id, CAST(n AS INT) AS n_firms, {rounded({'market_share': 'share', 'pressure': PRESSURE})}, CASE WHEN rank() OVER (PARTITION BY region ORDER BY cap DESC) = 1 THEN 'leader' ELSE 'follower' END AS role FROM fm WHERE n > 1")
# Customers stand for holders of the suppliers that they buy from.
HOLD = "hl AS (SELECT l_suppkey AS entity_id, o_custkey AS holder, sum(l_quantity) AS shares FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey), hs AS (SELECT *, shares / sum(shares) OVER (PARTITION BY entity_id) AS part, row_number() OVER (PARTITION BY entity_id ORDER BY shares DESC, holder) AS place FROM hl)"
sql_query("agg58_common_ownership", f"WITH {HOLD}, m AS (SELECT hs.*, max(CASE WHEN t.entity_id IS NOT NULL THEN part END) OVER (PARTITION BY holder) AS target FROM hs LEFT JOIN {{targets}} t ON t.entity_id = hs.entity_id) SELECT entity_id, count(target) AS matched, {rounded({'mhhi_delta': 'least(1e0, coalesce(sum(part * target) / nullif(sum(target * target), 0e0), 0e0))'})} FROM m GROUP BY entity_id")
sql_query("agg59_liquidation_pressure", f"WITH {HOLD}, v AS (SELECT entity_id, avg(volume) AS adv FROM {{px}} GROUP BY entity_id) SELECT hs.entity_id, {rounded({'days_to_liquidate': 'sum(CASE WHEN place <= 5 THEN shares ELSE 0e0 END) / (max(adv) * 0.2)'}, 4)}, CAST(sum(CASE WHEN place <= 5 THEN 1 ELSE 0 END) AS INT) AS n_holders FROM hs JOIN v ON v.entity_id = hs.entity_id GROUP BY hs.entity_id")
sql_query("graph09_ownership_bundle", f"WITH {HOLD}, d AS (SELECT holder, count(*) AS degree FROM hs GROUP BY holder) SELECT hs.entity_id, count(*) AS n_holders, {rounded({'holder_hhi': 'sum(part * part)', 'top5_share': 'sum(CASE WHEN place <= 5 THEN part ELSE 0e0 END)', 'mean_holder_degree': 'avg(CAST(degree AS DOUBLE))', 'crowding': 'sum(part * CASE WHEN degree > 1 THEN 1e0 ELSE 0e0 END)'})} FROM hs JOIN d ON d.holder = hs.holder GROUP BY hs.entity_id")
sql_query("join21_ownership_projection", f"WITH {HOLD}, d AS (SELECT holder, count(*) AS degree FROM hs GROUP BY holder) SELECT hs.entity_id, CAST(sum(degree - 1) AS BIGINT) AS links, {rounded({'weighted': 'sum(part * (degree - 1))'}, 5)} FROM hs JOIN d ON d.holder = hs.holder GROUP BY hs.entity_id")
#: The latest two months of each country.
TWO = "t2 AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS back FROM {macro}), lm AS (SELECT country, max(CASE WHEN back = 1 THEN gdp END) AS g1, max(CASE WHEN back = 2 THEN gdp END) AS g0, max(CASE WHEN back = 1 THEN inflation END) AS i1, max(CASE WHEN back = 1 THEN unemployment_rate END) AS u1, max(CASE WHEN back = 2 THEN unemployment_rate END) AS u0, max(CASE WHEN back = 1 THEN lending_rate END) AS l1, max(CASE WHEN back = 2 THEN lending_rate END) AS l0, max(CASE WHEN back = 1 THEN spending END) AS s1, max(CASE WHEN back = 2 THEN spending END) AS s0 FROM t2 GROUP BY country)"
DRAG = "(CASE WHEN i1 > 5 THEN -0.5 - (i1 - 5) * 0.05 WHEN i1 > 3 THEN -(i1 - 2) * 0.15 WHEN i1 > 0 THEN 0e0 ELSE least(0.1e0, abs(i1) * 0.05) END)"
JOBS = "greatest(-1e0, least(0.2e0, -greatest(0e0, u1 - 5) * 0.1 - (u1 - u0) * 0.2))"
RATES = "greatest(-0.5e0, least(0.2e0, -greatest(0e0, l1 - 3) * 0.05 - (l1 - l0) * 0.1))"
SPEND = "greatest(-1e0, least(1e0, coalesce(RAT(s1 - s0, abs(s0)), 0e0)))"
sql_query("agg71_unemployment_impact", f"WITH {TWO} SELECT country, {rounded({'impact': JOBS})} FROM lm")
sql_query("agg72_inflation_drag", f"WITH {TWO} SELECT country, {rounded({'drag': DRAG})} FROM lm")
sql_query("agg73_spending_momentum", f"WITH {TWO} SELECT country, {rounded({'momentum': SPEND})} FROM lm")
sql_query("agg74_rate_impact", f"WITH {TWO} SELECT country, {rounded({'impact': RATES})} FROM lm")
REAL = "rg AS (SELECT entity_id, RAT(max_by(revenue, report_date), min_by(revenue, report_date)) - 1 AS nominal FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {fin}) q WHERE back <= 5 GROUP BY entity_id)"
sql_query("agg70_real_revenue_growth", f"WITH {TWO}, {REAL} SELECT rg.entity_id, {rounded({'real_growth': 'nominal - coalesce(i1, 0e0) / 100'})} FROM rg JOIN {{peers}} p ON p.entity_id = rg.entity_id LEFT JOIN lm ON lm.country = p.nation")
DEMAND = f"greatest(-1e0, least(1e0, {SPEND} * 0.35 + {DRAG} * 0.25 + {JOBS} * 0.2 + {RATES} * 0.2))"
sql_query("agg69_buying_power", f"WITH {TWO}, {REAL}, d AS (SELECT rg.entity_id, {DEMAND} AS demand, nominal - i1 / 100 AS growth FROM rg JOIN {{peers}} p ON p.entity_id = rg.entity_id JOIN lm ON lm.country = p.nation), b AS (SELECT *, greatest(0e0, least(100e0, 50 + demand * 30 + CASE WHEN growth > 0.05 THEN 10 WHEN growth < -0.05 THEN -10 ELSE 0 END)) AS bpi FROM d) SELECT entity_id, {rounded({'sector_demand_momentum': 'demand', 'buying_power_index': 'bpi'}, 4)}, CAST(demand < -0.3 OR bpi < 35 AS INT) AS demand_risk_flag FROM b")
sql_query("anal48_macro_regime_composite", f"WITH {TWO}, v AS (SELECT country, CAST(g1 < g0 AS INT) + CAST(i1 > 3 AS INT) + CAST(l1 > l0 AS INT) + CAST(u1 > u0 AS INT) AS danger FROM lm) SELECT country, danger, CASE WHEN danger / 4e0 >= 0.6 THEN 'crisis' WHEN danger / 4e0 >= 0.4 THEN 'stress' WHEN danger / 4e0 >= 0.2 THEN 'caution' ELSE 'benign' END AS regime FROM v")
QUADRANT = "CASE WHEN growth >= trend AND inflation < 2 THEN 'goldilocks' WHEN growth >= trend THEN 'reflation' WHEN inflation >= 2 THEN 'stagflation' ELSE 'deflation' END"
sql_query("win44_macro_quadrant", f"WITH g AS (SELECT *, gdp AS growth, avg(gdp) OVER (PARTITION BY country ORDER BY date ROWS 11 PRECEDING) AS trend FROM {{macro}}), q AS (SELECT country, date, {QUADRANT} AS quadrant FROM g) SELECT country, date, quadrant, CAST(coalesce(quadrant <> lag(quadrant) OVER (PARTITION BY country ORDER BY date), false) AS INT) AS transition FROM q")
sql_query("win36_yield_curve_slope", f"SELECT country, date, {rounded({'slope': 'yield_long - yield_short', 'change_3m': 'yield_long - yield_short - lag(yield_long - yield_short, 3) OVER (PARTITION BY country ORDER BY date)'})} FROM {{macro}}")
INDEX = f"{RET}, ix AS (SELECT date, avg(ret) AS market, stddev_samp(ret) AS dispersion, avg(close) AS level FROM r GROUP BY date)"
sql_query("win35_sector_dispersion", f"WITH {RET}, s AS (SELECT p.region, r.date, stddev_samp(ret) AS sd FROM r JOIN {{peers}} p ON p.entity_id = r.entity_id GROUP BY p.region, r.date) SELECT region, date, {rounded({'dispersion_21d': 'avg(sd) OVER (PARTITION BY region ORDER BY date ROWS 20 PRECEDING)'})} FROM s")
sql_query("win37_index_momentum", f"WITH {RET}, g AS (SELECT p.region, r.date, avg(r.close) AS level FROM r JOIN {{peers}} p ON p.entity_id = r.entity_id GROUP BY p.region, r.date) SELECT region, date, {rounded({f'momentum_{k}d': f'RAT(level, lag(level, {k}) OVER (PARTITION BY region ORDER BY date)) - 1' for k in (21, 63, 252)})} FROM g")
CROSS = f"{RET}, g AS (SELECT p.region, r.date, avg(r.close) AS level, stddev_samp(ret) AS dispersion FROM r JOIN {{peers}} p ON p.entity_id = r.entity_id GROUP BY p.region, r.date), mm AS (SELECT date, avg(yield_long - yield_short) AS slope, avg(fx_volatility) AS fx FROM {{macro}} GROUP BY date), xa AS (SELECT g.*, RAT(level, lag(level, 21) OVER (PARTITION BY region ORDER BY g.date)) - 1 AS momentum, slope, fx FROM g LEFT JOIN mm ON mm.date = MONTH_OF(g.date))"
PARTS = {"slope": "-slope / 2", "momentum": "-momentum * 10", "dispersion": "dispersion * 100"}
STRESS = f"CASE WHEN {' + '.join(f'CAST({k} IS NOT NULL AS INT)' for k in PARTS)} >= 2 THEN ({' + '.join(f'coalesce({e}, 0e0)' for e in PARTS.values())}) / ({' + '.join(f'CAST({k} IS NOT NULL AS INT)' for k in PARTS)}) END"
sql_query("win38_cross_asset_stress", f"WITH {CROSS} SELECT region, date, {rounded({'stress': STRESS})} FROM xa")
sql_query("win87_cross_asset_pass", f"WITH {CROSS} SELECT x.entity_id, x.date, {rounded({'sector_momentum_21d': 'xa.momentum', 'sector_dispersion': 'xa.dispersion', 'yield_curve_slope': 'xa.slope', 'fx_volatility': 'xa.fx', 'stress': STRESS.replace('slope', 'xa.slope').replace('momentum', 'xa.momentum').replace('dispersion', 'xa.dispersion')})} FROM {{px}} x JOIN {{peers}} p ON p.entity_id = x.entity_id LEFT JOIN xa ON xa.region = p.region AND xa.date = x.date")
sql_query("win75_equity_duration", f"WITH {RET}, {HOME}, y AS (SELECT country, date, yield_long - lag(yield_long) OVER (PARTITION BY country ORDER BY date) AS dy FROM {{macro}}), j AS (SELECT h.entity_id, h.ret, y.dy FROM h JOIN y ON y.country = h.country AND y.date = MONTH_OF(h.date)) SELECT entity_id, {rounded({'duration': '-RAT(covar_samp(ret, dy), var_samp(CASE WHEN ret IS NOT NULL THEN dy END))'}, 5)} FROM j GROUP BY entity_id")
sql_query("win76_factor_exposure", f"WITH {RET}, {HOME}, ix AS (SELECT date, avg(ret) AS market FROM r GROUP BY date), y AS (SELECT country, date, fx_volatility, yield_long - yield_short AS slope FROM {{macro}}), j AS (SELECT h.entity_id, h.ret, ix.market, y.fx_volatility, y.slope FROM h JOIN ix ON ix.date = h.date LEFT JOIN y ON y.country = h.country AND y.date = MONTH_OF(h.date)) SELECT entity_id, {rounded({'beta_market': 'regr_slope(ret, market)', 'beta_fx': 'regr_slope(ret, fx_volatility)', 'beta_rates': 'regr_slope(ret, slope)'}, 5)} FROM j GROUP BY entity_id")
# Ownership of institutions: made of volume, as a share of a day's largest volume so far.
OWN = "ow AS (SELECT entity_id, date, 100 * avg(volume) OVER a / max(volume) OVER b AS pct, RAT(max(volume) OVER a, sum(volume) OVER a) AS top FROM {px} WINDOW a AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING), b AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
FLOW = f"{OWN}, fl AS (SELECT *, RAT(pct - lag(pct, 63) OVER {W}, greatest(lag(pct, 63) OVER {W}, 1e-9)) AS delta, top - lag(top, 63) OVER {W} AS dtop, pct - lag(pct, 63) OVER {W} AS dpct FROM ow), fs AS (SELECT *, avg(delta) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) AS smooth FROM fl)"
LABEL = lambda e, cuts: "CASE " + " ".join(f"WHEN {e} < {c} THEN '{n}'" for c, n in cuts[:-1]) + f" WHEN {e} IS NOT NULL THEN '{cuts[-1][1]}' END"
sql_query("win29_flow_momentum", f"WITH {FLOW} SELECT entity_id, date, {rounded({'change_63d': 'delta', 'flow_momentum': 'smooth'})}, {LABEL('smooth', [(-0.1, 'distributing'), (-0.03, 'reducing'), (0.03, 'stable'), (0.1, 'accumulating'), (0, 'strong_accumulating')])} AS label FROM fs")
CROWD = "greatest(0e0, least(1e0, top * least(1e0, greatest(0e0, pct / 100)) * (1 + 2 * greatest(0e0, -coalesce(smooth, 0e0)))))"
sql_query("win30_crowding_risk", f"WITH {FLOW} SELECT entity_id, date, {rounded({'crowding_risk': CROWD})} FROM fs")
SMART = "greatest(-1e0, least(1e0, dtop - dpct / 100))"
sql_query("win31_smart_money_divergence", f"WITH {FLOW} SELECT entity_id, date, {rounded({'divergence': f'CASE WHEN dtop IS NOT NULL THEN {SMART} END'})} FROM fs")
sql_query("win32_institutional_flow", f"WITH {FLOW}, c AS (SELECT entity_id, date, smooth, {CROWD} AS crowding, CASE WHEN dtop IS NOT NULL THEN {SMART} END AS smart FROM fs) SELECT entity_id, date, {rounded({'flow_momentum': 'smooth', 'crowding': 'crowding', 'smart_money': 'smart'})}, {LABEL('crowding', [(0.3, 'low'), (0.6, 'moderate'), (0.8, 'high'), (0, 'extreme')])} AS crowding_label, {LABEL('smart', [(-0.15, 'conviction_sell'), (-0.05, 'mild_sell'), (0.05, 'neutral'), (0.15, 'mild_buy'), (0, 'conviction_buy')])} AS smart_label FROM c")
sql_query("anal29_sector_strategicness", f"WITH s AS (SELECT p.sector, sum(f.revenue) AS v FROM {{fin}} f JOIN {{profiles}} p ON p.entity_id = f.entity_id GROUP BY p.sector) SELECT sector, {rounded({'share': 'v / sum(v) OVER ()', 'strategicness': "CASE WHEN sector IN ('energy', 'banking', 'utilities') THEN 0.7 * 0.8 ELSE 0.7 * 0.3 END + 0.3 * v / sum(v) OVER ()"})} FROM s")
sql_query("anal30_group_contagion", f"WITH {RET}, {HOME}, g AS (SELECT region, date, avg(ret) AS mean FROM h GROUP BY region, date), c AS (SELECT h.entity_id, g.region, h.ret, g.mean FROM h JOIN g ON g.date = h.date), q AS (SELECT entity_id, percentile_cont(0.25) WITHIN GROUP (ORDER BY ret) AS low FROM r GROUP BY entity_id) SELECT c.entity_id, c.region, {rounded({'tail_corr': 'PEARSON(ret, mean)'}, 5)} FROM c JOIN q ON q.entity_id = c.entity_id AND c.ret <= q.low GROUP BY c.entity_id, c.region")
sql_query("agg35_linked_summary", f"WITH {RET}, {HOME}, l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM h) SELECT region, count(*) AS members, {rounded({'mean_return': 'avg(ret)', 'mean_close': 'avg(close)'}, 5)} FROM l WHERE back = 1 GROUP BY region")
