"""Distress flags of companies and countries, the timeline of their modes, and the tier weights that follow."""

from panelweave.sqlops import rounded, sql_query

DEBT = "(coalesce(short_term_debt, 0e0) + coalesce(long_term_debt, 0e0))"
#: Trigger levels of company distress.
CURRENT_RATIO, DEBT_TO_EQUITY, FCF_YIELD, DRAWDOWN, MERTON = 1.0, 3.0, 0.0, -0.40, 1.0
CASH_SHARE, CASH_ENOUGH = 0.05, 1e10
#: Sectors that a state protects.
STRATEGIC = "('defense', 'energy', 'banking', 'utilities', 'telecom')"
W = "(PARTITION BY entity_id ORDER BY date)"

#: The daily panel with the ratios that trigger distress.
PANEL = f"""r AS (SELECT *, RAT(close, lag(close) OVER {W}) - 1 AS ret FROM {{day}}),
 v AS (SELECT *, close / max(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 251 PRECEDING) - 1 AS drawdown, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING)),
 x AS (SELECT entity_id, date, close, ret, vol, drawdown, market_cap, cash_and_equivalents AS cash, net_income, revenue, RAT(current_assets, current_liabilities) AS cr, RAT({DEBT}, abs(total_equity)) AS de, RAT(4 * (operating_cash_flow - abs(capex)), market_cap) AS fy,
  CASE WHEN {DEBT} > 0 AND vol > 1e-9 THEN greatest(-10e0, least(20e0, (ln((market_cap + {DEBT}) / {DEBT}) - pow(vol * sqrt(252e0) * market_cap / (market_cap + {DEBT}), 2) / 2) / (vol * sqrt(252e0) * market_cap / (market_cap + {DEBT})))) END AS dd FROM v)"""
LIQUIDITY = f"coalesce(cr < {CURRENT_RATIO} OR de > {DEBT_TO_EQUITY}, cr < {CURRENT_RATIO}, de > {DEBT_TO_EQUITY}, false)"
OTHER = f"(coalesce(drawdown < {DRAWDOWN}, false) OR coalesce(dd < {MERTON}, false))"
RICH = f"coalesce((cash > 0 AND market_cap > 0 AND cash / market_cap > {CASH_SHARE}) OR cash > {CASH_ENOUGH}, false)"
FLAGGED = f"{PANEL}, f AS (SELECT *, CAST((({LIQUIDITY}) AND NOT {RICH}) OR {OTHER} AS INT) AS company_flag FROM x)"
sql_query("anal01_company_survival_flag", f"WITH {FLAGGED} SELECT entity_id, date, company_flag AS company_survival_mode_flag FROM f")
sql_query(
    "anal01_company_flag_quarterly",
    f"""WITH m AS (SELECT entity_id, report_date, max_by(market_cap, date) AS market_cap FROM {{day}} WHERE report_date IS NOT NULL GROUP BY entity_id, report_date),
    q AS (SELECT f.*, m.market_cap, RAT(f.revenue - lag(f.revenue, 4) OVER w, abs(lag(f.revenue, 4) OVER w)) AS growth FROM {{fin}} f LEFT JOIN m ON f.entity_id = m.entity_id AND f.report_date = m.report_date WINDOW w AS (PARTITION BY f.entity_id ORDER BY f.report_date)),
    z AS (SELECT *, 1.2 * (current_assets - current_liabilities) / total_assets + 1.4 * retained_earnings / total_assets + 3.3 * 4 * ebit / total_assets + 0.6 * market_cap / total_liabilities + 4 * revenue / total_assets AS altman FROM q),
    t AS (SELECT entity_id, report_date, coalesce(RAT(current_assets, current_liabilities) < {CURRENT_RATIO}, false) OR coalesce(RAT({DEBT}, abs(total_equity)) > {DEBT_TO_EQUITY}, false) OR coalesce(RAT(4 * (operating_cash_flow - abs(capex)), market_cap) < {FCF_YIELD}, false) AS liquidity,
     coalesce(growth < -0.2, false) OR coalesce(altman < 1.81, false) OR coalesce(RAT(gross_profit, revenue) < 0, false) AS other, coalesce(cash_and_equivalents > 0 AND cash_and_equivalents / market_cap > {CASH_SHARE}, false) OR coalesce(cash_and_equivalents > {CASH_ENOUGH}, false) AS rich FROM z)
    SELECT entity_id, report_date, CAST(liquidity AS INT) AS liquidity_triggers, CAST(other AS INT) AS other_triggers, CAST((liquidity AND NOT rich) OR other AS INT) AS company_survival_mode_flag FROM t""",
)


def distance(value: str, level: float, below: bool) -> str:
    gap = f"({level}e0 - {value})" if below else f"({value} - {level}e0)"
    return f"greatest(-5e0, least(5e0, {gap} / {max(abs(level), 0.01)}e0))"


SIGNALS = [("cr", CURRENT_RATIO, True), ("de", DEBT_TO_EQUITY, False), ("fy", FCF_YIELD, True), ("drawdown", DRAWDOWN, True)]
DISTANCES = ", ".join(f"CASE WHEN {v} IS NOT NULL THEN {distance(v, t, b)} END AS s{k}" for k, (v, t, b) in enumerate(SIGNALS))
GEOMETRIC = "pow(" + " * ".join(f"CASE WHEN s{k} IS NULL THEN 1e0 ELSE 1 + greatest(-0.99e0, s{k}) END" for k in range(4)) + ", 1e0 / greatest(1, " + " + ".join(f"CAST(s{k} IS NOT NULL AS INT)" for k in range(4)) + ")) - 1"
PROBABILITY = f"1 / (1 + exp(-greatest(s0, s1, s2, s3, {GEOMETRIC})))"
# It rises with distress: the worst trigger, or several near ones together.
sql_query("anal02_survival_probability", f"WITH {PANEL}, s AS (SELECT entity_id, date, {DISTANCES} FROM x) SELECT entity_id, date, {rounded({'survival_probability': PROBABILITY})} FROM s")
sql_query(
    "win52_trigger_velocity",
    f"""WITH {PANEL}, s AS (SELECT entity_id, date, (cr - lag(cr, 21) OVER {W}) / {CURRENT_RATIO}e0 AS a, -(de - lag(de, 21) OVER {W}) / {DEBT_TO_EQUITY}e0 AS b, (drawdown - lag(drawdown, 21) OVER {W}) / {abs(DRAWDOWN)}e0 AS c FROM x)
    SELECT entity_id, date, {rounded({"deterioration_rate": "least(a, b, c)"})}, CAST(coalesce(least(a, b, c) < -0.3, false) AS INT) AS survival_velocity_flag FROM s""",
)
sql_query(
    "win82_early_warning",
    f"""WITH {PANEL}, p AS (SELECT entity_id, date, greatest(0e0, least(1e0, (2 - cr) / 1.5)) AS a, greatest(0e0, least(1e0, (de - 1) / 3)) AS b, greatest(0e0, least(1e0, (0.1 - fy) / 0.2)) AS c, greatest(0e0, least(1e0, (-0.15 - drawdown) / 0.35)) AS d, cr, de, fy, drawdown FROM x)
    SELECT entity_id, date, {rounded({"early_warning_score": "greatest(CASE WHEN cr IS NOT NULL THEN a END, CASE WHEN de IS NOT NULL THEN b END, CASE WHEN fy IS NOT NULL THEN c END, CASE WHEN drawdown IS NOT NULL THEN d END)"})} FROM p""",
)
COUNTRY = """c AS (SELECT country, date, credit_spread > 5.0 OR coalesce(unemployment_rate - lag(unemployment_rate, 6) OVER w > 3.0, false) OR yield_long - yield_short < -0.5 OR fx_volatility > 20.0 AS stressed,
 coalesce((lag(lending_rate, 3) OVER w) - lending_rate > 2.0, false) AS emergency_cut, gdp FROM {macro} WINDOW w AS (PARTITION BY country ORDER BY date))"""
sql_query("anal06_country_survival_flag", f"WITH {COUNTRY} SELECT country, date, CAST(stressed AS INT) AS country_survival_mode_flag FROM c")
# Market values are in thousandths of the country's product in these tables.
HOME = f"h AS (SELECT f.entity_id, f.date, f.company_flag, CAST(coalesce(c.stressed, false) AS INT) AS country_flag, CAST(p.sector IN {STRATEGIC} OR coalesce(f.market_cap > 0.001 * c.gdp * 1e8, false) OR coalesce(c.emergency_cut, false) AS INT) AS protected_flag FROM f JOIN {{profiles}} p ON f.entity_id = p.entity_id LEFT JOIN c ON c.country = p.nation AND c.date = MONTH_OF(f.date))"
sql_query("anal07_country_protected_flag", f"WITH {FLAGGED}, {COUNTRY}, {HOME} SELECT entity_id, date, protected_flag AS country_protected_flag FROM h")
sql_query("anal08_survival_flags", f"WITH {FLAGGED}, {COUNTRY}, {HOME} SELECT entity_id, date, company_flag AS company_survival_mode_flag, country_flag AS country_survival_mode_flag, protected_flag AS country_protected_flag FROM h")
MODE = "CASE WHEN company_flag = 0 AND country_flag = 0 THEN 'normal' WHEN country_flag = 0 THEN 'company_only' WHEN company_flag = 0 AND protected_flag = 1 THEN 'country_protected' WHEN company_flag = 0 THEN 'country_exposed' WHEN protected_flag = 1 THEN 'both_protected' ELSE 'both_unprotected' END"
MODES = f"{FLAGGED}, {COUNTRY}, {HOME}, m AS (SELECT entity_id, date, company_flag, country_flag, protected_flag, {MODE} AS mode FROM h)"
sql_query("anal09_survival_mode", f"WITH {MODES} SELECT entity_id, date, mode FROM m")
REGIME = "CASE WHEN company_flag = 0 AND country_flag = 0 THEN 'normal' WHEN country_flag = 0 THEN 'company_survival' WHEN company_flag = 0 AND protected_flag = 1 THEN 'normal' WHEN company_flag = 0 THEN 'modified_survival' ELSE 'extreme_survival' END"
sql_query("anal10_weight_regime", f"WITH {MODES} SELECT entity_id, date, {REGIME} AS survival_regime FROM m")
#: Weights of the five tiers by regime.
WEIGHTS = {"normal": (0.20, 0.20, 0.20, 0.20, 0.20), "company_survival": (0.50, 0.30, 0.15, 0.04, 0.01), "modified_survival": (0.40, 0.35, 0.20, 0.04, 0.01), "extreme_survival": (0.60, 0.30, 0.10, 0.00, 0.00)}
RULES = "(VALUES " + ", ".join(f"('{k}', {', '.join(f'{w}e0' for w in v)})" for k, v in WEIGHTS.items()) + ") AS t(regime, w1, w2, w3, w4, w5)"
# A company that spends on show (here: buys back shares while cash flows out) is judged more by its liquidity, outside normal times.
sql_query(
    "anal11_hierarchy_weights",
    f"""WITH {MODES}, g AS (SELECT m.entity_id, m.date, {REGIME} AS regime, coalesce(100 * RAT(d.share_buybacks, d.revenue), 0e0) * 10 AS vanity FROM m JOIN {{day}} d ON m.entity_id = d.entity_id AND m.date = d.date),
    a AS (SELECT g.*, w1 + CASE WHEN moved THEN 0.05e0 ELSE 0e0 END AS a1, w2 AS a2, w3 AS a3, greatest(0e0, w4 - CASE WHEN moved THEN 0.02e0 ELSE 0e0 END) AS a4, greatest(0e0, w5 - CASE WHEN moved THEN 0.03e0 ELSE 0e0 END) AS a5 FROM (SELECT *, vanity > 10 AND regime <> 'normal' AS moved FROM g) g JOIN {RULES} ON g.regime = t.regime)
    SELECT entity_id, date, regime AS survival_regime, {rounded({f"hierarchy_tier{k}_weight": f"a{k} / (a1 + a2 + a3 + a4 + a5)" for k in range(1, 6)})} FROM a""",
)
SWITCH = f"{MODES}, s AS (SELECT *, lag(mode) OVER {W} AS before, CASE WHEN lag(mode) OVER {W} <> mode THEN 1 ELSE 0 END AS switch FROM m), k AS (SELECT *, sum(switch) OVER {W} AS run FROM s)"
sql_query("win45_mode_switch_points", f"WITH {SWITCH} SELECT entity_id, date, switch FROM s")
sql_query("win46_switch_list", f"WITH {SWITCH} SELECT entity_id, date, before AS from_mode, mode AS to_mode FROM s WHERE switch = 1")
COUNTED = f"{SWITCH}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id, run ORDER BY date) AS days_in_mode, count(*) OVER (PARTITION BY entity_id, run) AS dwell FROM k)"
# Dwell times are those of finished runs; the chance to leave is that of a constant hazard with their mean.
DWELLS = "o AS (SELECT entity_id, max(run) AS last_run FROM k GROUP BY entity_id), e AS (SELECT a.entity_id, a.mode, avg(dwell) AS mean_dwell, count(*) AS episodes FROM (SELECT entity_id, mode, run, count(*) AS dwell FROM k GROUP BY entity_id, mode, run) a JOIN o ON o.entity_id = a.entity_id AND a.run < o.last_run GROUP BY a.entity_id, a.mode)"
sql_query("win49_mode_dwell", f"WITH {SWITCH}, {DWELLS} SELECT entity_id, mode, episodes, {rounded({'mean_dwell': 'mean_dwell', 'exit_probability_21d': '1 - pow(1 - 1 / greatest(mean_dwell, 1e0), 21)'})} FROM e")
CODES = ["normal", "company_only", "country_protected", "country_exposed", "both_unprotected", "both_protected"]
STABILITY = "(CASE mode " + " ".join(f"WHEN '{c}' THEN count(CASE WHEN mode = '{c}' THEN 1 END) OVER t" for c in CODES) + " END / (1e0 * count(*) OVER t))"
sql_query("win50_survival_timeline", f"WITH {COUNTED} SELECT entity_id, date, mode AS survival_mode, switch, CAST(days_in_mode AS INT) AS days_in_mode, {rounded({'stability_score_21d': STABILITY})} FROM n WINDOW t AS (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING)")
MARKET = "CASE WHEN vol > 0.35 THEN 'high_vol' WHEN drawdown < -0.2 THEN 'bear' WHEN drawdown > -0.05 THEN 'bull' WHEN vol IS NULL THEN 'unknown' ELSE 'low_vol' END"
STATES = "CASE WHEN mode = 'normal' AND market = 'high_vol' THEN 'elevated_risk' WHEN mode = 'normal' AND market = 'bear' THEN 'market_stress' WHEN mode = 'normal' THEN 'stable_growth' WHEN mode = 'company_only' AND market IN ('bear', 'high_vol') THEN 'company_distress_severe' WHEN mode = 'company_only' THEN 'company_distress_mild' WHEN mode = 'country_exposed' AND market IN ('bear', 'high_vol') THEN 'country_crisis_severe' WHEN mode = 'country_exposed' THEN 'country_crisis_mild' WHEN mode = 'country_protected' THEN 'protected_stress' WHEN mode = 'both_protected' THEN 'protected_crisis' WHEN market = 'bear' THEN 'extreme_crisis' ELSE 'crisis' END"
#: The middle of each combined state's intensity.
INTENSITY = {"stable_growth": 0.05, "elevated_risk": 0.25, "market_stress": 0.3, "company_distress_mild": 0.475, "company_distress_severe": 0.65, "country_crisis_mild": 0.425, "country_crisis_severe": 0.65, "protected_stress": 0.25, "protected_crisis": 0.55, "crisis": 0.8, "extreme_crisis": 0.95}
sql_query(
    "win51_enriched_timeline",
    f"""WITH {MODES}, y AS (SELECT m.entity_id, m.date, mode, {MARKET} AS market FROM m JOIN x ON m.entity_id = x.entity_id AND m.date = x.date), z AS (SELECT *, {STATES} AS state FROM y)
    SELECT entity_id, date, mode AS survival_mode, market AS market_regime, state AS combined_state, intensity AS survival_intensity FROM z JOIN (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in INTENSITY.items())}) AS t(name, intensity) ON state = name""",
)
sql_query("win88_mode_at_date", f"WITH {MODES}, a AS (SELECT DISTINCT entity_id, CAST('1998-06-15' AS DATE) AS date FROM m) SELECT a.entity_id, a.date, coalesce(m.mode, 'unknown') AS mode FROM a LEFT JOIN m ON a.entity_id = m.entity_id AND a.date = m.date")
sql_query("win89_transition_half_life", f"WITH {SWITCH}, d AS (SELECT entity_id, run, count(*) AS dwell FROM k GROUP BY entity_id, run) SELECT entity_id, {rounded({'half_life_days': 'greatest(2e0, least(30e0, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(dwell AS DOUBLE)) / 2))'})} FROM d GROUP BY entity_id")
sql_query("win94_latest_regime", f"WITH {MODES} SELECT entity_id, max_by({REGIME}, date) AS regime, max(date) AS date FROM m GROUP BY entity_id")
sql_query("fc82_survival_context", f"WITH {COUNTED} SELECT entity_id, max_by(mode, date) AS mode, CAST(max_by(days_in_mode, date) AS INT) AS days_in_mode, max_by(before, date) FILTER (WHERE switch = 1) AS previous_mode FROM n GROUP BY entity_id")
#: The tier of each variable.
TIERS = {"cash_ratio": 1, "free_cash_flow": 1, "operating_cash_flow": 1, "debt_to_equity_abs": 2, "interest_coverage": 2, "current_ratio": 2, "close": 3, "volatility_21d": 3, "drawdown_252d": 3, "gross_margin": 4, "net_margin": 4, "revenue": 5, "pe_ratio_calc": 5}
sql_query(
    "win95_variable_triage",
    f"""WITH {MODES}, g AS (SELECT entity_id, max_by({REGIME}, date) AS regime FROM m GROUP BY entity_id)
    SELECT entity_id, regime, variable, tier, CASE WHEN regime = 'normal' THEN 'active' WHEN tier <= 2 THEN 'priority' WHEN tier >= 5 OR (tier = 4 AND regime = 'extreme_survival') THEN 'frozen' ELSE 'active' END AS triage FROM g CROSS JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in TIERS.items())}) AS t(variable, tier)""",
)
sql_query(
    "fc47_survival_aware_weights",
    f"""WITH {COUNTED}, l AS (SELECT entity_id, max_by({REGIME}, date) AS regime, max_by(days_in_mode, date) AS days FROM n GROUP BY entity_id), b AS (SELECT entity_id, days, 1 - pow(0.5e0, days / 10e0) AS share, w1, w2, w3, w4, w5 FROM l JOIN {RULES} ON l.regime = t.regime)
    SELECT entity_id, CAST(days AS INT) AS days_in_mode, {rounded({f"tier{k}_weight": f"share * w{k} + (1 - share) * 0.2" for k in range(1, 6)})} FROM b""",
)
sql_query(
    "fc57_trigger_check",
    f"""WITH {PANEL}, u AS (SELECT entity_id, date, name, CASE name WHEN 'current_ratio' THEN cr WHEN 'debt_to_equity' THEN de WHEN 'drawdown' THEN drawdown ELSE fy END AS value, side, level FROM x CROSS JOIN (VALUES ('current_ratio', 'lt', 1e0), ('debt_to_equity', 'gt', 3e0), ('drawdown', 'lt', -0.4e0), ('fcf_yield', 'lt', 0e0)) AS t(name, side, level))
    SELECT entity_id, date, CAST(count(value) AS INT) AS n_checked, max(CASE WHEN (side = 'lt' AND value < level) OR (side = 'gt' AND value > level) THEN 1 ELSE 0 END) AS breached FROM u GROUP BY entity_id, date""",
)
sql_query(
    "fc58_sector_thresholds",
    f"""WITH {PANEL}, s AS (SELECT x.*, coalesce(t.level, 1e0) AS level, p.sector FROM x JOIN {{profiles}} p ON p.entity_id = x.entity_id LEFT JOIN (VALUES ('technology', 0.8e0), ('utilities', 0.7e0), ('banking', 0.9e0)) AS t(name, level) ON p.sector = t.name)
    SELECT entity_id, date, sector, level, CAST(coalesce(cr < level, false) AS INT) AS breached FROM s""",
)
SIZE_FLOOR = "CASE WHEN market_cap >= 200e9 THEN 0.92e0 WHEN market_cap >= 10e9 THEN 0.82e0 WHEN market_cap >= 2e9 THEN 0.70e0 WHEN market_cap >= 300e6 THEN 0.55e0 ELSE 0.40e0 END"
sql_query("fc59_size_floor", "SELECT entity_id, date, " + SIZE_FLOOR.replace("market_cap", "(market_cap * 1e3)") + " AS survival_floor FROM {day} WHERE market_cap IS NOT NULL")
#: The normal distribution function by a polynomial (Abramowitz and Stegun 26.2.17, fixed values).
T_OF = "(1 / (1 + 0.2316419 * abs({z})))"
CDF_UP = "(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"


def normal_cdf(z: str) -> str:
    up = CDF_UP.replace("{t}", T_OF).replace("{z}", z)
    return f"(CASE WHEN {z} >= 0 THEN 1 - {up} ELSE {up} END)"


sql_query(
    "fc60_anchored_survival",
    f"""WITH {PANEL}, a AS (SELECT entity_id, date, {SIZE_FLOOR.replace("market_cap", "(market_cap * 1e3)")} AS size_floor, 1 - {normal_cdf("(-dd)")} AS merton, 1 - 1 / (1 + exp(-(1 - cr))) AS raw FROM x WHERE market_cap IS NOT NULL)
    SELECT entity_id, date, {rounded({"survival": "greatest(raw, size_floor, merton)"}, 4)}, CASE WHEN raw >= size_floor AND raw >= coalesce(merton, 0e0) THEN 'model' WHEN size_floor >= coalesce(merton, 0e0) THEN 'size' ELSE 'merton' END AS source FROM a""",
)
