"""Panel models in closed form: microstructure, fractional differences, drift of distributions, exponential weights, causality."""

from panelweave.operators.ensembles import IC, MODELS, WEIGHTS, sql_query
from panelweave.operators.macro import HOME, RET
from panelweave.operators.names import matched
from panelweave.operators.survival import DEBT, PANEL, normal_cdf
from panelweave.sqlops import rounded

W = "(PARTITION BY entity_id ORDER BY date)"
F21, F63 = (f"(PARTITION BY entity_id ORDER BY date ROWS {n - 1} PRECEDING)" for n in (21, 63))
sql_query(
    "win11_microstructure",
    f"""WITH c AS (SELECT *, pow(ln(high / low), 2) AS h2, pow(ln(greatest(high, lag(high) OVER {W}) / least(low, lag(low) OVER {W})), 2) AS g, RAT(close, lag(close) OVER {W}) - 1 AS ret, ln(open / lag(close) OVER {W}) AS o, ln(close / open) AS c, ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS rs FROM {{px}} WHERE low > 0),
    b AS (SELECT *, h2 + lag(h2) OVER {W} AS beta, CASE WHEN ret IS NOT NULL THEN sign(ret) * volume END AS signed FROM c), a AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2e0)) - sqrt(g / (3 - 2 * sqrt(2e0))) AS alpha FROM b)
    SELECT entity_id, date, {rounded({"corwin_schultz_spread": "greatest(0e0, 2 * (exp(alpha) - 1) / (1 + exp(alpha)))", "parkinson_vol": f"sqrt(avg(h2) OVER {F21} / (4 * ln(2e0)))", "rogers_satchell": f"avg(rs) OVER {F21}"}, 5)},
    {rounded({"volume_clock": f"RAT(volume, avg(volume) OVER {F21})"}, 5)} FROM a""",
)
# Weights of a difference of order 0.4 over the last 20 rows: each is the one before times (k - 1 - d) / k.
FRAC = [1.0]
for _k in range(1, 20):
    FRAC.append(FRAC[-1] * (_k - 1 - 0.4) / _k)
sql_query("win12_fractional_difference", f"WITH l AS (SELECT entity_id, date, ln(close) AS x FROM {{px}} WHERE close > 0) SELECT entity_id, date, {rounded({'frac_diff': ' + '.join([f'x * {FRAC[0]!r}e0', *[f'(lag(x, {k}) OVER w) * ({w:.12f}e0)' for k, w in enumerate(FRAC) if k]])}, 5)} FROM l WINDOW w AS {W}")
sql_query("win71_distribution_drift", f"WITH {RET}, k AS (SELECT entity_id, ret, row_number() OVER {W} AS n FROM r WHERE ret IS NOT NULL), q AS (SELECT entity_id, {', '.join(f'percentile_cont({p}) WITHIN GROUP (ORDER BY CASE WHEN n <= 252 THEN ret END) AS a{i}, percentile_cont({p}) WITHIN GROUP (ORDER BY CASE WHEN n > 252 AND n <= 315 THEN ret END) AS b{i}' for i, p in enumerate((0.1, 0.3, 0.5, 0.7, 0.9)))} FROM k GROUP BY entity_id) SELECT entity_id, {rounded({'wasserstein': '(' + ' + '.join(f'abs(a{i} - b{i})' for i in range(5)) + ') / 5'}, 5)} FROM q")
sql_query("win73_risk_premium_proxy", f"WITH {RET}, k AS (SELECT entity_id, date, ret, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM r WHERE ret IS NOT NULL), v AS (SELECT entity_id, sqrt(252 * sum(pow(0.94e0, back) * ret * ret) / sum(pow(0.94e0, back))) AS forecast, stddev_samp(CASE WHEN back <= 21 THEN ret END) * sqrt(252e0) AS realised, count(*) AS n FROM k GROUP BY entity_id) SELECT entity_id, {rounded({'forecast_vol': 'forecast', 'realised_vol': 'realised', 'vrp': 'forecast - realised'}, 4)}, CASE WHEN forecast - realised > 0.02 THEN 'risk_premium' WHEN forecast - realised < -0.05 THEN 'tail_event' ELSE 'neutral' END AS regime FROM v WHERE n >= 63")
sql_query("win78_regime_training_weights", f"WITH {PANEL}, k AS (SELECT entity_id, date, CASE WHEN drawdown < -0.2 THEN 'bear' ELSE 'bull' END AS regime, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM x), l AS (SELECT entity_id, regime AS now FROM k WHERE back = 1) SELECT k.entity_id, k.date, {rounded({'weight': 'exp(-(back - 1) / 126e0) * CASE WHEN regime = now THEN 1.5e0 ELSE 0.7e0 END'})} FROM k JOIN l ON l.entity_id = k.entity_id")
ANALOG = f"{RET}, wn AS (SELECT entity_id, date, avg(ret) OVER {F21} AS m, stddev_samp(ret) OVER {F21} AS s, row_number() OVER {W} AS k, count(*) OVER (PARTITION BY entity_id) AS n, RAT(lead(close, 21) OVER {W}, close) - 1 AS later FROM r), qy AS (SELECT entity_id, m AS qm, s AS qs FROM wn WHERE k = n), ds AS (SELECT wn.*, sqrt(pow(m - qm, 2) + pow(s - qs, 2)) AS distance FROM wn JOIN qy ON qy.entity_id = wn.entity_id WHERE k >= 21 AND k <= n - 42 AND k % 21 = 0 AND s IS NOT NULL), tp AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY distance, k) AS place FROM ds)"
sql_query("fc50_analog_forecast", f"WITH {ANALOG} SELECT entity_id, count(*) AS n_analogs, {rounded({'forecast': 'sum(later / (0.001 + distance)) / sum(1 / (0.001 + distance))'}, 4)} FROM tp WHERE place <= 5 AND later IS NOT NULL GROUP BY entity_id")
sql_query("win93_analog_boost", f"WITH {ANALOG} SELECT wn.entity_id, wn.date, max(CASE WHEN tp.k IS NOT NULL THEN 1.5e0 ELSE 1e0 END) AS weight FROM wn LEFT JOIN tp ON tp.entity_id = wn.entity_id AND tp.place <= 3 AND wn.k <= tp.k AND wn.k > tp.k - 21 GROUP BY wn.entity_id, wn.date")
sql_query("win91_catalyst_score", f"WITH q AS (SELECT *, research_and_development / revenue AS rd, net_income - lag(net_income) OVER w AS d, gross_profit / revenue - lag(gross_profit / revenue, 4) OVER w AS mix, row_number() OVER (PARTITION BY entity_id ORDER BY report_date DESC) AS back FROM {{fin}} WINDOW w AS (PARTITION BY entity_id ORDER BY report_date)) SELECT entity_id, {rounded({'score': '0.3 * CASE WHEN rd > 0.04 THEN 1 ELSE 0 END + 0.4 * CASE WHEN d > 0 THEN 1 ELSE 0 END + 0.3 * CASE WHEN mix > 0 THEN 1 ELSE 0 END'}, 4)} FROM q WHERE back = 1")
sql_query("win25_derived_pass", f"WITH {PANEL} SELECT entity_id, date, {rounded({'return_1d': 'ret', 'volatility_21d': 'vol', 'drawdown_252d': 'drawdown', 'current_ratio': 'cr', 'debt_to_equity_abs': 'de', 'fcf_yield': 'fy', 'net_margin': 'RAT(net_income, revenue)', 'merton_dd': 'dd'}, 5)}, {', '.join(f'CAST({x} IS NULL AS INT) AS is_missing_{n}' for x, n in (('ret', 'return_1d'), ('cr', 'current_ratio'), ('fy', 'fcf_yield')))} FROM x")
sql_query("scal26_option_delta", f"WITH {PANEL}, d AS (SELECT entity_id, date, k, (ln(1 / k) + vol * vol * 252 / 2 * 0.25) / (vol * sqrt(252e0) * 0.5) AS d1 FROM x CROSS JOIN (VALUES (0.9e0), (1e0), (1.1e0)) AS t(k) WHERE vol > 1e-6) SELECT entity_id, date, k AS moneyness, {rounded({'call_delta': normal_cdf('d1')}, 5)} FROM d")
SMILE = f"{PANEL}, sm AS (SELECT entity_id, date, vol * sqrt(252e0) AS iv, vol * sqrt(252e0) * (1 + 0.1 * greatest(0e0, -drawdown)) AS put_iv, vol * sqrt(252e0) * (1 - 0.05 * greatest(0e0, -drawdown)) AS call_iv, vol FROM x WHERE vol IS NOT NULL)"
sql_query("scal28_risk_reversal", f"WITH {SMILE} SELECT entity_id, date, {rounded({'risk_reversal_25d': 'call_iv - put_iv'}, 5)} FROM sm")
sql_query("scal29_iv_skew", f"WITH {SMILE} SELECT entity_id, date, {rounded({'skew': 'RAT(put_iv, iv)'}, 5)} FROM sm")
sql_query("scal30_variance_premium", f"WITH {SMILE} SELECT entity_id, date, {rounded({'premium': 'put_iv * put_iv - avg(iv * iv) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING)'}, 4)} FROM sm")
RANKS = f"{RET}, sg AS (SELECT entity_id, date, ret, RAT(volume, avg(volume) OVER {F21}) AS v FROM r), rk AS (SELECT entity_id, (rank() OVER (PARTITION BY entity_id ORDER BY ret) - 0.5e0) / count(*) OVER (PARTITION BY entity_id) AS u, (rank() OVER (PARTITION BY entity_id ORDER BY v) - 0.5e0) / count(*) OVER (PARTITION BY entity_id) AS w FROM sg WHERE ret IS NOT NULL AND v IS NOT NULL)"
LOGIT = lambda p: f"(ln({p} / (1 - {p})) * 0.5513)"
sql_query("scal34_rank_normal_corr", f"WITH {RANKS} SELECT entity_id, {rounded({'rank_corr': 'PEARSON(u, w)', 'normal_score_corr': f'PEARSON({LOGIT(chr(117))}, {LOGIT(chr(119))})'}, 5)} FROM rk GROUP BY entity_id")
sql_query("fc84_copula_bundle", f"WITH {RANKS} SELECT entity_id, count(*) AS n, {rounded({'rank_corr': 'PEARSON(u, w)', 'lower_tail': 'RAT(avg(CASE WHEN u < 0.1 AND w < 0.1 THEN 1e0 ELSE 0e0 END), 0.1e0)', 'upper_tail': 'RAT(avg(CASE WHEN u > 0.9 AND w > 0.9 THEN 1e0 ELSE 0e0 END), 0.1e0)'}, 5)} FROM rk GROUP BY entity_id")
sql_query("anal12_entropy_weight_blend", f"WITH {MODELS}, b AS (SELECT model, CAST(floor(least(19e0, abs(err) / 100)) AS INT) AS bin, count(*) AS n FROM er WHERE err IS NOT NULL GROUP BY model, CAST(floor(least(19e0, abs(err) / 100)) AS INT)), en AS (SELECT model, -sum(n / total * ln(n / total)) AS entropy FROM (SELECT *, sum(CAST(n AS DOUBLE)) OVER (PARTITION BY model) AS total FROM b) a GROUP BY model) SELECT model, {rounded({'entropy': 'entropy', 'weight': '0.7 * 0.25 + 0.3 * entropy / sum(entropy) OVER ()'}, 5)} FROM en")
sql_query("anal13_fuzzy_protection", f"WITH {PANEL}, m AS (SELECT x.entity_id, date, CASE WHEN p.sector IN ('energy', 'banking', 'utilities') THEN 1e0 ELSE 0.2e0 END AS sector, greatest(0e0, least(1e0, market_cap / 2e7)) AS size, greatest(0e0, least(1e0, (-drawdown - 0.1) / 0.4)) AS policy FROM x JOIN {{profiles}} p ON p.entity_id = x.entity_id WHERE market_cap IS NOT NULL) SELECT entity_id, date, {rounded({'degree': 'greatest(sector * 0.8, 0.4 * sector + 0.35 * size + 0.25 * policy)'}, 5)}, CASE WHEN greatest(sector * 0.8, 0.4 * sector + 0.35 * size + 0.25 * policy) > 0.7 THEN 'protected' WHEN greatest(sector * 0.8, 0.4 * sector + 0.35 * size + 0.25 * policy) > 0.3 THEN 'partial' ELSE 'exposed' END AS label FROM m")
sql_query("graph01_edge_table", "SELECT src, dst, kind, n FROM (SELECT l_suppkey AS src, l_partkey AS dst, 'supplies' AS kind, count(*) AS n FROM {lineitem} GROUP BY l_suppkey, l_partkey UNION ALL SELECT o_custkey, o_orderkey, 'orders', count(*) FROM {orders} GROUP BY o_custkey, o_orderkey) e")
# An exponential mean with span 21 over the last 63 rows.
EMA = "sum(CASE WHEN b.k <= a.k THEN b.close * pow(0.909090909090909e0, a.k - b.k) END) / sum(pow(0.909090909090909e0, a.k - b.k))"
sql_query("fc03_walk_forward_ema", f"WITH a AS (SELECT entity_id, date, close, row_number() OVER {W} AS k, lead(close) OVER {W} AS later FROM {{px}}), b AS (SELECT * FROM a), m AS (SELECT a.entity_id, a.date, max(a.later) AS later, {EMA} AS ema FROM a JOIN b ON b.entity_id = a.entity_id AND b.k <= a.k AND b.k > a.k - 63 GROUP BY a.entity_id, a.date) SELECT entity_id, date, {rounded({'predicted': 'ema', 'error': 'ema - later'}, 3)} FROM m")
sql_query("fc17_exponential_weights", f"WITH {MODELS}, l AS (SELECT entity_id, mode, model, sum(least(1e0, abs(err) / close)) AS loss FROM er WHERE err IS NOT NULL AND close > 0 GROUP BY entity_id, mode, model), w AS (SELECT *, exp(-0.1 * (loss - min(loss) OVER (PARTITION BY entity_id, mode))) AS raw FROM l) SELECT entity_id, mode, model, {rounded({'weight': 'raw / sum(raw) OVER (PARTITION BY entity_id, mode)'})} FROM w")
sql_query("fc18_fixed_share_weights", f"WITH {MODELS}, l AS (SELECT entity_id, model, sum(pow(0.98e0, back) * least(1e0, abs(err) / close)) AS loss FROM er WHERE err IS NOT NULL AND close > 0 GROUP BY entity_id, model), w AS (SELECT *, exp(-0.5 * (loss - min(loss) OVER (PARTITION BY entity_id))) AS raw FROM l) SELECT entity_id, model, {rounded({'weight': '0.95 * raw / sum(raw) OVER (PARTITION BY entity_id) + 0.05 / 4'})} FROM w")
sql_query("fc20_regime_labels", f"WITH {RET}, g AS (SELECT entity_id, ntile(3) OVER (PARTITION BY entity_id ORDER BY avg21, date) AS part, ret FROM (SELECT *, avg(ret) OVER {F21} AS avg21 FROM r WHERE ret IS NOT NULL) a), m AS (SELECT entity_id, part, avg(ret) AS mean, stddev_samp(ret) AS vol, count(*) AS n FROM g GROUP BY entity_id, part), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY mean, part) AS place FROM m) SELECT entity_id, CAST(part AS INT) AS part, n, CASE place WHEN 1 THEN 'bear' WHEN 3 THEN 'bull' ELSE CASE WHEN vol > 0.5 THEN 'high_vol' ELSE 'low_vol' END END AS regime, {rounded({'mean': 'mean'}, 5)} FROM k")
TWO_STATES = f"{RET}, st AS (SELECT entity_id, date, CASE WHEN avg(ret) OVER {F21} < 0.05 THEN 'calm' ELSE 'hot' END AS state FROM r WHERE ret IS NOT NULL), tr AS (SELECT entity_id, state, lead(state) OVER {W} AS next FROM st), pr AS (SELECT entity_id, avg(CASE WHEN state = 'calm' THEN CASE WHEN next = 'calm' THEN 1e0 ELSE 0e0 END END) AS a, avg(CASE WHEN state = 'hot' THEN CASE WHEN next = 'hot' THEN 1e0 ELSE 0e0 END END) AS b FROM tr WHERE next IS NOT NULL GROUP BY entity_id)"
# With two states the n-step chance to stay has a closed form in the second eigenvalue a + b - 1.
sql_query("fc22_regime_shift_forecast", f"WITH {TWO_STATES} SELECT entity_id, CAST(h AS INT) AS horizon, {rounded({'leave_calm': '1 - ((1 - b) + (1 - a) * pow(abs(a + b - 1), h)) / (2 - a - b)', 'expected_days': '1 / (1 - a)'}, 5)} FROM pr CROSS JOIN (VALUES (5e0), (21e0), (63e0), (252e0)) AS t(h) WHERE a < 1 AND b < 1")
LAGS = f"{RET}, {HOME}, gm AS (SELECT region, date, avg(ret) AS mean FROM h GROUP BY region, date), ls AS (SELECT h.entity_id, h.date, h.ret AS y, lag(h.ret) OVER (PARTITION BY h.entity_id ORDER BY h.date) AS y0, lag(g.mean) OVER (PARTITION BY h.entity_id ORDER BY h.date) AS x0 FROM h JOIN gm g ON g.region = h.region AND g.date = h.date), ok AS (SELECT * FROM ls WHERE y IS NOT NULL AND y0 IS NOT NULL AND x0 IS NOT NULL)"
GRANGER = f"{LAGS}, mo AS (SELECT entity_id, count(*) AS n, PEARSON(y, y0) AS r1, PEARSON(y, x0) AS r2, PEARSON(y0, x0) AS r3 FROM ok GROUP BY entity_id HAVING stddev_samp(x0) > 1e-9 AND stddev_samp(y0) > 1e-9), gr AS (SELECT *, (r2 - r1 * r3) / sqrt((1 - r1 * r1) * (1 - r3 * r3)) AS partial FROM mo WHERE r1 * r1 < 0.999999 AND r3 * r3 < 0.999999)"
FSTAT = "partial * partial * (n - 3) / (1 - partial * partial)"
sql_query("fc24_granger", f"WITH {GRANGER} SELECT entity_id, n, {rounded({'partial_corr': 'partial', 'f_statistic': FSTAT}, 4)}, CAST({FSTAT} > 3.84 AS INT) AS causes FROM gr")
sql_query("fc25_time_varying_causality", f"WITH {LAGS}, ws AS (SELECT entity_id, CAST(year(date) AS INT) AS year, count(*) AS n, PEARSON(y, y0) AS r1, PEARSON(y, x0) AS r2, PEARSON(y0, x0) AS r3 FROM ok GROUP BY entity_id, year(date) HAVING stddev_samp(x0) > 1e-9 AND stddev_samp(y0) > 1e-9 AND stddev_samp(y) > 1e-9), p AS (SELECT *, (r2 - r1 * r3) / sqrt((1 - r1 * r1) * (1 - r3 * r3)) AS partial FROM ws WHERE r1 * r1 < 0.999999 AND r3 * r3 < 0.999999 AND n > 20) SELECT entity_id, year, {rounded({'partial_corr': 'partial'}, 4)} FROM p")
sql_query("fc26_prune_by_causality", f"WITH {GRANGER} SELECT p.entity_id, CASE WHEN k.entity_id IS NOT NULL THEN 'kept' ELSE 'causal' END AS why FROM {{peers}} p LEFT JOIN {{kept_entities}} k ON k.entity_id = p.entity_id LEFT JOIN gr ON gr.entity_id = p.entity_id WHERE k.entity_id IS NOT NULL OR {FSTAT} > 1")
sql_query("fc27_prune_weak", f"WITH {GRANGER}, k AS (SELECT entity_id, partial, row_number() OVER (ORDER BY round(abs(partial), 9) DESC, entity_id) AS place FROM gr WHERE abs(partial) > 0.02) SELECT entity_id, {rounded({'strength': 'abs(partial)'}, 4)} FROM k WHERE place <= 20")
sql_query("fc79_prune_unified", f"WITH {GRANGER} SELECT entity_id, CASE WHEN {FSTAT} > 3.84 THEN 'strong' ELSE 'weak' END AS link FROM gr WHERE {FSTAT} > 1 OR entity_id IN (SELECT entity_id FROM {{kept_entities}})")
sql_query("fc83_causality_bundle", f"WITH {GRANGER} SELECT CASE WHEN {FSTAT} > 3.84 THEN 'causal' ELSE 'none' END AS class, count(*) AS n, {rounded({'mean_strength': 'avg(abs(partial))'}, 4)} FROM gr GROUP BY CASE WHEN {FSTAT} > 3.84 THEN 'causal' ELSE 'none' END")
sql_query("fc51_causal_propagation", f"WITH {GRANGER}, d AS (SELECT entity_id, avg(ret) AS deviation FROM (SELECT entity_id, ret, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM r WHERE ret IS NOT NULL) a WHERE back <= 5 GROUP BY entity_id), g AS (SELECT p.region, avg(deviation) AS mean FROM d JOIN {{peers}} p ON p.entity_id = d.entity_id GROUP BY p.region) SELECT gr.entity_id, {rounded({'adjustment': '0.5 * partial * mean'}, 4)} FROM gr JOIN {{peers}} p ON p.entity_id = gr.entity_id JOIN g ON g.region = p.region")
sql_query("fc76_prediction_log", f"WITH {WEIGHTS}, runs AS (SELECT er.entity_id, er.model, er.date AS run_date, er.predicted, er.k FROM er WHERE k % 63 = 0), twice AS (SELECT *, 1 AS version FROM runs UNION ALL SELECT entity_id, model, run_date, predicted * 1.01, k, 2 FROM runs WHERE k % 126 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, model, run_date ORDER BY version DESC) AS place FROM twice) SELECT entity_id, model, run_date, version, {rounded({'predicted': 'predicted'}, 2)} FROM k WHERE place = 1")
sql_query("fc32_hierarchy_feedback", f"WITH {IC}, t AS (SELECT entity_id, model, abs(ic) / sum(abs(ic)) OVER (PARTITION BY entity_id) AS importance FROM ic WHERE ic IS NOT NULL) SELECT entity_id, model, {rounded({'weight': '1e0 / 3 + greatest(-0.1e0, least(0.1e0, importance - 1e0 / 3))'}, 5)} FROM t")
sql_query("dq06_namespace_check", "WITH c AS (SELECT DISTINCT concat(CASE event_type WHEN 'click' THEN 'px_' WHEN 'view' THEN 'fin_' WHEN 'purchase' THEN 'macro_' ELSE 'zz_' END, event_type) AS name FROM {events}) SELECT name, split_part(name, '_', 1) AS namespace FROM c WHERE split_part(name, '_', 1) NOT IN ('px', 'fin', 'macro')")
sql_query("agg46_transfer_entropy_matrix", f"WITH {RET}, {HOME}, g AS (SELECT region, date, avg(ret) AS mean FROM h GROUP BY region, date), v AS (SELECT region, date, CASE WHEN mean < 0 THEN 0 ELSE 1 END AS b, CASE WHEN lag(mean) OVER (PARTITION BY region ORDER BY date) < 0 THEN 0 ELSE 1 END AS b0 FROM g WHERE mean IS NOT NULL), j AS (SELECT s.region AS src, d.region AS dst, d.b AS y, d.b0 AS y0, s.b0 AS x0, CAST(count(*) AS DOUBLE) AS n FROM v s JOIN v d ON d.date = s.date AND d.region <> s.region GROUP BY s.region, d.region, d.b, d.b0, s.b0), w AS (SELECT *, sum(n) OVER (PARTITION BY src, dst) AS total, sum(n) OVER (PARTITION BY src, dst, y, y0) AS ab, sum(n) OVER (PARTITION BY src, dst, y0, x0) AS bc, sum(n) OVER (PARTITION BY src, dst, y0) AS bb FROM j) SELECT src, dst, {rounded({'transfer_entropy': 'sum(n / total * ln(n * bb / (ab * bc)))'}, 5)} FROM w GROUP BY src, dst")
# Blocked by country; each side's best match.
sql_query(
    "join20_holder_match",
    "WITH a AS (SELECT c_custkey, c_name, c_nationkey FROM {customer}), b AS (SELECT c_custkey AS other, replace(c_name, '#', ' ') AS name, c_nationkey AS nation FROM {customer}), s AS (SELECT c_custkey, other, 1 - levenshtein(c_name, name) / CAST(greatest(length(c_name), length(name)) AS DOUBLE) AS similarity FROM a JOIN b ON b.nation = a.c_nationkey), k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(similarity, 9) DESC, other) AS p, row_number() OVER (PARTITION BY other ORDER BY round(similarity, 9) DESC, c_custkey) AS q FROM s WHERE similarity >= 0.85) SELECT c_custkey, other, round(similarity + 1e-9, 6) AS similarity FROM k WHERE p = 1 AND q = 1",
    matched,
)
