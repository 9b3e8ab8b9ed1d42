"""Forecast errors, ensemble weights, intervals, confidence, frequencies and signals that are put together."""

import re

from panelweave.operators.macro import HOME, RET
from panelweave.sqlops import TEXTS, rounded, sql_query as plain_query

W = "(PARTITION BY entity_id ORDER BY date)"
# Four models predict the next close from what is known each day: the last value, a short mean, a trend and a pull to the mean.
MODELS = f"""n AS (SELECT entity_id, date, close, row_number() OVER {W} AS k, lead(close) OVER {W} AS later, lead(date) OVER {W} AS later_date FROM {{px}}),
 f AS (SELECT *, close AS p_last, avg(close) OVER a AS p_mean, CASE WHEN count(close) OVER b >= 5 THEN regr_intercept(close, CAST(k AS DOUBLE)) OVER b + (regr_slope(close, CAST(k AS DOUBLE)) OVER b) * (k + 1) END AS p_trend, close + 0.1 * ((avg(close) OVER b) - close) AS p_pull FROM n WINDOW a AS (PARTITION BY entity_id ORDER BY date ROWS 4 PRECEDING), b AS (PARTITION BY entity_id ORDER BY date ROWS 62 PRECEDING)),
 e AS (SELECT entity_id, date, k, close, later, later_date, model, CASE model WHEN 'last' THEN p_last WHEN 'mean' THEN p_mean WHEN 'trend' THEN p_trend ELSE p_pull END AS predicted FROM f CROSS JOIN (VALUES ('last'), ('mean'), ('trend'), ('pull')) AS t(model)),
 er AS (SELECT *, predicted - later AS err, CASE WHEN abs(RAT(close, lag(close, 4 * 5) OVER (PARTITION BY entity_id, model ORDER BY date)) - 1) > 0.3 THEN 'wild' ELSE 'calm' END AS mode, row_number() OVER (PARTITION BY entity_id, model ORDER BY date DESC) AS back FROM e WHERE predicted IS NOT NULL)"""
SCORES = f"{MODELS}, sc AS (SELECT entity_id, model, count(err) AS n, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse FROM er GROUP BY entity_id, model)"
WEIGHTS = f"{SCORES}, wt AS (SELECT *, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY entity_id) AS weight FROM sc WHERE rmse > 0)"
POINT = f"{WEIGHTS}, la AS (SELECT er.entity_id, er.date, er.model, er.predicted, er.close, wt.weight, wt.rmse FROM er JOIN wt ON wt.entity_id = er.entity_id AND wt.model = er.model WHERE back = 1), pt AS (SELECT entity_id, max(date) AS date, max(close) AS close, sum(weight * predicted) / sum(weight) AS point, sum(weight * rmse) / sum(weight) AS rmse, stddev_pop(predicted) AS spread FROM la GROUP BY entity_id)"
CONFORMAL = f"{POINT}, ql AS (SELECT entity_id, percentile_cont(0.9) WITHIN GROUP (ORDER BY abs(err)) AS q FROM er WHERE model = 'last' AND err IS NOT NULL GROUP BY entity_id)"


# What Spark runs instead of these: one ordered pass keeps the four forecasts side by side in a day's row, without a copy and a sort for each model.
# Sums of 63 rows are seven of nine, those three of three, of terms looked up behind the row, so none is added up anew in each frame; ``t`` weighs a term by its age. Counts and places are whole numbers, which running sums keep exact.
NAMES = {"last": "p_last", "mean": "p_mean", "trend": "p_trend", "pull": "p_pull"}


def _sums(s: str, t: str, step: int, number: int) -> str:
    """``number`` sums of ``step`` rows as one, and the same with terms weighed by age."""
    back = lambda x, k: f"coalesce(lag({x}, {k * step}) OVER {W}, 0e0)" if k else x
    total, aged = " + ".join(back(s, k) for k in range(number)), " + ".join(f"({back(t, k)} + {k * step} * {back(s, k)})" if k else t for k in range(number))
    return f"{total} AS s{step * number}, {aged if step > 1 else ' + '.join(f'{k} * {back(s, k)}' for k in range(1, number))} AS t{step * number}"


UP_TO = "(PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WIDE = f"""n AS (SELECT entity_id, date, close, coalesce(CAST(close AS DOUBLE), 0e0) AS y, CAST(close IS NOT NULL AS BIGINT) AS one, CAST(row_number() OVER {W} AS BIGINT) AS k, lead(close) OVER {W} AS later, lead(date) OVER {W} AS later_date, avg(close) OVER (PARTITION BY entity_id ORDER BY date ROWS 4 PRECEDING) AS p_mean FROM {{px}}),
 n3 AS (SELECT *, {_sums('y', '', 1, 3)}, struct(sum(one) OVER {UP_TO} AS c, sum(one * k) OVER {UP_TO} AS u, sum(one * k * k) OVER {UP_TO} AS v) AS seen FROM n),
 n9 AS (SELECT *, {_sums('s3', 't3', 3, 3)}, lag(seen, 63) OVER {W} AS old FROM n3),
 n63 AS (SELECT entity_id, date, close, k, later, later_date, p_mean, {_sums('s9', 't9', 9, 7)}, seen.c - coalesce(old.c, 0) AS c, seen.u - coalesce(old.u, 0) AS u, seen.v - coalesce(old.v, 0) AS v FROM n9),
 aged AS (SELECT *, CAST(k * c - u AS DOUBLE) AS a, CAST(k * k * c - 2 * k * u + v AS DOUBLE) AS aa FROM n63),
 f AS (SELECT entity_id, date, close, CAST(k AS INT) AS k, later, later_date, close AS p_last, p_mean, CASE WHEN c >= 5 THEN s63 / c - (c * t63 - a * s63) / (c * aa - a * a) * (1 + a / c) END AS p_trend, close + 0.1 * (CASE WHEN c > 0 THEN s63 / c END - close) AS p_pull FROM aged)"""
MARKED = f"""{WIDE}, fm AS (SELECT *, {', '.join(f"lag(CASE WHEN {p} IS NOT NULL THEN struct(close) END, 20) IGNORE NULLS OVER {W} AS was_{m}, count({p}) OVER (PARTITION BY entity_id) - count({p}) OVER {UP_TO} + 1 AS back_{m}" for m, p in NAMES.items())} FROM f)"""


def _each(of: str) -> str:
    return f"CASE model {' '.join(f'WHEN {m!r} THEN {of.format(m=m, p=p)}' for m, p in NAMES.items())} END"


ALL = "(VALUES ('last'), ('mean'), ('trend'), ('pull')) AS t(model)"
LEAN_MODELS = f"""{MARKED}, e AS (SELECT entity_id, date, k, close, later, later_date, model, {_each('{p}')} AS predicted, {_each('was_{m}')} AS was, CAST({_each('back_{m}')} AS INT) AS back FROM fm CROSS JOIN {ALL}),
 er AS (SELECT entity_id, date, k, close, later, later_date, model, predicted, predicted - later AS err, CASE WHEN abs(RAT(close, was.close) - 1) > 0.3 THEN 'wild' ELSE 'calm' END AS mode, back FROM e WHERE predicted IS NOT NULL)"""
_ERR = "({p} - later)"
_ENDS = "CASE WHEN {p} IS NOT NULL THEN date END"
_TOLD = {"n": f"count({_ERR})", "mae": f"avg(abs({_ERR}))", "rmse": f"sqrt(avg({_ERR} * {_ERR}))", "date": f"max({_ENDS})", "close": f"max_by(close, {_ENDS})", "predicted": f"max_by({{p}}, {_ENDS})"}


def _scores(more: str = "") -> str:
    """A row an entity with all models' scores and last forecasts, then a row a model."""
    wide = ", ".join(f"{of.format(p=p)} AS {name}_{m}" for m, p in NAMES.items() for name, of in _TOLD.items())
    return f"g AS (SELECT entity_id, {wide}{more} FROM f GROUP BY entity_id), sc AS (SELECT * FROM (SELECT entity_id, model, {', '.join(f"{_each(name + '_{m}')} AS {name}" for name in _TOLD)}{more and ', q'} FROM g CROSS JOIN {ALL}) a WHERE date IS NOT NULL)"


_WEIGHED = "wt AS (SELECT *, (1 / rmse) / sum(1 / rmse) OVER (PARTITION BY entity_id) AS weight FROM sc WHERE rmse > 0)"
_PT = "pt AS (SELECT entity_id, max(date) AS date, max(close) AS close, sum(weight * predicted) / sum(weight) AS point, sum(weight * rmse) / sum(weight) AS rmse, stddev_pop(predicted) AS spread{0} FROM wt GROUP BY entity_id{1})"
LEAN_SCORES = f"{WIDE}, {_scores()}"
LEAN_WEIGHTS = f"{LEAN_SCORES}, {_WEIGHED}"
LEAN_POINT = f"{LEAN_WEIGHTS}, {_PT.format('', '')}"
LEAN_CONFORMAL = f"{WIDE}, {_scores(', percentile_cont(0.9) WITHIN GROUP (ORDER BY abs(p_last - later)) AS q')}, {_WEIGHED}, {_PT.format(', max(q) AS q', ' HAVING max(q) IS NOT NULL')}"
LEAN = {CONFORMAL: LEAN_CONFORMAL, POINT: LEAN_POINT, WEIGHTS: LEAN_WEIGHTS, SCORES: LEAN_SCORES, MODELS: LEAN_MODELS}


def sql_query(name: str, text: str, planned: str | None = None) -> None:
    """Registers ``text``; Spark runs it with the lean form of the step that it begins with, ``er`` only where it names that."""
    for step, lean in LEAN.items():
        if step in text:
            own = text.replace(step, "")
            named = step != MODELS and re.search(r"\ber\b", own)
            planned = text.replace(step, lean.replace(WIDE, LEAN_MODELS) if named else lean).replace(" JOIN ql ON ql.entity_id = pt.entity_id", "")
            break
    plain_query(name, text, planned)


for row, model in (("fc02_walk_forward_last", "last"), ("fc04_walk_forward_trend", "trend"), ("fc05_walk_forward_mean_reversion", "pull")):
    sql_query(row, f"WITH {MODELS} SELECT entity_id, date, {rounded({'predicted': 'predicted', 'error': 'err'}, 3)} FROM er WHERE model = '{model}'")
sql_query("agg23_errors_by_mode", f"WITH {MODELS} SELECT entity_id, model, mode, count(err) AS n, {rounded({'mean_squared_error': 'avg(err * err)'}, 2)} FROM er WHERE err IS NOT NULL GROUP BY entity_id, model, mode")
HORIZONS = "(VALUES (1e0), (5e0), (21e0), (252e0)) AS hz(h)"
sql_query("agg28_forecast_aggregation", f"WITH {POINT} SELECT entity_id, CAST(h AS INT) AS horizon, {rounded({'forecast': 'close + (point - close) * h'}, 3)} FROM pt CROSS JOIN {HORIZONS}")
sql_query("agg37_coverage_confidence", f"WITH {MODELS}, q AS (SELECT entity_id, model, percentile_cont(0.9) WITHIN GROUP (ORDER BY abs(err)) AS w, max(close) - min(close) AS span FROM er GROUP BY entity_id, model) SELECT er.entity_id, er.model, {rounded({'coverage': 'avg(CASE WHEN abs(err) <= w THEN 1e0 ELSE 0e0 END)', 'confidence': 'avg(CASE WHEN abs(err) <= w THEN 1e0 ELSE 0e0 END) * greatest(0e0, 1 - max(w) / max(span))'}, 5)} FROM er JOIN q ON q.entity_id = er.entity_id AND q.model = er.model WHERE err IS NOT NULL GROUP BY er.entity_id, er.model")
sql_query("agg77_tier_model_priors", f"WITH {SCORES}, t AS (SELECT tier, model, avg(rmse) AS rmse FROM sc JOIN {{tiers}} s ON s.entity_id = sc.entity_id GROUP BY tier, model) SELECT tier, model, {rounded({'prior': '(1 / rmse) / sum(1 / rmse) OVER (PARTITION BY tier)'})} FROM t")
sql_query("fc15_temporal_split", f"WITH p AS (SELECT entity_id, date, percent_rank() OVER {W} AS place FROM {{px}}) SELECT entity_id, date, CASE WHEN place > 0.8 THEN 'test' ELSE 'train' END AS part FROM p")
sql_query("fc81_adaptive_split", f"WITH p AS (SELECT entity_id, date, percent_rank() OVER {W} AS place, count(*) OVER (PARTITION BY entity_id) AS n FROM {{px}}) SELECT entity_id, date, CASE WHEN place > 1 - greatest(0.1e0, least(0.3e0, 4 / sqrt(n))) THEN 'test' ELSE 'train' END AS part FROM p")
sql_query("fc34_conformal_intervals", f"WITH {CONFORMAL} SELECT pt.entity_id, CAST(h AS INT) AS horizon, {rounded({'low': 'point - q * sqrt(h)', 'point': 'point', 'high': 'point + q * sqrt(h)'}, 3)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
sql_query("fc35_conformal_table", f"WITH {CONFORMAL}, m AS (SELECT entity_id, max_by(mode, date) AS mode FROM er GROUP BY entity_id) SELECT pt.entity_id, CAST(h AS INT) AS horizon, m.mode, {rounded({'width': 'q * sqrt(h) * CASE WHEN mode = ' + repr('wild') + ' THEN 1.5e0 ELSE 1e0 END * CASE WHEN h <= 5 THEN 1.2e0 ELSE 1e0 END'}, 3)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id JOIN m ON m.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
# The geometric mean of the models' quality, measured by the median error of all models, and of the entity's chance to survive; a half and 1 where unknown.
sql_query(
    "fc41_confidence_score",
    f"""WITH {POINT}, rf AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY rmse) AS reference FROM sc), ds AS (SELECT entity_id, max_by(survival_probability, date) AS distress FROM ({TEXTS["anal02_survival_probability"]}) a GROUP BY entity_id),
    q AS (SELECT pt.entity_id, CASE WHEN rmse IS NULL OR coalesce(reference, 0e0) <= 1e-10 THEN 0.5e0 ELSE exp(-rmse / reference) END AS quality, greatest(0e0, least(1e0, coalesce(1 - distress, 1e0))) AS survival FROM pt CROSS JOIN rf LEFT JOIN ds ON ds.entity_id = pt.entity_id)
    SELECT entity_id, {rounded({"confidence": "sqrt(quality * survival)"}, 5)} FROM q""",
)
sql_query("fc42_band_confidence", f"WITH {CONFORMAL} SELECT pt.entity_id, CAST(h AS INT) AS horizon, {rounded({'confidence': 'coalesce(1 / (1 + RAT(2 * q * sqrt(h), close) / (0.04 * sqrt(h))), 0.5e0)'}, 5)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
IC = f"{MODELS}, ic AS (SELECT entity_id, model, PEARSON(predicted - close, later - close) AS ic, avg(CASE WHEN sign(predicted - close) = sign(later - close) THEN 1e0 ELSE 0e0 END) AS hit, count(later) AS n, stddev_samp(err) AS sd FROM er WHERE later IS NOT NULL AND model <> 'last' GROUP BY entity_id, model)"
sql_query("fc43_ic_calibration", f"WITH {IC}, w AS (SELECT entity_id, model, greatest(0.05e0, 1 + coalesce(ic, 0e0)) / sd AS raw FROM ic WHERE sd > 0) SELECT entity_id, model, {rounded({'weight': 'raw / sum(raw) OVER (PARTITION BY entity_id)'})} FROM w")
sql_query("fc44_log_feedback", f"WITH {IC}, w AS (SELECT entity_id, model, hit, greatest(0.1e0, hit) / sd AS raw FROM ic WHERE sd > 0) SELECT entity_id, model, {rounded({'hit_rate': 'hit', 'weight': 'raw / sum(raw) OVER (PARTITION BY entity_id)'})} FROM w")
sql_query("top08_strong_signals", f"WITH {IC}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(ic) DESC, model) AS place FROM ic WHERE abs(ic) >= 0.02) SELECT entity_id, model, CAST(place AS INT) AS place, {rounded({'ic': 'ic'}, 5)} FROM k")
sql_query("anal79_brier_calibration", f"WITH {IC}, c AS (SELECT entity_id, model, n, hit, 0.65e0 AS conviction, least(0.8e0, n / 100e0) AS alpha FROM ic WHERE n >= 10) SELECT entity_id, model, {rounded({'brier': '(conviction - hit) * (conviction - hit)', 'calibrated': 'alpha * hit + (1 - alpha) * conviction'}, 5)}, CAST(conviction > hit + 0.15 AS INT) AS overconfident FROM c")
sql_query("anal100_ic_attribution", f"WITH {RET}, s AS (SELECT entity_id, freq, CASE freq WHEN 'W' THEN RAT(close, lag(close, 5) OVER w) - 1 WHEN 'M' THEN RAT(close, lag(close, 21) OVER w) - 1 ELSE RAT(close, lag(close, 63) OVER w) - 1 END AS signal, RAT(lead(close, 5) OVER w, close) - 1 AS later FROM r CROSS JOIN (VALUES ('W'), ('M'), ('Q')) AS t(freq) WINDOW w AS (PARTITION BY entity_id, freq ORDER BY date)) SELECT entity_id, freq, count(signal) AS n, {rounded({'ic': 'PEARSON(signal, later)'}, 5)} FROM s GROUP BY entity_id, freq")
sql_query("win58_rolling_ic", f"WITH {RET}, s AS (SELECT entity_id, date, RAT(close, lag(close, 21) OVER {W}) - 1 AS x, RAT(lead(close, 5) OVER {W}, close) - 1 AS y FROM r), v AS (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY x) + (count(*) OVER (PARTITION BY entity_id, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY entity_id ORDER BY y) + (count(*) OVER (PARTITION BY entity_id, y) - 1) / 2e0 AS ry FROM s WHERE x IS NOT NULL AND y IS NOT NULL), i AS (SELECT entity_id, date, CASE WHEN count(*) OVER w >= 30 THEN PEARSON_OVER(rx, ry, w) END AS ic FROM v WINDOW w AS (PARTITION BY entity_id ORDER BY date ROWS 125 PRECEDING)) SELECT entity_id, {rounded({'mean_ic': 'avg(ic)', 'icir': 'RAT(avg(ic), stddev_samp(ic))'}, 4)}, CAST(coalesce(abs(RAT(avg(ic), stddev_samp(ic))) >= 0.3 AND abs(avg(ic)) >= 0.02, false) AS INT) AS strong FROM i GROUP BY entity_id")
sql_query("fc46_regime_blended_weights", f"WITH {MODELS}, a AS (SELECT entity_id, model, mode, 1 / sqrt(avg(err * err)) AS affinity FROM er WHERE err IS NOT NULL GROUP BY entity_id, model, mode HAVING avg(err * err) > 0), p AS (SELECT entity_id, avg(CASE WHEN mode = 'wild' THEN 1e0 ELSE 0e0 END) AS wild FROM er WHERE back <= 21 GROUP BY entity_id), s AS (SELECT a.entity_id, model, sum(affinity * CASE WHEN mode = 'wild' THEN wild ELSE 1 - wild END) AS raw FROM a JOIN p ON p.entity_id = a.entity_id GROUP BY a.entity_id, model) SELECT entity_id, model, {rounded({'weight': 'RAT(raw, sum(raw) OVER (PARTITION BY entity_id))'})} FROM s")
sql_query("anal31_regime_affinity", f"WITH {MODELS}, a AS (SELECT mode, model, 1 / avg(abs(err)) AS inverse FROM er WHERE err IS NOT NULL GROUP BY mode, model) SELECT mode, model, {rounded({'affinity': 'inverse / sum(inverse) OVER (PARTITION BY mode)'})} FROM a")
sql_query("fc48_model_routing", f"WITH {RET}, m AS (SELECT entity_id, stddev_samp(ret) AS vol, avg(ret) AS drift, PEARSON(ret, p) AS auto FROM (SELECT *, lag(ret) OVER {W} AS p FROM r) a GROUP BY entity_id) SELECT entity_id, CASE WHEN auto < -0.2 THEN 'pull' WHEN abs(drift) > vol / 10 THEN 'trend' WHEN vol > 0.5 THEN 'last' ELSE 'mean' END AS favoured FROM m")
sql_query("fc49_tail_widening", f"WITH {RET}, {HOME}, g AS (SELECT region, date, avg(ret) AS mean FROM h GROUP BY region, date), q AS (SELECT region, percentile_cont(0.1) WITHIN GROUP (ORDER BY mean) AS low FROM g GROUP BY region), j AS (SELECT h.entity_id, avg(CASE WHEN g.mean <= q.low AND h.ret < -0.05 THEN 1e0 ELSE 0e0 END) AS joint, avg(CASE WHEN h.ret < -0.05 THEN 1e0 ELSE 0e0 END) AS tail FROM h JOIN g ON g.region = h.region AND g.date = h.date JOIN q ON q.region = h.region GROUP BY h.entity_id) SELECT entity_id, {rounded({'factor': 'CASE WHEN joint <= 0.02 THEN 1e0 ELSE least(2e0, 1 + (joint - 0.02) / 0.98 * greatest(tail, 0.3e0) * 1) END'}, 5)} FROM j")
sql_query("fc52_reject_option", f"WITH {CONFORMAL} SELECT pt.entity_id, CAST(h AS INT) AS horizon, CAST(2 * q * sqrt(h) > 2 * abs(point) AS INT) AS rejected, {rounded({'point': 'CASE WHEN 2 * q * sqrt(h) > 2 * abs(point) THEN close ELSE point END', 'confidence': 'CASE WHEN 2 * q * sqrt(h) > 2 * abs(point) THEN 0.3e0 ELSE 1e0 END'}, 3)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
sql_query("fc53_next_day_prices", f"WITH {RET}, v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY entity_id ORDER BY date ROWS 20 PRECEDING) AS vol, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS back FROM r) SELECT entity_id, {rounded({'open': 'close', 'high': 'close * (1 + 0.6 * vol)', 'low': 'close * (1 - 0.6 * vol)', 'close': 'close'}, 3)} FROM v WHERE back = 1")
sql_query("fc54_prediction_table", f"WITH {CONFORMAL} SELECT pt.entity_id, 'close' AS variable, CAST(h AS INT) AS horizon, {rounded({'low': 'close + (point - close) * h - q * sqrt(h)', 'forecast': 'close + (point - close) * h', 'high': 'close + (point - close) * h + q * sqrt(h)', 'disagreement': 'spread'}, 3)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
sql_query("fc55_horizon_interpolation", f"WITH {POINT}, hp AS (SELECT entity_id, h, close + (point - close) * sqrt(h) AS y FROM pt CROSS JOIN {HORIZONS}), pr AS (SELECT entity_id, h AS h0, y AS y0, lead(h) OVER (PARTITION BY entity_id ORDER BY h) AS h1, lead(y) OVER (PARTITION BY entity_id ORDER BY h) AS y1 FROM hp) SELECT entity_id, CAST(d AS INT) AS day, {rounded({'forecast': 'y0 + (y1 - y0) * (d - h0) / (h1 - h0)'}, 3)} FROM pr JOIN (VALUES (1e0), (2e0), (3e0), (10e0), (42e0), (63e0), (126e0)) AS t(d) ON d >= h0 AND d < h1")
sql_query("fc56_ohlc_bands", f"WITH {CONFORMAL} SELECT pt.entity_id, CAST(h AS INT) AS horizon, {rounded({'open': 'close', 'close': 'point', 'high': 'greatest(close, point) + 0.5 * q * sqrt(h)', 'low': 'least(close, point) - 0.5 * q * sqrt(h)'}, 3)} FROM pt JOIN ql ON ql.entity_id = pt.entity_id CROSS JOIN {HORIZONS}")
sql_query("fc62_latest_values", f"SELECT entity_id, {rounded({x: f'max_by({x}, date) FILTER (WHERE {x} IS NOT NULL)' for x in ('close', 'revenue', 'receivables', 'total_equity')}, 3)} FROM {{day}} GROUP BY entity_id")
sql_query("fc74_secular_regime", f"WITH p AS (SELECT entity_id, date, RAT(close, max(close) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS fall FROM {{px}}) SELECT entity_id, date, CASE WHEN fall > -0.1 THEN 'secular_bull' WHEN fall > -0.3 THEN 'correction' ELSE 'secular_bear' END AS regime FROM p")
sql_query("fc75_forecast_bounds", f"SELECT entity_id, {rounded({'close_low': 'min(close)', 'close_high': 'max(close)', 'revenue_low': 'min(revenue)', 'revenue_high': 'max(revenue)'}, 3)} FROM {{day}} GROUP BY entity_id")
sql_query("fc80_plane_weights", f"WITH {WEIGHTS}, a AS (SELECT wt.entity_id, model, weight * CASE WHEN (trends = 1) = (model IN ('trend', 'mean')) THEN 1.2e0 ELSE 0.9e0 END AS raw FROM wt JOIN {{trending}} q ON q.entity_id = wt.entity_id) SELECT entity_id, model, {rounded({'weight': 'raw / sum(raw) OVER (PARTITION BY entity_id)'})} FROM a")
# One panel at several frequencies, and what they say together.
FREQS = "fq AS (SELECT entity_id, freq, period, max_by(close, date) AS close, max(date) AS date FROM (SELECT x.*, freq, CAST(CASE freq WHEN 'W' THEN date_trunc('week', date) WHEN 'M' THEN date_trunc('month', date) ELSE date_trunc('quarter', date) END AS DATE) AS period FROM {px} x CROSS JOIN (VALUES ('W'), ('M'), ('Q')) AS t(freq)) a GROUP BY entity_id, freq, period), fr AS (SELECT *, RAT(close, lag(close) OVER w) - 1 AS ret, RAT(close, max(close) OVER (PARTITION BY entity_id, freq ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS fall, row_number() OVER (PARTITION BY entity_id, freq ORDER BY period DESC) AS back FROM fq WINDOW w AS (PARTITION BY entity_id, freq ORDER BY period)), fx AS (SELECT *, CASE WHEN fall < -0.3 THEN 'bear' WHEN ret > 0 THEN 'bull' ELSE 'flat' END AS regime, CASE freq WHEN 'W' THEN 0.2e0 WHEN 'M' THEN 0.3e0 ELSE 0.5e0 END AS weight FROM fr)"
CONSENSUS = f"{FREQS}, vt AS (SELECT entity_id, regime, sum(weight) AS votes FROM fx WHERE back = 1 GROUP BY entity_id, regime), cs AS (SELECT entity_id, regime, votes, row_number() OVER (PARTITION BY entity_id ORDER BY votes DESC, regime) AS place FROM vt)"
sql_query("fc64_regime_consensus", f"WITH {CONSENSUS} SELECT entity_id, regime, {rounded({'agreement': 'votes'}, 4)} FROM cs WHERE place = 1")
sql_query("anal77_frequency_disagreement", f"WITH {CONSENSUS}, l AS (SELECT entity_id, DAYS(max(filing_date), CAST('2002-03-31' AS DATE)) AS age FROM {{filings}} GROUP BY entity_id) SELECT cs.entity_id, {rounded({'disagreement': '1 - votes + CASE WHEN age > 60 THEN least(0.3e0, (age - 60) / 300e0) ELSE 0e0 END'}, 5)} FROM cs JOIN l ON l.entity_id = cs.entity_id WHERE place = 1")
sql_query("fc65_fused_survival", f"WITH {FREQS}, s AS (SELECT entity_id, weight, 1 / (1 + exp(5 * (-fall - 0.4))) AS survival FROM fx WHERE back = 1) SELECT entity_id, {rounded({'survival': 'sum(weight * survival) / sum(weight)', 'spread': 'max(survival) - min(survival)', 'tail': 'min(survival)'}, 5)} FROM s GROUP BY entity_id")
sql_query("fc66_break_alignment", f"WITH {FREQS}, b AS (SELECT entity_id, freq, date FROM fx WHERE abs(ret) > 0.5), j AS (SELECT a.entity_id, a.freq, a.date, count(DISTINCT o.freq) AS others FROM b a LEFT JOIN b o ON o.entity_id = a.entity_id AND o.freq <> a.freq AND abs(DAYS(a.date, o.date)) <= 30 WHERE a.freq = 'W' GROUP BY a.entity_id, a.freq, a.date) SELECT entity_id, date, others, CASE WHEN others >= 2 THEN 'structural' WHEN others = 1 THEN 'medium' ELSE 'low' END AS confidence FROM j")
sql_query("fc67_spectral_gating", f"WITH {FREQS}, g AS (SELECT entity_id, freq, sqrt(avg(ret * ret)) AS rmse FROM fx WHERE ret IS NOT NULL GROUP BY entity_id, freq) SELECT entity_id, freq, {rounded({'weight': '(1 / rmse) / sum(1 / rmse) OVER (PARTITION BY entity_id)'})} FROM g WHERE rmse > 0")
sql_query("fc68_disagreement_signal", f"WITH {FREQS}, p AS (SELECT entity_id, max(CASE WHEN freq = 'W' THEN sign(ret) END) AS w, max(CASE WHEN freq = 'M' THEN sign(ret) END) AS m, max(CASE WHEN freq = 'Q' THEN sign(ret) END) AS q FROM fx WHERE back = 1 GROUP BY entity_id) SELECT entity_id, CASE WHEN w = m AND m = q THEN 'aligned' WHEN w <> m AND m = q THEN 'pullback' WHEN w = m AND m <> q THEN 'reversal' ELSE 'noisy' END AS shape FROM p")
sql_query("fc69_horizon_ownership", f"WITH {FREQS}, a AS (SELECT entity_id, freq, avg(ret) AS mean FROM fx WHERE back <= 8 GROUP BY entity_id, freq) SELECT entity_id, horizon, {rounded({'forecast': 'sum(mean * CASE WHEN freq = owner THEN 0.7e0 ELSE 0.15e0 END)'}, 5)} FROM a CROSS JOIN (VALUES (5, 'W'), (21, 'M'), (63, 'Q')) AS t(horizon, owner) GROUP BY entity_id, horizon")
# A year should be the sum of its quarters: the gap is spread by the variance of each side.
sql_query("fc70_temporal_reconciliation", f"WITH q AS (SELECT entity_id, year(report_date) AS year, sum(revenue) AS total, sum(revenue * revenue) * 0.0004 AS vq FROM {{fin}} GROUP BY entity_id, year(report_date)), a AS (SELECT q.*, r.annual, total * total * 0.0001 AS va FROM q JOIN {{annual_reports}} r ON r.entity_id = q.entity_id AND r.year = q.year) SELECT entity_id, CAST(year AS INT) AS year, {rounded({'annual': 'annual - (annual - total) * va / (va + vq)', 'quarters': 'total + (annual - total) * vq / (va + vq)'}, 2)} FROM a")
sql_query("fc71_fusion_bundle", f"WITH {CONSENSUS}, a AS (SELECT entity_id, avg(ret) AS mean, stddev_samp(ret) AS sd FROM fx WHERE back <= 8 GROUP BY entity_id) SELECT cs.entity_id, cs.regime, {rounded({'agreement': 'votes', 'fused_mean': 'mean', 'fused_sd': 'sd'}, 5)} FROM cs JOIN a ON a.entity_id = cs.entity_id WHERE place = 1")
sql_query("fc72_multi_frequency_run", f"WITH {FREQS} SELECT entity_id, freq, count(*) AS n_periods, {rounded({'mean_return': 'avg(ret)', 'volatility': 'stddev_samp(ret)', 'worst_fall': 'min(fall)'}, 5)}, max_by(regime, period) AS regime FROM fx GROUP BY entity_id, freq")
sql_query("fc86_per_frequency_pipeline", f"WITH {FREQS}, m AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY entity_id ORDER BY period ROWS 11 PRECEDING) AS vol FROM fx WHERE freq = 'M') SELECT entity_id, period, regime, {rounded({'ret': 'ret', 'vol_12': 'vol', 'fall': 'fall'}, 5)} FROM m")
sql_query("anal96_regime_metric_weights", f"WITH {CONSENSUS} SELECT entity_id, cs.regime, metric, weight FROM cs JOIN (VALUES ('bull', 'growth', 0.4e0), ('bull', 'quality', 0.3e0), ('bull', 'value', 0.3e0), ('bear', 'growth', 0.1e0), ('bear', 'quality', 0.5e0), ('bear', 'value', 0.4e0), ('flat', 'growth', 0.3e0), ('flat', 'quality', 0.35e0), ('flat', 'value', 0.35e0)) AS t(name, metric, weight) ON cs.regime = name WHERE place = 1")
sql_query("anal97_signal_ensemble", f"WITH {FREQS}, s AS (SELECT entity_id, max(CASE WHEN freq = 'M' THEN ret END) AS a, max(CASE WHEN freq = 'Q' THEN ret END) AS b FROM fx WHERE back = 1 GROUP BY entity_id) SELECT entity_id, {rounded({'signal': 'greatest(-1e0, least(1e0, (0.6 * a + 0.4 * b) * CASE WHEN sign(a) <> sign(b) THEN 0.5e0 ELSE 1e0 END))'}, 5)} FROM s")
sql_query("anal76_anomaly_routing", f"WITH {FREQS} SELECT entity_id, freq, period, rule, action FROM fx JOIN (VALUES ('crash', -10e0, -0.5e0, 'freeze'), ('spike', 1e0, 100e0, 'override'), ('swing', 0.7e0, 1e0, 'review')) AS t(rule, low, high, action) ON ret >= low AND ret < high")
sql_query("anal78_correlation_aware_weights", f"WITH {RET}, s AS (SELECT entity_id, avg(ret) AS score, var_samp(ret) AS v FROM r GROUP BY entity_id), k AS (SELECT *, ntile(4) OVER (ORDER BY score, entity_id) AS part FROM s WHERE v > 0), g AS (SELECT part, 1 / avg(v) AS pw FROM k GROUP BY part), w AS (SELECT k.entity_id, k.part, pw / sum(1 / v) OVER (PARTITION BY k.part) / v AS raw FROM k JOIN g ON g.part = k.part) SELECT entity_id, CAST(part AS INT) AS part, {rounded({'weight': 'raw / sum(raw) OVER ()'}, 8)} FROM w")
sql_query("anal101_fusion_summary", f"WITH {CONSENSUS}, s AS (SELECT entity_id, avg(weight * sign(ret)) AS tilt FROM fx WHERE back = 1 GROUP BY entity_id) SELECT cs.entity_id, cs.regime, {rounded({'agreement': 'votes', 'tilt': 'tilt'}, 5)}, CASE WHEN votes >= 0.7 AND tilt > 0 THEN 'buy' WHEN votes >= 0.7 AND tilt < 0 THEN 'sell' ELSE 'hold' END AS verdict FROM cs JOIN s ON s.entity_id = cs.entity_id WHERE place = 1")
sql_query("anal28_adaptive_windows", "WITH g AS (SELECT entity_id, DAYS(lag(report_date) OVER (PARTITION BY entity_id ORDER BY report_date), report_date) AS gap FROM {fin}), m AS (SELECT entity_id, percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(gap AS DOUBLE)) AS gap FROM g GROUP BY entity_id) SELECT entity_id, CASE WHEN gap < 120 THEN 'Q' WHEN gap < 250 THEN 'S' ELSE 'A' END AS freq, CASE WHEN gap < 120 THEN 63 WHEN gap < 250 THEN 126 ELSE 252 END AS window_rows FROM m")
sql_query("agg40_plain_transitions", f"WITH {RET}, s AS (SELECT entity_id, date, CASE WHEN ret < -0.02 THEN 'down' WHEN ret > 0.02 THEN 'up' ELSE 'flat' END AS state FROM r WHERE ret IS NOT NULL), t AS (SELECT entity_id, state, lead(state) OVER (PARTITION BY entity_id ORDER BY date) AS next FROM s) SELECT entity_id, state, next, count(*) AS n, {rounded({'probability': 'count(*) / CAST(sum(count(*)) OVER (PARTITION BY entity_id, state) AS DOUBLE)'})} FROM t WHERE next IS NOT NULL GROUP BY entity_id, state, next")
sql_query("agg67_regime_risk_multiplier", f"WITH {RET}, s AS (SELECT entity_id, CASE WHEN RAT(close, lag(close, 21) OVER {W}) - 1 < -0.1 THEN 'bear' WHEN RAT(close, lag(close, 21) OVER {W}) - 1 > 0.1 THEN 'bull' ELSE 'flat' END AS regime, ret FROM r), v AS (SELECT entity_id, regime, stddev_samp(ret) AS sd FROM s GROUP BY entity_id, regime) SELECT entity_id, {rounded({'multiplier': 'RAT(max(sd), min(sd))'}, 5)} FROM v GROUP BY entity_id")
sql_query("agg78_proxy_confidence", f"SELECT entity_id, report_date, {rounded({'confidence': 'exp(ln(CASE WHEN receivables IS NULL THEN 0.6e0 ELSE 1e0 END) + ln(CASE WHEN cash_and_equivalents IS NULL THEN 0.5e0 ELSE 1e0 END) + ln(CASE WHEN research_and_development IS NULL THEN 0.8e0 ELSE 1e0 END))'})} FROM {{fin}}")
sql_query("set02_causal_edges", f"WITH {RET}, {HOME}, g AS (SELECT region, date, avg(ret) AS x FROM h GROUP BY region, date), p AS (SELECT a.region AS src, b.region AS dst, PEARSON(a.x, b.y) AS c, PEARSON(sign(a.x), sign(b.y)) AS s FROM g a JOIN (SELECT region, lag(date) OVER (PARTITION BY region ORDER BY date) AS date, x AS y FROM g) b ON b.date = a.date AND b.region <> a.region GROUP BY a.region, b.region), u AS (SELECT src, dst, 'granger' AS method FROM p WHERE abs(c) > 0.02 UNION ALL SELECT src, dst, 'transfer_entropy' FROM p WHERE abs(s) > 0.02) SELECT src, dst, CASE WHEN count(*) > 1 THEN 'both' ELSE min(method) END AS method FROM u GROUP BY src, dst")
sql_query("set06_weight_merge", f"WITH {WEIGHTS}, o AS (SELECT * FROM {{expert_weights}}) SELECT coalesce(wt.entity_id, o.entity_id) AS entity_id, coalesce(wt.model, o.model) AS model, {rounded({'weight': 'coalesce(o.weight, wt.weight)'})} FROM wt FULL OUTER JOIN o ON o.entity_id = wt.entity_id AND o.model = wt.model")
# Suppliers are connected where their customers' countries are; a share of each link passes an infection on.
EDGES = "ed AS (SELECT DISTINCT s_suppkey AS src, n_name AS dst FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey), hop AS (SELECT src, dst, 0.3e0 AS p FROM ed)"
sql_query("graph04_k_hop_exposure", f"WITH {EDGES}, h1 AS (SELECT dst AS node, max(p) AS p FROM hop WHERE src % 7 = 0 GROUP BY dst), h2 AS (SELECT hop.src AS node, max(h1.p * 0.3e0) AS p FROM hop JOIN h1 ON h1.node = hop.dst GROUP BY hop.src) SELECT node, {rounded({'exposure': 'p'})} FROM h2")
sql_query("graph07_graph_risk_bundle", f"WITH {EDGES}, d AS (SELECT dst, count(*) AS degree FROM ed GROUP BY dst) SELECT ed.src AS entity_id, ed.dst AS country, degree, {rounded({'centrality': 'degree / CAST(sum(degree) OVER () AS DOUBLE)'}, 8)} FROM ed JOIN d ON d.dst = ed.dst")
sql_query("graph08_ownership_weights", "WITH h AS (SELECT DISTINCT l_suppkey AS entity_id, o_custkey AS holder FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey), d AS (SELECT holder, count(*) AS degree FROM h GROUP BY holder) SELECT h.entity_id, count(*) AS holders, round(sum(1e0 / degree) / count(*) + 1e-9, 6) AS exclusivity FROM h JOIN d ON d.holder = h.holder GROUP BY h.entity_id")
sql_query("join22_corporate_tree", "WITH e AS (SELECT s_suppkey AS entity_id, CAST(floor(s_suppkey / 2e0) AS BIGINT) AS parent FROM {supplier}), l1 AS (SELECT e.entity_id, e.parent, p.parent AS grand FROM e LEFT JOIN e p ON p.entity_id = e.parent AND p.entity_id <> e.entity_id), l2 AS (SELECT l1.*, g.parent AS great FROM l1 LEFT JOIN e g ON g.entity_id = l1.grand AND g.entity_id <> l1.entity_id), k AS (SELECT parent, count(*) AS children FROM e WHERE parent <> entity_id GROUP BY parent) SELECT l2.entity_id, l2.parent, coalesce(l2.great, l2.grand, l2.parent) AS ultimate_parent, coalesce(k.children, 0) AS children FROM l2 LEFT JOIN k ON k.parent = l2.entity_id")
sql_query("src09_ohlcv_stitch", f"WITH a AS (SELECT * FROM {{px}} WHERE day(date) % 3 <> 0), b AS (SELECT entity_id, date, close * 1.001 AS close, volume FROM {{px}} WHERE day(date) % 2 = 0) SELECT entity_id, date, source, {rounded({'close': 'close'}, 3)} FROM (SELECT entity_id, date, 'primary' AS source, close FROM a UNION ALL SELECT b.entity_id, b.date, 'fallback', b.close FROM b LEFT JOIN a ON a.entity_id = b.entity_id AND a.date = b.date WHERE a.date IS NULL) u")
sql_query("src10_benchmark_returns", f"WITH {RET}, {HOME}, g AS (SELECT region, date, avg(close) AS level FROM h GROUP BY region, date) SELECT region, benchmark, date, {rounded({'benchmark_return_1d': 'RAT(level, lag(level) OVER (PARTITION BY region ORDER BY date)) - 1'})} FROM g JOIN (VALUES ('AFRICA', 'AFX'), ('AMERICA', 'AMX'), ('ASIA', 'ASX'), ('EUROPE', 'EUX'), ('MIDDLE EAST', 'MEX')) AS t(name, benchmark) ON region = name")
sql_query("src12_raw_filing_scan", f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY entity_id, report_date ORDER BY filing_date DESC) AS place FROM {{fin}} WHERE report_date > CAST('1996-12-31' AS DATE)), c AS (SELECT DISTINCT entity_id, MONTH_OF(date) AS month FROM {{px}}), j AS (SELECT c.entity_id, c.month, k.revenue, k.total_assets FROM c LEFT JOIN k ON k.entity_id = c.entity_id AND MONTH_OF(k.filing_date) = c.month AND place = 1) SELECT entity_id, month, {rounded({x: f'LASTSEEN({x}) OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)' for x in ('revenue', 'total_assets')}, 2)} FROM j")
