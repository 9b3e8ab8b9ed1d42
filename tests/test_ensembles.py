"""The lean form of the models' errors against the text that it stands for, with closes missing."""

import datetime as dt
import math

import pytest

from panelweave import registry, sqlops
from panelweave.operators import ensembles as e

registry.load()
DAY = dt.date(2024, 1, 1)


def px(spark):
    close = lambda k, t: None if (t * 7 + k) % 11 == 0 or t in (range(0), range(3), range(150, 230), range(300))[k] else 100 + 10 * math.sin(t / 5 + k) + t % 7 + 40 * (t % 50 > 44)
    rows = [(k, DAY + dt.timedelta(t), close(k, t)) for k in range(4) for t in range(300)] + [(9, DAY, 5.0), (8, DAY, 5.0), (8, DAY + dt.timedelta(1), 5.0)]
    return spark.createDataFrame(rows, "entity_id long, date date, close double").repartition(3)


def run(spark, text):
    df = spark.sql(sqlops.expand(text, sqlops.SPARK_FORMS), px=px(spark))
    return df, sorted((tuple(r) for r in df.collect()), key=repr)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("step, rows", [
    (e.MODELS, "SELECT entity_id, date, model, k, close, later, later_date, mode, back, predicted, err FROM er"),
    (e.WEIGHTS, "SELECT entity_id, model, n, mae, rmse, weight FROM wt"),
    (e.POINT, "SELECT entity_id, date, close, point, rmse, spread FROM pt"),
    (e.CONFORMAL, "SELECT pt.entity_id, date, close, point, q FROM pt JOIN ql ON ql.entity_id = pt.entity_id"),
])
def test_lean_step(spark, step, rows):
    _, want = run(spark, f"WITH {step} {rows}")
    _, got = run(spark, f"WITH {e.LEAN[step]} {rows.replace(' JOIN ql ON ql.entity_id = pt.entity_id', '')}")
    assert len(got) == len(want) > 0
    assert all(same(a, b) for g, w in zip(got, want) for a, b in zip(g, w))


@pytest.mark.parametrize("name", ["fc52_reject_option", "fc56_ohlc_bands", "fc54_prediction_table", "fc34_conformal_intervals", "agg28_forecast_aggregation", "fc55_horizon_interpolation", "fc76_prediction_log"])
def test_reads_prices_once_without_a_sort_a_model(spark, name):
    plan = sqlops.apply(name, spark, px=px(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == (2 if name == "fc76_prediction_log" else 1)  # its two versions
    assert not any("model" in line and "date" in line for line in plan.splitlines() if "Window [" in line and "version" not in line)
