"""What queries write and shuffle grows with their rows, not with what they work out for each."""

import datetime as dt
import os

import numpy as np
import pyarrow as pa
import pytest

from panelweave import registry, scans
from panelweave.operators import trees
from panelweave.sources.files import scratch


def test_a_scan_writes_its_rows_not_their_maps(spark, monkeypatch):
    """Fifteen pairs of weights have maps of 90 numbers a row; only blocks of rows are written. Rows of a key in one long run and of many keys."""
    monkeypatch.setattr(scans, "LEAST_ROWS", 5000)
    rng = np.random.default_rng(5)
    rows = [(0 if k < 12000 else k // 100, k, float(rng.normal())) for k in range(20000)]
    path = scratch(spark, "lean")
    df = spark.createDataFrame(rows, "entity_id long, t long, x double").repartition(3)
    found = scans.scan(df, "entity_id", ["t"], ["x"], scans.Smoothed((0.1, 0.3, 0.5, 0.7, 0.9), (0.0, 0.1, 0.3)), path)
    got = {(r["entity_id"], r["t"]): (r["place"], r["after_4"]) for r in found.select("entity_id", "t", "place", "after_4").collect()}
    level = trend = before = None
    for e, t, x in rows:  # the fifth pair: weights 0.3 and 0.1
        place = place + 1 if before == e else 1
        if before != e:
            level, trend = x, 0.0
        else:
            new = 0.3 * x + 0.7 * (level + trend)
            level, trend = new, 0.1 * (new - level) + 0.9 * trend
        before = e
        assert got[e, t][0] == place and abs(got[e, t][1] - level - trend) < 1e-9
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path.removeprefix("file://")) for f in files)
    assert size < 100 * len(rows)


@pytest.mark.parametrize("name", ["anal14_vanity_score", "win53_vanity_trend", "anal36_tier_scores"])
def test_days_are_made_once_and_stay_where_they_are(spark, name):
    """The scores keep the day's fields instead of joining the panel with itself; after the as-of join days aren't dealt again."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1  # prices; statements don't read the order key
    days = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and ", date#" in line]
    assert len(days) == 1 and "report_date" not in "".join(line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_forests_of_all_shadow_rounds_grow_in_the_same_passes(spark, monkeypatch):
    """A pass for each level, whatever the number of rounds; shadows have their columns' values within each entity."""
    rng, passes, grown = np.random.default_rng(6), [], trees.histogram_trees.grown
    monkeypatch.setattr(trees.histogram_trees, "grown", lambda *given: (passes.append(1), grown(*given)))
    rows = [(e, dt.date(2024, 1, 1) + dt.timedelta(t), float(a), float(b), float(2 * a + rng.normal())) for e in range(6) for t, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "entity_id long, date date, a double, b double, label double")
    verdict = {c: (wins, v) for c, wins, _, v in trees.shadow_test(df, ("a", "b"), rounds=4)}
    assert verdict["a"] == (4, "confirmed") and verdict["b"][1] != "confirmed" and len(passes) == 6
    monkeypatch.setattr(trees.histogram_trees, "BLOCK", 300)
    keys, day = np.repeat(np.arange(5), 100), np.tile(np.arange(100), 5)
    model = trees.histogram_trees.Trees(["a"], [np.arange(0.0, 240.0)], 1, 0, np.zeros(0))
    batches = [pa.RecordBatch.from_arrays([pa.array(v[s : s + 70]) for v in (keys, day, day, day * 2.0, day * 1.0)], names=["_entity", "_day", "_hash", "a", "_label"]) for s in range(0, 500, 70)]
    blocks = list(trees.histogram_trees._entities(batches, model))
    both = trees.histogram_trees.Trees(["a", "shadow_a"], model.edges * 2, 1, 2, np.ones(2))
    sizes = []
    for x, _, _, n, chosen in trees.histogram_trees.shadowed(blocks, both, {0: None, 1: None}, [11, 12]):
        sizes.append(n)
        assert n % 100 == 0 and len(chosen) == 1 and (x[0] != x[1]).any()
        for s in range(0, n, 100):
            assert (np.sort(x[0, s : s + 100]) == np.sort(x[1, s : s + 100])).all()
    assert sum(sizes) == 1000
