"""Tree forecasts, shadows and permutations on a panel with a planted signal."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import trees

COLUMNS = ("a", "b", "noise1", "noise2")


@pytest.fixture(scope="module")
def planted(spark):
    """The label follows a (and |b|) of the same row; its spread grows with b."""
    rng = np.random.default_rng(1)
    rows = []
    for e in range(8):
        for t in range(250):
            a, b, n1, n2 = map(float, rng.normal(size=4))
            day = dt.date(2024, 1, 1) + dt.timedelta(t)
            rows.append((e, day, day + dt.timedelta(1), a, b, n1, n2, 2 * a + abs(b) + float(rng.normal()) * (0.2 + (b > 0))))
    return spark.createDataFrame(rows, "entity_id long, date date, label_date date, a double, b double, noise1 double, noise2 double, label double").cache()


def rmse(df, c):
    return df.select(F.sqrt(F.avg(F.pow(F.col("label") - F.col(c), 2)))).first()[0]


def test_ensemble_beats_the_naive_forecast(planted):
    train, test = trees.parts(planted)
    assert train.agg(F.max("label_date")).first()[0] <= test.agg(F.min("date")).first()[0]
    found = trees.ensemble(train, test, COLUMNS).withColumn("zero", F.lit(0.0)).cache()
    assert rmse(found, "predicted") < 0.6 * rmse(found, "zero") and found.count() == test.count()


def test_spread_follows_the_errors(planted):
    train, test = trees.parts(planted)
    found = trees.spread(train, test, COLUMNS).cache()
    wide, narrow = (found.where(c).agg(F.avg("sigma")).first()[0] for c in ("b > 0.3", "b < -0.3"))
    assert wide > 1.3 * narrow
    assert 0.6 < found.agg(F.avg((F.col("label").between(F.col("p10"), F.col("p90"))).cast("double"))).first()[0] <= 0.97
    assert found.where("NOT (p10 <= p50 AND p50 <= p90)").count() == 0


def test_shadows_reject_noise(planted):
    verdict = {c: v for c, _, _, v in trees.shadow_test(planted, COLUMNS, rounds=3)}
    assert verdict["a"] == "confirmed" and verdict["b"] == "confirmed"
    assert verdict["noise1"] != "confirmed" and verdict["noise2"] != "confirmed"


def test_permutations(planted):
    rows = trees.permuted(planted, COLUMNS, 5).cache()
    assert rows.count() == planted.count()
    for c in COLUMNS:  # the same values within each entity, in another order
        moved = rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(c)).alias("x"), F.sort_array(F.collect_list(f"shadow_{c}")).alias("y"))
        assert moved.where("x <> y").count() == 0
    assert abs(rows.agg(F.corr("a", "shadow_a")).first()[0]) < 0.1
    assert sorted(map(str, rows.collect())) == sorted(map(str, trees.permuted(planted.repartition(7), COLUMNS, 5).collect()))
    train, test = trees.parts(planted)
    rise = {r["feature"]: r["rise"] for r in trees.permutation_importance(trees.forest(train, COLUMNS), test, COLUMNS).collect()}
    assert rise["a"] > 10 * max(abs(rise["noise1"]), abs(rise["noise2"])) and rise["a"] > rise["b"] > 0


def test_features_never_look_ahead(spark):
    rng = np.random.default_rng(2)
    rows = [(e, dt.date(2024, 1, 1) + dt.timedelta(t), "R", 100.0 + float(rng.random()), float(rng.integers(1, 99))) for e in range(3) for t in range(60)]
    schema = "entity_id long, date date, region string, close double, volume double"
    early = [r for r in rows if r[1] < dt.date(2024, 2, 10)]
    of = lambda part: {(r["entity_id"], r["date"]): tuple(r[c] for c in trees.CROSS) for r in trees.features(spark.createDataFrame(part, schema)).collect()}
    whole, before = of(rows), of(early)
    assert before and all(np.allclose(whole[k], v) for k, v in before.items())


def test_dealing_anew_takes_one_shuffle(spark, planted):
    """Shadows come without a join, rounds from series that are written once, and one pass scores all features."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(trees.permuted(planted, COLUMNS, 5)).count("Exchange hashpartitioning") == 1
    model = trees.forest(planted, COLUMNS)
    assert plan(trees.permutation_importance(model, planted, COLUMNS)).count("Exchange hashpartitioning") == 1
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    trees.shadow_test(planted.mapInArrow(look, planted.schema), COLUMNS, rounds=2)
    assert seen.value == planted.count()


def test_features_are_the_windows(spark):
    """Against Spark's own windows, with gaps, a run without movement and keys that batches cut."""
    from pyspark.sql import Window

    rng, rows = np.random.default_rng(3), []
    for e in (4, 1, 9):
        for t in range(40 if e == 9 else 150):
            close = 100.0 if e == 1 and 30 < t < 100 else 100.0 + float(rng.random())
            rows.append((e, dt.date(2024, 1, 1) + dt.timedelta(t), "RS"[t % 2], None if (e, t) == (4, 60) else close, float(rng.integers(1, 99))))
    df = spark.createDataFrame(rows, "entity_id long, date date, region string, close double, volume double")
    w, last = Window.partitionBy("entity_id").orderBy("date"), lambda k: Window.partitionBy("entity_id").orderBy("date").rowsBetween(1 - k, 0)
    want = df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    want = want.withColumn("scale", F.when(F.count("ret").over(last(63)) >= 20, F.stddev_samp("ret").over(last(63)))).withColumn("next", F.lead("ret").over(w))
    unit = F.when(F.col("scale") > 0, F.col("scale"))
    want = want.withColumns({f"r{k}": F.lag("ret", k).over(w) / unit for k in (0, 1, 2, 4)} | {f"mean{k}": F.avg("ret").over(last(k)) / unit for k in (5, 21)} | {"volume_move": F.log1p("volume") - F.log1p(F.avg("volume").over(last(21))), "label": F.col("next") / unit})
    day = want.groupBy("region", "date").agg(F.avg("r0").alias("region0")).withColumn("region5", F.avg("region0").over(Window.partitionBy("region").orderBy("date").rowsBetween(-4, 0)))
    want = want.join(day, ["region", "date"], "left").withColumn("gap0", F.col("r0") - F.col("region0"))
    want = want.where("scale > 0").withColumn("label_date", F.lead("date").over(w)).dropna(subset=list(trees.CROSS))
    columns, size = ("scale", *trees.CROSS, "label"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, 37)
    try:
        got = {(r["entity_id"], r["date"]): r for r in trees.features(df).collect()}
    finally:
        spark.conf.set(size, was)
    want = {(r["entity_id"], r["date"]): r for r in want.collect()}
    assert got.keys() == want.keys() and len(want) > 150
    for k, r in want.items():
        assert got[k]["label_date"] == r["label_date"] and got[k]["region"] == r["region"]
        assert np.allclose(*([np.nan if x[c] is None else x[c] for c in columns] for x in (got[k], r)), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_a_fit_is_the_same_however_rows_lie(planted, monkeypatch):
    """Given exact edges; and it reads the training rows twice, for the edges and for the blocks, whatever the number of trees."""
    monkeypatch.setattr(trees.histogram_trees, "ACCURACY", 100_000)
    seen = planted.sparkSession.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    train, test = trees.parts(planted)
    n, out = train.count(), []
    for k in (1, 7):
        rows = train.repartition(k).mapInArrow(look, train.schema)
        out.append([r[0] for r in trees.ensemble(rows, test, COLUMNS).orderBy("entity_id", "date").select("predicted").collect()])
    assert np.allclose(*out, atol=1e-9) and seen.value == 4 * n


def test_a_single_tree_is_the_best_one(spark):
    """Every split against all cuts of all columns, by plain sums."""
    from panelweave.operators import histogram_trees as h

    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 2)).astype(float)
    y = np.where(x[:, 0] > 2, x[:, 1], -x[:, 1]) + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, label double").repartition(3)
    model = h.boosted(h.Binned(df, ["a", "b"], "label"), 1, 1, 2, 5, 1.0, 0.1)

    def plain(rows, depth):
        best = None
        for f in (0, 1):
            for c in range(5):
                left = x[rows, f] <= c
                if min(left.sum(), (~left).sum()) >= 5:
                    loss = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (rows[left], rows[~left]))
                    best = min(best or (np.inf,), (loss, f, c))
        if not depth or best is None:
            return {int(i): y[rows].mean() for i in rows}
        left = x[rows, best[1]] <= best[2]
        return plain(rows[left], depth - 1) | plain(rows[~left], depth - 1)

    want = plain(np.arange(300), 2)
    assert np.allclose(model.predict(model.binned(x)), [want[i] for i in range(300)])
