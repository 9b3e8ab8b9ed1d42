"""Tree ensembles on pooled panels, forecasts with a spread, and the choice of features by shadows and permutations.

Rows of all entities are fitted together, each scaled by its own trailing
deviation, so one distributed fit serves any number of entities. Features of a
day use that day and earlier ones; the label is the next day's return. Training
rows have labels up to the cut date, test rows lie after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.core import rounded, ship
from panelweave.operators import histogram_trees
from panelweave.plans.views import peers, prices
from panelweave.registry import query
from panelweave.sources.files import written

OWN = ("r0", "r1", "r2", "r4", "mean5", "mean21", "volume_move")
CROSS = (*OWN, "region0", "region5", "gap0")
LABEL, SHARE, SEED, TREES, ROUNDS, SHADOW_ROUNDS = "label", 0.8, 11, 20, 20, 5
Z = {"p10": -1.2815515655446004, "p50": 0.0, "p90": 1.2815515655446004}


def _trails(x: np.ndarray, place: np.ndarray, sizes: Sequence[int]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size, of every row's last so many rows in its key: how many have a value, their mean and sample deviation. Gaps are taken from the latest value, so equal values deviate by exactly 0."""
    ok = ~np.isnan(x)
    seen = np.maximum.accumulate(np.where(ok, np.arange(len(x)), 0))
    base, value = np.where(ok[seen], x[seen], 0), np.where(ok, x, 0)
    n, total, square, out = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x)), {}
    for lag in range(max(sizes)):
        if lag < len(x):
            use = ok[: len(x) - lag] & (place[lag:] >= lag)
            gap = (value[: len(x) - lag] - base[lag:]) * use
            n[lag:] += use
            total[lag:] += gap
            square[lag:] += gap * gap
        if lag + 1 in sizes:
            mean = np.where(n > 0, base + total / np.maximum(n, 1), np.nan)
            spread = np.maximum(square - total * total / np.maximum(n, 1), 0) / np.maximum(n - 1, 1)
            out[lag + 1] = n.copy(), mean, np.where(n > 1, np.sqrt(spread), np.nan)
    return out


def _own(rows: pa.Table) -> pa.RecordBatch:
    """The features of whole entities, in order of entity and date."""
    rows = rows.combine_chunks()
    keys, n = rows["entity_id"].combine_chunks(), rows.num_rows
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(np.append(True, _changes(keys)), at, 0))
    place, end = at - start, np.append(start[1:] != start[:-1], True)
    close, volume = (pc.fill_null(pc.cast(rows[c].combine_chunks(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in ("close", "volume"))

    def lag(x: np.ndarray, k: int) -> np.ndarray:
        return np.where(place >= k, np.roll(x, k), np.nan)

    with np.errstate(divide="ignore", invalid="ignore"):
        before = lag(close, 1)
        ret = np.where(before != 0, close / before - 1, np.nan)
        trails, mean_volume = _trails(ret, place, (5, 21, 63)), _trails(volume, place, (21,))[21][1]
        seen, _, scale = trails[63]
        scale = np.where(seen >= 20, scale, np.nan)
        unit = np.where(scale > 0, scale, np.nan)
        moved = np.where((volume > -1) & (mean_volume > -1), np.log1p(volume) - np.log1p(mean_volume), np.nan)
        found = {f"r{k}": lag(ret, k) / unit for k in (0, 1, 2, 4)} | {f"mean{k}": trails[k][1] / unit for k in (5, 21)} | {"volume_move": moved}
        found = {"scale": scale, **found, LABEL: np.where(end, np.nan, np.roll(ret, -1)) / unit}
    good = np.flatnonzero(scale > 0)
    follows = np.zeros(n, np.int64)
    follows[good[:-1]] = good[1:]
    none = start[follows] != start
    none[follows == 0] = True
    dates = rows["date"].combine_chunks()
    columns = [keys, dates, rows["region"].combine_chunks(), *[pa.array(v, pa.float64(), from_pandas=True) for v in found.values()], dates.take(pa.array(follows, pa.int64(), mask=none))]
    return pa.RecordBatch.from_arrays(columns, names=["entity_id", "date", "region", *found, "label_date"])


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a key isn't the one before it; null is a key."""
    void = keys.is_null().to_numpy(zero_copy_only=False)
    other = pc.not_equal(keys[1:], keys[:-1])
    return np.where(void[1:] | void[:-1], void[1:] != void[:-1], pc.fill_null(other, False).to_numpy(zero_copy_only=False))


def _by_entity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by entity and date; held are those of the entity that isn't over yet."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index("entity_id"))
        last = np.flatnonzero(_changes(keys))
        cut = int(last[-1]) + 1 if len(last) else 0 if held and keys[0].as_py() != key else None
        if cut is not None:
            if whole := [*held, *([batch.slice(0, cut)] if cut else [])]:
                yield _own(pa.Table.from_batches(whole))
            held, batch = [], batch.slice(cut)
        held.append(batch)
        key = keys[-1].as_py()
    if held:
        yield _own(pa.Table.from_batches(held))


def features(df: DataFrame) -> DataFrame:
    """entity_id, date, region, scale, features and label, in units of ``scale``, the deviation of the last 63 returns (20 at least); rows without a feature are left out.

    An entity's rows, one a day, are in one task; they are written once, and so are the means of regions by day.
    """
    ship(df.sparkSession)
    rows = df.select("entity_id", "date", "region", "close", "volume").repartition("entity_id").sortWithinPartitions("entity_id", "date")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("entity_id", "date", "region"))
    values = ", ".join(f"{c} double" for c in ("scale", *OWN, LABEL))
    rows = written(rows.mapInArrow(_by_entity, f"{keys}, {values}, label_date {rows.schema['date'].dataType.simpleString()}"), "features")
    day = rows.groupBy("region", "date").agg(F.avg("r0").alias("region0")).withColumn("region5", F.avg("region0").over(Window.partitionBy("region").orderBy("date").rowsBetween(-4, 0)))
    rows = rows.where("scale > 0").join(F.broadcast(written(day, "days")), ["region", "date"], "left").withColumn("gap0", F.col("r0") - F.col("region0"))
    return rows.select("entity_id", "date", "region", "scale", *CROSS, LABEL, "label_date").dropna(subset=list(CROSS))


def parts(df: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Rows whose label is known by the cut date, and rows after it; the cut is the date up to which ``share`` of the rows lie."""
    cut = df.select(F.percentile_approx(F.datediff("date", F.lit("1970-01-01")), share, 10_000)).first()[0]
    day = F.date_add(F.lit("1970-01-01"), 0 if cut is None else cut)
    known = df.where(F.col(LABEL).isNotNull())
    return known.where(F.col("label_date") <= day), df.where(F.col("date") > day)


def forest(train: DataFrame | histogram_trees.Binned, columns: Sequence[str], label: str = LABEL, seed: int = SEED) -> histogram_trees.Trees:
    return histogram_trees.forest(binned(train, columns, label), seed, TREES, depth=6, least=10, rate=0.7)


def boosted(train: DataFrame | histogram_trees.Binned, columns: Sequence[str], label: str = LABEL, seed: int = SEED) -> histogram_trees.Trees:
    return histogram_trees.boosted(binned(train, columns, label), seed, ROUNDS, depth=4, least=20, rate=0.7, step=0.1)


def binned(train: DataFrame | histogram_trees.Binned, columns: Sequence[str], label: str) -> histogram_trees.Binned:
    return train if isinstance(train, histogram_trees.Binned) else histogram_trees.Binned(train, columns, label)


def predicted(model: histogram_trees.Trees, df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    return histogram_trees.predicted(model, df, {name: columns})


def ensemble(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """``test`` with ``forest``, ``boosted`` and their mean, ``predicted``."""
    data = binned(train, columns, label)
    out = predicted(boosted(data, columns, label), predicted(forest(data, columns, label), test, columns, "forest"), columns, "boosted")
    return out.withColumn("predicted", (F.col("forest") + F.col("boosted")) / 2)


def spread(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """``test`` with ``predicted``, ``sigma`` and percentiles of a normal forecast.

    The mean is fitted on the earlier four fifths of the training rows, the log
    of the squared errors on the rest, which the first model hasn't seen. With
    normal errors the mean log square is 1.27 below the log variance.
    """
    early, late = parts(train)
    late = late.where(F.col(label).isNotNull())
    mean = forest(early, columns, label)
    errors = predicted(mean, late, columns, "predicted").withColumn("_e", F.log(F.pow(F.col(label) - F.col("predicted"), 2) + 1e-6))
    variance = forest(errors, columns, "_e", SEED + 1)
    out = predicted(variance, predicted(mean, test, columns, "predicted"), columns, "_v").withColumn("sigma", F.exp((F.col("_v") + 1.2703628454614782) / 2)).drop("_v")
    return out.withColumns({n: F.col("predicted") + z * F.col("sigma") for n, z in Z.items()})


def packed(df: DataFrame) -> DataFrame:
    """A row for each entity with its rows in order of date; as many as there are days."""
    return df.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("date", *[c for c in df.columns if c not in ("entity_id", "date")]))).alias("_rows"))


def dealt(series: DataFrame, columns: Sequence[str], seed: int, prefix: str = "shadow_") -> DataFrame:
    """The rows of ``packed`` entities, each column's values dealt anew among them: the rows in order of date take them in order of a hash."""
    twins = F.sort_array(F.transform("_rows", lambda r: F.struct(F.xxhash64(r["date"], F.lit(seed)).alias("hash"), r["date"].alias("date"), *[r[c].alias(c) for c in columns])))
    pairs = series.select("entity_id", F.explode(F.arrays_zip(F.col("_rows").alias("row"), twins.alias("twin"))).alias("_pair"))
    return pairs.select("entity_id", "_pair.row.*", *[F.col(f"_pair.twin.{c}").alias(f"{prefix}{c}") for c in columns])


def permuted(df: DataFrame, columns: Sequence[str], seed: int, prefix: str = "shadow_") -> DataFrame:
    """``df`` with each column's values dealt anew among the rows of their entity, by one shuffle."""
    return dealt(packed(df), columns, seed, prefix).select(*df.columns, *[f"{prefix}{c}" for c in columns])


def shadow_test(df: DataFrame, columns: Sequence[str], label: str = LABEL, rounds: int = SHADOW_ROUNDS) -> list[tuple[str, int, float, str]]:
    """Per feature: in how many rounds a forest gave it more weight than every shuffled copy, its mean weight, and the verdict.

    Confirmed with wins in all rounds, rejected with wins in less than half.
    Entities' series are written once, and the forests of all rounds grow in
    the same passes, which deal the shadows anew in memory.
    """
    series = written(packed(df.select("entity_id", "date", label, *columns)), "series").select(F.col("entity_id").alias("_entity"), "_rows")
    wins, weight = dict.fromkeys(columns, 0), dict.fromkeys(columns, 0.0)
    for found in histogram_trees.shadow_forests(series, columns, label, [SEED + k for k in range(rounds)], TREES, depth=6, least=10, rate=0.7):
        best = max(found[len(columns) :])
        for c, v in zip(columns, found):
            wins[c] += int(v > best)
            weight[c] += float(v) / rounds
    return [(c, wins[c], weight[c], "confirmed" if wins[c] == rounds else "tentative" if 2 * wins[c] >= rounds else "rejected") for c in columns]


def permutation_importance(model, df: DataFrame, columns: Sequence[str], label: str = LABEL, group: str | None = None) -> DataFrame:
    """Per feature (and ``group``) how much the mean squared error rises when the feature is dealt anew within entities; one pass scores them all."""
    by = [group] if group else []
    rows = permuted(df.where(F.col(label).isNotNull()).select("entity_id", "date", *by, label, *columns), columns, SEED)
    mixes = {f"_mixed_{c}": [f"shadow_{x}" if x == c else x for x in columns] for c in columns}
    scored = histogram_trees.predicted(model, rows, {"_whole": columns, **mixes})
    error = lambda p: F.avg(F.pow(F.col(p) - F.col(label), 2))
    each = [F.struct(F.lit(c).alias("feature"), F.count("*").alias("n"), (error(f"_mixed_{c}") - error("_whole")).alias("rise"), F.avg(F.abs(F.col(f"_mixed_{c}") - F.col("_whole"))).alias("sensitivity")) for c in columns]
    return scored.groupBy(*by).agg(F.array(*each).alias("_each")).select(*by, F.explode("_each").alias("_one")).select(*by, "_one.*")


def panel(spark, sf_dir) -> DataFrame:
    """The features of the price panel."""
    return features(prices(spark, sf_dir).join(peers(spark, sf_dir).select("entity_id", "region"), "entity_id"))


def judged(found: DataFrame) -> DataFrame:
    """A day's forecast as a return, with the naive error of no change."""
    real = F.col("scale") * F.col(LABEL)
    return found.select("entity_id", "date", rounded(F.col("predicted") * F.col("scale")).alias("predicted"), rounded(real - F.col("predicted") * F.col("scale")).alias("error"), rounded(real).alias("naive_error"))


@query("fc11_tree_ensemble")
def fc11(spark, sf_dir):
    return judged(ensemble(*parts(panel(spark, sf_dir)), OWN))


@query("fc12_global_model")
def fc12(spark, sf_dir):
    """With what the region's other entities did."""
    return judged(ensemble(*parts(panel(spark, sf_dir)), CROSS))


@query("fc13_distributional_forecast")
def fc13(spark, sf_dir):
    found = spread(*parts(panel(spark, sf_dir)), OWN)
    return found.select("entity_id", "date", *[rounded(F.col(c) * F.col("scale")).alias(c) for c in ("predicted", "sigma", "p10", "p90")])


@query("fc29_shadow_features")
def fc29(spark, sf_dir):
    train, _ = parts(panel(spark, sf_dir))
    return spark.createDataFrame(shadow_test(train, CROSS), "feature string, wins int, weight double, verdict string")


@query("fc30_regional_importance")
def fc30(spark, sf_dir):
    """By region, as that is the regime column at hand."""
    train, test = parts(panel(spark, sf_dir))
    return permutation_importance(forest(train, CROSS), test, CROSS, group="region").select("region", "feature", "n", rounded(F.col("rise")).alias("rise"))


@query("fc31_permutation_sensitivity")
def fc31(spark, sf_dir):
    train, test = parts(panel(spark, sf_dir))
    found = permutation_importance(forest(train, CROSS), test, CROSS)
    return found.select("feature", "n", rounded(F.col("rise")).alias("rise"), rounded(F.col("sensitivity")).alias("sensitivity"))


@query("fc78_feature_selection")
def fc78(spark, sf_dir):
    """Shadow verdicts and permutation rises together; kept is what either supports."""
    train, test = parts(panel(spark, sf_dir))
    verdicts = spark.createDataFrame(shadow_test(train, CROSS), "feature string, wins int, weight double, verdict string")
    rises = permutation_importance(forest(train, CROSS), test, CROSS).select("feature", rounded(F.col("rise")).alias("rise"))
    return verdicts.join(rises, "feature").withColumn("kept", (F.col("verdict") == "confirmed") | (F.col("rise") > 0))
