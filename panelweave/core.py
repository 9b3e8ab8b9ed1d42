"""Building blocks that the operators compose."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session did not set a path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def trailing(rows: int, *keys: str, order: str = "date") -> Window:
    """The last ``rows`` rows of each key, the current one included."""
    return Window.partitionBy(*(keys or ("entity_id",))).orderBy(order).rowsBetween(1 - rows, 0)


def ordered(*keys: str, order: str = "date") -> Window:
    return Window.partitionBy(*(keys or ("entity_id",))).orderBy(order)


def gated(agg: Column, x: Column, w: Window, least: int) -> Column:
    """``agg`` over the frame, null below ``least`` non-null observations of ``x``."""
    return F.when(F.count(x).over(w) >= least, agg.over(w))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c + F.lit(1e-9), digits)


def safe_ratio(num: Column, den: Column, name: str, epsilon: float = EPSILON) -> list[Column]:
    """num/den with two flags: no value, and a denominator that is null or too small to divide by."""
    missing = num.isNull() | den.isNull()
    invalid = den.isNull() | (F.abs(den) < epsilon)
    return [F.when(~missing & ~invalid, num / den).alias(name), (missing | invalid).cast("int").alias(f"is_missing_{name}"), invalid.cast("int").alias(f"invalid_math_{name}")]


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Iterable[str]) -> DataFrame:
    """The latest right row at or before each left row; nulls where there is none.

    Both sides are united and the last right row is carried forward in one
    ordered window, so there is one shuffle on the key and no range join. The
    right side must be unique by key and time.
    """
    values, own = list(values), [c for c in left.columns if c != key]
    carried = F.struct(F.col(right_time).alias("_at"), *values)
    a = left.select(key, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), *own, F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(key, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], carried.alias("_right"))
    w = Window.partitionBy(key).orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    united = a.unionByName(b).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    same = left.schema[left_time].dataType == united.schema["_time"].dataType  # then windows over the key's times need no shuffle and no sort
    return united.select(*[F.col("_time").alias(c) if c == left_time and same else c for c in left.columns], F.col("_right._at").alias(right_time), *[F.col(f"_right.{v}").alias(v) for v in values])


def islands(change: Column, *keys: str, order: str = "date") -> Column:
    """A running number of the runs that ``change`` starts."""
    return F.sum(change.cast("int")).over(Window.partitionBy(*(keys or ("entity_id",))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def forward_fill(c: str, *keys: str, order: str = "date") -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*(keys or ("entity_id",))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
