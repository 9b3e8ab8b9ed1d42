"""Models that learn row by row, with their state in a stream's store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelweave.core import ship
from panelweave.functions.protocol import ChangeScore, LocalLevel, Model, PidInterval, fold, step
from panelweave.plans.views import table
from panelweave.registry import query

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keyed(StatefulProcessor):
    """Holds a model's state of each key as a value. With ``idle_ms`` a timer forgets keys that the watermark has left so far behind."""

    def __init__(self, model: Model, key: str, order: Sequence[str], time: str, idle_ms: int | None, ttl_ms: int | None) -> None:
        self.names = (key, *order, "predicted", *model.outputs)
        self.model, self.order, self.time, self.idle_ms, self.ttl_ms = model, order, time, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "numbers array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        rows = sorted(rows, key=lambda r: tuple(r[c] for c in self.order))
        state = list(self.state.get()[0]) if self.state.exists() else self.model.start()
        for r in rows:
            state, out = step(self.model, state, tuple(r[c] for c in self.model.inputs))
            yield Row(*self.names)(*key, *[r[c] for c in self.order], *[None if v is None else float(v) for v in out])
        self.state.update((state,))
        if self.idle_ms is not None and rows:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            last = max(int(r[self.time].timestamp() * 1000) for r in rows)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, key: str, order: Sequence[str], model: Model, time: str = "ts", late: str = "2 days", idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The key, the order columns, ``predicted`` and the model's outputs of every row of a stream.

    Rows of a micro-batch are taken in order; a row that comes with a later
    micro-batch is taken then. ``idle_ms`` forgets a key in event time,
    ``ttl_ms`` in processing time; one of them at most. The session's state
    store must be the RocksDB one (``STORE``).
    """
    if idle_ms is not None and ttl_ms is not None:
        raise ValueError("idle_ms needs event time, ttl_ms processing time")
    ship(stream.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    ddl = ", ".join([f"{c} {kinds[c]}" for c in (key, *order)] + ["predicted double", *[f"{o} double" for o in model.outputs]])
    rows = stream.withWatermark(time, late) if idle_ms is not None else stream
    mode = "ProcessingTime" if ttl_ms is not None else "EventTime" if idle_ms is not None else "None"
    return rows.groupBy(key).transformWithState(Keyed(model, key, order, time, idle_ms, ttl_ms), ddl, "Append", mode)


def values(events: DataFrame) -> DataFrame:
    """Events as what the models take: a value, and as mode whether the row before, by type, was an error."""
    return events.select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("mode"))


ROWS = "s AS MATERIALIZED (SELECT user_id, event_id, value AS x, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS mode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"
#: One discounted stage in SQL over rows (user_id, t, x) of ``{rows}``, t without gaps from 1.
STAGE = """(SELECT user_id, t, x AS last, x AS mean, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS var, NULL::DOUBLE AS loss FROM {rows} WHERE t = 1
 UNION ALL SELECT user_id, t, x, mean, c0, c1, var, 0.5 * (ln(2 * pi() * var) + error * error / var) FROM (
  SELECT user_id, t, x, mean, c0, c1, error, greatest(CASE WHEN t = 2 THEN (x - last) * (x - last) ELSE 0.99 * var + 0.01 * error * error END, 1e-12) AS var FROM (
   SELECT *, x - (mean + CASE WHEN c0 > 0 THEN c1 / c0 ELSE 0 END * (last - mean)) AS error FROM (
    SELECT n.user_id, n.t, n.x, b.last, b.var, m AS mean, 0.99 * b.c0 + 0.01 * (n.x - m) * (n.x - m) AS c0, 0.99 * b.c1 + 0.01 * (n.x - m) * (b.last - m) AS c1
    FROM {name} b JOIN (SELECT * FROM {rows}) n ON n.user_id = b.user_id AND n.t = b.t + 1, LATERAL (SELECT 0.99 * b.mean + 0.01 * n.x AS m)))))"""


#: The scores of rows ``s`` (user_id, t, x), smoothed after either stage, as ``late`` (user_id, t, score).
CHANGE = f"""one AS {STAGE.format(rows="s", name="one")},
 smooth AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t) AS t, x FROM (SELECT user_id, t, avg(loss) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x FROM one) WHERE t >= 8),
 two AS {STAGE.format(rows="smooth", name="two")},
 late AS (SELECT user_id, t + 7 AS t, avg(loss) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS score FROM two QUALIFY t >= 5)"""


@query("str07_online_change", f"WITH RECURSIVE {ROWS}, {CHANGE} SELECT s.user_id, s.event_id, round(coalesce(score, 0) + 1e-9, 5) AS score FROM s LEFT JOIN late USING (user_id, t)")
def str07(spark, sf_dir):
    """Each user's values scored against a discounted autoregression; ``keyed`` gives the same on a stream."""
    rows = fold(values(table(spark, sf_dir, "events")), "user_id", ["ts", "event_id"], ChangeScore())
    return rows.select("user_id", "event_id", F.round(F.col("score") + 1e-9, 5).alias("score"))



@query(
    "str08_online_conformal",
    f"""WITH RECURSIVE {ROWS},
    r AS (SELECT user_id, event_id, t, x, 0.1::DOUBLE AS alpha, 0.0::DOUBLE AS integral, 0.0::DOUBLE AS error, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::INT AS covered, []::DOUBLE[] AS normal, []::DOUBLE[] AS crisis, []::DOUBLE[] AS every FROM s WHERE t = 1
     UNION ALL SELECT user_id, event_id, t, x, greatest(0.01, least(0.5, alpha + 0.05 * e + 0.005 * i + 0.01 * (e - error))), i, e, last - width, last + width, hit,
      CASE WHEN mode = 0 THEN list_append(normal, abs(x - last)) ELSE normal END, CASE WHEN mode = 1 THEN list_append(crisis, abs(x - last)) ELSE crisis END, list_append(every, abs(x - last)) FROM (
      SELECT *, greatest(-3.0, least(3.0, integral + e)) AS i FROM (
       SELECT *, 1 - hit - 0.1 AS e FROM (
        SELECT *, CASE WHEN x BETWEEN last - width AND last + width THEN 1 ELSE 0 END AS hit FROM (
         SELECT *, CASE WHEN scores IS NULL THEN abs(last) * 0.1 ELSE list_extract(list_sort(scores), 1 + least(CAST(floor(least(1.0, ceil((len(scores) + 1) * (1 - alpha)) / len(scores)) * len(scores)) AS INT), len(scores) - 1)) END AS width FROM (
          SELECT n.user_id, n.event_id, n.t, n.x, n.mode, b.x AS last, b.alpha, b.integral, b.error, b.normal, b.crisis, b.every,
           CASE WHEN n.mode = 0 AND len(b.normal) >= 20 THEN b.normal WHEN n.mode = 1 AND len(b.crisis) >= 20 THEN b.crisis WHEN len(b.every) >= 20 THEN b.every END AS scores
          FROM r b JOIN (SELECT * FROM s) n ON n.user_id = b.user_id AND n.t = b.t + 1))))))
    SELECT user_id, event_id, round(alpha + 1e-9, 6) AS alpha, round(lower + 1e-9, 4) AS lower, round(upper + 1e-9, 4) AS upper, covered FROM r""",
)
def str08(spark, sf_dir):
    """Each user's interval for the next value, steered by whether the last ones held; ``keyed`` gives the same on a stream."""
    rows = fold(values(table(spark, sf_dir, "events")), "user_id", ["ts", "event_id"], PidInterval())
    return rows.select("user_id", "event_id", F.round(F.col("alpha") + 1e-9, 6).alias("alpha"), F.round(F.col("lower") + 1e-9, 4).alias("lower"), F.round(F.col("upper") + 1e-9, 4).alias("upper"), F.col("covered").cast("int").alias("covered"))


@query(
    "udf02_model_protocol",
    f"""WITH RECURSIVE {ROWS},
    r AS (SELECT user_id, event_id, t, NULL::DOUBLE AS predicted, x AS level, 0.1 * 0.11 / 0.21 AS variance FROM s WHERE t = 1
     UNION ALL SELECT n.user_id, n.event_id, n.t, b.level, b.level + (b.variance + 0.01) / (b.variance + 0.11) * (n.x - b.level), 0.1 * (b.variance + 0.01) / (b.variance + 0.11) FROM r b JOIN (SELECT * FROM s) n ON n.user_id = b.user_id AND n.t = b.t + 1)
    SELECT user_id, event_id, round(predicted + 1e-9, 5) AS predicted, round(level + 1e-9, 5) AS level, round(CAST(variance AS DOUBLE) + 1e-9, 6) AS variance FROM r""",
)
def udf02(spark, sf_dir):
    """A model behind the protocol, run on a table; its ``Keyed`` processor runs it on a stream."""
    rows = fold(values(table(spark, sf_dir, "events")), "user_id", ["ts", "event_id"], LocalLevel())
    return rows.select("user_id", "event_id", *[F.round(F.col(c) + 1e-9, d).alias(c) for c, d in (("predicted", 5), ("level", 5), ("variance", 6))])
