"""Event-time operators, each usable on a stream and on a table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.core import rounded
from panelweave.plans.views import table
from panelweave.registry import query


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def bars(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling bars per user on event time; rows later than ``late`` are dropped on a stream."""
    e = timed(events, late)
    at = F.struct("ts", "event_id")
    return e.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    e = timed(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def rolling(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "8 days") -> DataFrame:
    e = timed(events, late)
    return e.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), rounded(F.avg("value"), 4).alias("mean")).select("event_type", F.col("w.start").alias("start"), "n", "mean")


@query("str01_bars", "SELECT user_id, date_trunc('day', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def str01(spark, sf_dir):
    return bars(table(spark, sf_dir, "events"))


@query("str03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def str03(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


@query("str02_rolling", "WITH w AS (SELECT event_type, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start FROM events) SELECT event_type, start, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM w GROUP BY 1, 2")
def str02(spark, sf_dir):
    return rolling(table(spark, sf_dir, "events"))


def first_of_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """One row per user, kind and day: on a stream the first that comes within the watermark, on a table the earliest."""
    e = timed(events, late).select("user_id", "event_type", F.to_date("ts").alias("date"), "ts")
    if events.isStreaming:
        return e.dropDuplicatesWithinWatermark(["user_id", "event_type", "date"])
    return e.groupBy("user_id", "event_type", "date").agg(F.min("ts").alias("ts"))


@query("str04_late_duplicates", "SELECT user_id, event_type, CAST(ts AS DATE) AS date, min(ts) AS ts FROM events GROUP BY 1, 2, 3")
def str04(spark, sf_dir):
    return first_of_day(table(spark, sf_dir, "events"))


def enriched(events: DataFrame, known: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event with what was known then: ``known`` is static, with the time since which and until which each row holds."""
    return timed(events, late).join(known, (events["user_id"] == known["key"]) & (events["ts"] >= known["since"]) & (known["until"].isNull() | (events["ts"] < known["until"])))


@query("str05_static_asof", "WITH p AS (SELECT user_id, ts AS since, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, value AS known FROM events WHERE event_type = 'purchase') SELECT e.event_id, p.event_id AS purchase_id, p.known FROM events e JOIN p ON e.user_id = p.user_id AND e.ts >= p.since AND (p.until IS NULL OR e.ts < p.until) WHERE e.event_type <> 'purchase'")
def str05(spark, sf_dir):
    """Events and the user's latest purchase before them."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    known = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("since"), F.lead("ts").over(w).alias("until"), F.col("event_id").alias("purchase_id"), F.col("value").alias("known"))
    return enriched(e.where("event_type <> 'purchase'"), known).select("event_id", "purchase_id", "known")


def followed(left: DataFrame, right: DataFrame, within: str, late: str = "2 days") -> DataFrame:
    """Pairs of a left row and a right one of the same user at most ``within`` later; on streams both sides have a watermark."""
    a = timed(left, late).select(F.col("user_id"), F.col("ts").alias("at"), F.col("event_id").alias("first_id"))
    b = timed(right, late).select(F.col("user_id").alias("other"), F.col("ts").alias("then"), F.col("event_id").alias("second_id"))
    return a.join(b, F.expr(f"user_id = other AND then >= at AND then <= at + interval {within}"))


@query("str06_stream_stream_join", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def str06(spark, sf_dir):
    """Clicks and the purchases of the next six hours."""
    e = table(spark, sf_dir, "events")
    return followed(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "6 hours").select("user_id", "first_id", "second_id")


@query("str09_status_changes", "SELECT event_id, user_id, before, event_type AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND before <> event_type")
def str09(spark, sf_dir):
    """Rows whose status differs from the user's previous one; as a function of a micro-batch it serves ``foreachBatch``."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).where("before <> event_type").select("event_id", "user_id", "before", F.col("event_type").alias("status"))
