"""Models on streams and tables: the same values, across restarts; states that expire."""

import math

import pytest

from panelweave.functions.protocol import ChangeScore, LocalLevel, PidInterval, fold
from panelweave.streaming.keyed import STORE, keyed, values

SF = "/root/testdata/sf0.001"


def key_of(r, model):
    return (r["user_id"], r["ts"], r["event_id"], *[None if r[c] is None else round(r[c], 12) for c in ("predicted", *model.outputs)])


@pytest.mark.parametrize("model", [ChangeScore(), PidInterval(), LocalLevel()], ids=lambda m: type(m).__name__)
def test_stream_with_restart_equals_table(spark, tmp_path, model):
    """Three files in order of time; the query ends after two, and a new one goes on from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = values(spark.read.parquet(f"{SF}/events.parquet"))
    cuts = rows.approxQuantile("event_id", [0.3, 0.7], 0)
    pieces = [rows.where(f"event_id <= {cuts[0]}"), rows.where(f"event_id > {cuts[0]} AND event_id <= {cuts[1]}"), rows.where(f"event_id > {cuts[1]}")]
    source, sink, saved = (str(tmp_path / x) for x in ("in", "out", "saved"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = keyed(stream, "user_id", ["ts", "event_id"], model)
        q = found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", saved).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None

    for k, piece in enumerate(pieces):
        piece.coalesce(1).write.mode("append").parquet(source)
        if k:
            run()
    got = sorted((key_of(r, model) for r in spark.read.parquet(sink).collect()), key=str)
    want = sorted((key_of(r, model) for r in fold(rows, "user_id", ["ts", "event_id"], model).collect()), key=str)
    assert len(got) == rows.count() and got == want


def test_idle_keys_are_forgotten(spark, tmp_path):
    """After the watermark has passed a key by an hour, its state starts anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, ts timestamp, event_id long, value double"
    for batch in (
        ["(1, timestamp'2024-01-01 00:00:00', 1, 10.0D)", "(2, timestamp'2024-01-01 00:00:00', 2, 20.0D)"],
        ["(2, timestamp'2024-01-01 05:00:00', 3, 21.0D)"],
        ["(2, timestamp'2024-01-01 05:10:00', 4, 22.0D)"],
        ["(1, timestamp'2024-01-01 05:20:00', 5, 90.0D)", "(2, timestamp'2024-01-01 05:20:00', 6, 23.0D)"],
    ):
        spark.sql(f"SELECT * FROM VALUES {', '.join(batch)} AS t(user_id, ts, event_id, value)").selectExpr("CAST(user_id AS BIGINT) AS user_id", "ts", "CAST(event_id AS BIGINT) AS event_id", "value").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = keyed(stream, "user_id", ["ts", "event_id"], LocalLevel(), late="0 seconds", idle_ms=3_600_000)
        q = found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "saved")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    predicted = {r["event_id"]: r["predicted"] for r in spark.read.parquet(sink).collect()}
    assert predicted[5] is None and predicted[6] is not None and predicted[1] is None
    with pytest.raises(ValueError):
        keyed(stream, "user_id", ["ts"], LocalLevel(), idle_ms=1, ttl_ms=1)


def test_fold_keeps_keys_apart(spark):
    rows = [(None, 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, None), ("b", 1, 5.0), (None, 2, 3.0)]
    df = spark.createDataFrame(rows, "k string, t long, value double")
    got = {(r["k"], r["t"]): (r["predicted"], r["level"]) for r in fold(df, "k", ["t"], LocalLevel(0.0, 1.0)).collect()}
    assert got[None, 1] == (None, 1.0) and got["a", 2] == (None, None) and got["a", 3] == (None, 2.0) and got["a", 4] == (2.0, 2.0) and got["b", 1] == (None, 5.0)
    assert got[None, 2][0] == 1.0 and abs(got[None, 2][1] - 5 / 3) < 1e-12
    assert fold(df.limit(0), "k", ["t"], LocalLevel()).collect() == []


def test_interval_by_mode():
    """A crisis bucket is used once it is full, that of all crises and of all rows before."""
    model = PidInterval(least=3)
    history = [(100.0 + (k % 2), 0.0) for k in range(10)] + [(100.0 + 20 * (k % 2), 1.0) for k in range(6)]
    state = model.fit(history)
    buckets = model._buckets(state)
    assert [len(b) for b in buckets] == [9, 6, 0, 0, 0, 0, 6, 15]
    assert model._width(buckets, 0, 0.1, 100.0) == 1.0 and model._width(buckets, 1, 0.1, 100.0) == 20.0
    assert model._width(buckets, 2, 0.1, 100.0) == 20.0  # no row of mode 2: that of all crises
    assert PidInterval(least=99)._width(buckets, 1, 0.1, -50.0) == 5.0
    alphas = [model.said(model.fit(history[:n]))[0] for n in range(2, 17)]
    assert all(0.01 <= a <= 0.5 for a in alphas) and len(set(alphas)) > 5


def test_change_is_scored_high():
    model, state, scores = ChangeScore(0.05), ChangeScore(0.05).start(), []
    for k in range(300):
        state = model.update(state, ((math.sin(k * 12.9898) * 43758.5453) % 1 + (8.0 if k >= 200 else 0.0),))
        scores.append(model.said(state)[0])
    assert max(scores[200:225]) > 2 * max(map(abs, scores[100:200]))
    assert model.update(state, (None,)) == state
