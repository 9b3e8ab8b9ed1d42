"""Building blocks on small hand-made frames, and the queries against DuckDB."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from panelweave import core, registry
from panelweave.functions.scalars import parse_number
from panelweave.sources import files
from panelweave.streaming import events

D = dt.date
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_asof_join(spark):
    left = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 5)), ("b", D(2024, 1, 3)), ("c", D(2024, 1, 1))], "entity_id string, date date")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2024, 1, 5), 2.0), ("a", D(2024, 1, 9), 9.0), ("b", D(2024, 1, 4), 3.0)], "entity_id string, filed date, x double")
    got = {(r["entity_id"], r["date"]): (r["filed"], r["x"]) for r in core.asof_join(left, right, "entity_id", "date", "filed", ["x"]).collect()}
    assert got == {("a", D(2024, 1, 1)): (None, None), ("a", D(2024, 1, 5)): (D(2024, 1, 5), 2.0), ("b", D(2024, 1, 3)): (None, None), ("c", D(2024, 1, 1)): (None, None)}
    future = right.union(spark.createDataFrame([("a", D(2030, 1, 1), 7.0)], right.schema))
    again = {(r["entity_id"], r["date"]): (r["filed"], r["x"]) for r in core.asof_join(left, future, "entity_id", "date", "filed", ["x"]).collect()}
    assert again == got  # a later row never changes the past
    assert core.asof_join(left.limit(0), right, "entity_id", "date", "filed", ["x"]).count() == 0


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (None, 2.0), (1.0, 1e-12)], "a double, b double")
    got = [tuple(r) for r in df.select(*core.safe_ratio(F.col("a"), F.col("b"), "r")).collect()]
    assert got == [(0.5, 0, 0), (None, 1, 1), (None, 1, 1), (None, 1, 0), (None, 1, 1)]  # a null denominator is invalid too


def test_parse_number(spark):
    texts = ["1,234.5", "(12.50)", "-7", "$3", "—", "-", "", None, "12%", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_number(F.col("t"))).collect()]
    assert got == [1234.5, -12.5, -7.0, 3.0, None, None, None, None, 12.0, None]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "a.json"), "a int").collect()) == [1, 2]
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv"), "x int, y int", ";").collect()] == [(1, 2)]
    files.write_panel(spark.createDataFrame([(k, float(k)) for k in range(20)], "entity_id long, x double"), str(tmp_path / "p"), 4)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 20


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("bars", events.bars), ("sessions", events.sessions), ("rolling", events.rolling)):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, f(batch).collect()))


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    df, want = registry.queries()[name](spark, SF), duck.sql(registry.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_pagerank_sums_to_one(spark):
    assert abs(registry.queries()["graph03_pagerank"](spark, SF).agg(F.sum("rank")).first()[0] - 1) < 1e-9
