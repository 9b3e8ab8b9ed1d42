"""Peers of a group by balance, without the square of its members."""

from pyspark.sql import functions as F

from panelweave import registry
from panelweave.sqlops import apply

registry.load()


def test_five_peers_of_large_groups(spark):
    rows = [(k, f"n{k % 3}", float(k * 7919 % 50)) for k in range(900)]
    peers = spark.createDataFrame(rows, "entity_id long, nation string, balance double")
    found = apply("top10_industry_peers", spark, peers=peers.withColumn("region", F.lit("R")))
    groups = {}
    for k, n, b in rows:
        groups.setdefault((n, k % 4), []).append((-b, k))
    want = {(k, p, at + 1) for (n, part), g in groups.items() for _, k in g for at, (_, p) in enumerate([x for x in sorted(g) if x[1] != k][:5])}
    assert {tuple(r) for r in found.select("entity_id", "peer", "place").collect()} == want
    text = found._jdf.queryExecution().optimizedPlan().toString()
    at = text.index("Join")
    assert "Window" not in text[:at]  # no window over the joined pairs


def test_matches_are_dealt_to_many_tasks(spark):
    """One block of names is compared by more than one task, and the best candidate is kept without sorting all pairs."""
    names = spark.createDataFrame([(100 * k, f"Customer#{k:09d}", 1, float(k - 20)) for k in range(60)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double").coalesce(1)
    found = apply("join20_holder_match", spark, customer=names)
    assert {(r["c_custkey"], r["other"]) for r in found.collect()} == {(100 * k, 100 * k) for k in range(60)}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    suppliers = spark.createDataFrame([(100, "Customer#000000007", 1, 5.0), (101, "x", 1, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    best = apply("join19_entity_resolution", spark, supplier=suppliers, customer=names)
    assert [(r["s_suppkey"], r["c_custkey"], round(r["score"], 3), r["accepted"]) for r in best.collect()] == [(100, 100, 83.333, 1)]  # 40 for the key, 30 * 17 / 18 for the name, 15 for the country
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" not in plan
