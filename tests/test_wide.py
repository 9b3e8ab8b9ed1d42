"""The wide panel has a column for every region and variable."""

from panelweave import registry
from panelweave.plans.views import peers

SF = "/root/testdata/sf0.001"


def test_every_region_and_variable(spark):
    wide = registry.queries()["agg02_groups_wide_all"](spark, SF)
    regions = {r[0].lower().replace(" ", "_") for r in peers(spark, SF).select("region").distinct().collect()}
    assert {f"{r}_{v}" for r in regions for v in ("open", "high", "low", "close", "volume")} <= set(wide.columns)
