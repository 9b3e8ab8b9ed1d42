"""Year by year comparisons against the queries of one year, and all years of the table."""

import pytest
from pyspark.sql import functions as F

from panelweave import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agg12_net_new_revenue", "set04_new_and_gone"])
def test_every_year(spark, name):
    by_year = registry.queries()[f"{name}_by_year"](spark, SF).cache()
    years = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select(F.year("l_shipdate")).distinct().collect()}
    assert {r[0] for r in by_year.select("year").distinct().collect()} == years - {min(years)}
    one = registry.queries()[name](spark, SF)
    assert sorted(map(tuple, by_year.where("year = 1998").drop("year").collect())) == sorted(map(tuple, one.collect()))
