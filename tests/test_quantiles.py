"""Exact quantiles of a whole column against numpy."""

import numpy as np
import pytest

from panelweave import registry
from panelweave.operators.estimation import quantiles

SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)


@pytest.mark.parametrize("edge", [2e-4, 0.0])
def test_quantiles(spark, edge):
    """Distinct values, many ties, two rows, none; bounds that are too narrow are widened."""
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=30_002), rng.integers(0, 4, 5000).astype(float), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        assert np.allclose(quantiles(df, "x", SHARES, edge or 1e-9), np.quantile(values, SHARES), rtol=1e-12)
    assert quantiles(df.where("x IS NULL"), "x", SHARES) == [None] * 5


def test_tier_scores_hold_no_whole_column(spark):
    plan = registry.queries()["dq51_proxy_tier_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "Join" not in plan
