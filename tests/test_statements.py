"""Statement operators on small hand-made frames, with values worked out by hand."""

import datetime as dt

from panelweave import registry, sqlops
from panelweave.plans.statements import FIELDS

D = dt.date
TYPES = {"entity_id": "long", "report_date": "date", "filing_date": "date"}
SCHEMA = ", ".join(f"{x} {TYPES.get(x, 'double')}" for x in FIELDS)
registry.load()


def fin(spark, *rows):
    """Rows with all fields null but those that are given."""
    made = []
    for k, r in enumerate(rows):
        own = {"entity_id": 1, "report_date": D(2020, 3 * (k % 4) + 3, 28), "filing_date": D(2020, 12, 31), **r}
        made.append(tuple(own.get(x) for x in FIELDS))
    return spark.createDataFrame(made, SCHEMA)


def run(spark, name, **frames):
    return [r.asDict() for r in sqlops.apply(name, spark, **frames).collect()]


def test_ratio_flags(spark):
    """A null, zero or tiny denominator is invalid and gives no value; a null numerator is only missing."""
    rows = run(spark, "win19_liquidity", fin=fin(spark, {"current_assets": 3.0, "current_liabilities": 2.0, "cash_and_equivalents": 1.0}, {"current_assets": 3.0}, {"current_assets": 3.0, "current_liabilities": 0.0}, {"current_liabilities": 2.0}))
    got = [(r["current_ratio"], r["is_missing_current_ratio"], r["invalid_math_current_ratio"]) for r in rows]
    assert [(None if x is None else round(x, 6), m, i) for x, m, i in got] == [(1.5, 0, 0), (None, 1, 1), (None, 1, 1), (None, 1, 0)]
    assert rows[0]["quick_ratio"] == 0.5 and rows[3]["is_missing_quick_ratio"] == 1


def test_solvency(spark):
    rows = run(spark, "win18_solvency", fin=fin(spark, {"short_term_debt": 10.0, "long_term_debt": 30.0, "total_equity": -20.0, "cash_and_equivalents": 5.0, "ebitda": 2.5}, {"total_equity": 4.0}))
    a, b = rows
    assert (a["total_debt_asof"], a["net_debt"], a["debt_to_equity_signed"], a["debt_to_equity_abs"], a["net_debt_to_ebitda"]) == (40.0, 35.0, -2.0, 2.0, 3.5)
    assert (b["total_debt_asof"], b["is_missing_total_debt_asof"], b["is_missing_net_debt"], b["debt_to_equity_abs"]) == (0.0, 1, 1, 0.0)


def test_margin_plausibility(spark):
    rows = run(spark, "proj08_margin_plausibility", fin=fin(spark, {"revenue": 100.0, "gross_profit": 160.0, "ebit": -120.0, "net_income": 50.0}))
    assert (rows[0]["gross_margin"], rows[0]["invalid_math_gross_margin"], rows[0]["operating_margin"], round(rows[0]["net_margin"], 6), rows[0]["invalid_math_net_margin"]) == (None, 1, None, 0.5, 0)


def test_identities_cascade(spark):
    """Gross profit is filled from the other two, then nothing observed is changed."""
    base = {"revenue": 10.0, "cost_of_revenue": 6.0, "gross_profit": 4.0, "total_assets": 9.0, "total_liabilities": 5.0, "total_equity": 4.0, "operating_cash_flow": 3.0, "capex": -1.0}
    for entity in range(12):
        for r in run(spark, "dq14_identity_fill_all", fin=fin(spark, *[{**base, "entity_id": entity}] * 2)):
            assert {k: round(v, 3) for k, v in r.items() if k in base and v is not None}.items() <= {k: v for k, v in base.items()}.items()
            assert r["total_equity"] is not None and r["total_assets"] is not None


def test_piotroski(spark):
    """All nine signals get better: 9; all get worse or stay bad: the dilution signal alone."""
    worse = {"net_income": -1.0, "operating_cash_flow": -2.0, "total_assets": 100.0, "short_term_debt": 30.0, "long_term_debt": 10.0, "current_assets": 10.0, "current_liabilities": 10.0, "total_equity": 50.0, "gross_profit": 20.0, "revenue": 80.0}
    better = {"net_income": 5.0, "operating_cash_flow": 8.0, "total_assets": 100.0, "short_term_debt": 10.0, "long_term_debt": 10.0, "current_assets": 20.0, "current_liabilities": 10.0, "total_equity": 60.0, "gross_profit": 40.0, "revenue": 90.0}
    last = lambda a, b: max(run(spark, "anal40_piotroski_f", fin=fin(spark, a, b)), key=lambda r: r["report_date"])
    assert (last(worse, better)["score"], last(worse, better)["label"], last(worse, better)["n_available"]) == (9, "strong", 9)
    assert (last(better, {**worse, "total_equity": 60.0})["score"], last(better, {**worse, "total_equity": 60.0})["label"]) == (1, "weak")


def test_runway_and_empty(spark):
    got = run(spark, "anal34_liquidity_runway", fin=fin(spark, {"cash_and_equivalents": 60.0, "operating_cash_flow": -15.0, "capex": -1.0}))
    assert (got[0]["monthly_burn"], got[0]["months"], got[0]["verdict"]) == (5.0, 12.0, "tight")
    for name in ("win18_solvency", "anal33_beneish_m", "anal40_piotroski_f", "dq16_estimation_columns", "anal55_dechow_f"):
        assert run(spark, name, fin=fin(spark)) == []


def test_beneish_needs_four_indices(spark):
    got = run(spark, "anal33_beneish_m", fin=fin(spark, {"revenue": 100.0}, {"revenue": 120.0}))
    assert got[0]["m_score"] is None and got[0]["verdict"] is None and got[0]["n_available"] == 1


def test_filing_gap_rounds_to_the_even_day(spark):
    """Gaps of 91 and 92 days have the median 91.5, which is 92; 90 and 91 give 90."""
    days = lambda entity, *gaps: [{"entity_id": entity, "filing_date": D(2000, 1, 1) + dt.timedelta(days=sum(gaps[:k]))} for k in range(len(gaps) + 1)]
    got = {r["entity_id"]: r["gap_days"] for r in run(spark, "scal13_expected_next_filing", fin=fin(spark, *days(1, 91, 92), *days(2, 90, 91)))}
    assert got == {1: 92, 2: 90}


def test_causal_edges_of_constant_signs(spark):
    """A region whose mean return never changes sign has no correlation of signs; the number is NaN, as in DuckDB, and no error."""
    rows = [(e, D(2020, 1, k + 1), p) for e, q in ((1, (1.0, 2.0, 3.0, 5.0)), (2, (1.0, 3.0, 4.0, 9.0))) for k, p in enumerate(q)]
    px = spark.createDataFrame(rows, "entity_id long, date date, close double")
    peers = spark.createDataFrame([(1, "n", "A"), (2, "n", "B")], "entity_id long, nation string, region string")
    assert {(r["src"], r["dst"]): r["method"] for r in run(spark, "set02_causal_edges", px=px, peers=peers)} == {("A", "B"): "both", ("B", "A"): "both"}
