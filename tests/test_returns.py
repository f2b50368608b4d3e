from __future__ import annotations

import math
import statistics

import pytest

from panelquant.operators.returns import (cumulative_returns, generate_returns_from_weights,
                                          performance_summary)
from panelquant.plans import diagnostics as diag
from tests.conftest import day

DAYS = ["2023-01-02", "2023-01-03", "2023-01-04", "2023-01-05"]
RETURNS = {"A": [.01, .02, -.03, .04], "B": [None, .05, .01, -.02]}
CAPS = {"A": 10.0, "B": 30.0}


@pytest.fixture
def panel(spark):
    rows = [(day(d), b, r, CAPS[b]) for b, rs in RETURNS.items() for d, r in zip(DAYS, rs)]
    return spark.createDataFrame(
        rows, "date date, barrid string, `return` double, market_cap double")


@pytest.fixture
def weights(spark):
    rows = [(day(d), b, w) for d in DAYS for b, w in (("A", .25), ("B", .75))]
    return spark.createDataFrame(rows, "date date, barrid string, weight double")


def test_weights_earn_the_next_return(panel, weights):
    got = generate_returns_from_weights(weights, panel, portfolio="p").orderBy("date").collect()
    assert got[0].asDict().keys() == {"date", "portfolio", "portfolio_return", "return", "status"}
    assert [str(r["date"]) for r in got] == DAYS[:3]
    assert [r["portfolio_return"] for r in got] == pytest.approx(
        [.25 * .02 + .75 * .05, .25 * -.03 + .75 * .01, .25 * .04 - .75 * .02])
    assert [r["return"] for r in got] == pytest.approx([.035, -.01, .01])
    assert {r["portfolio"] for r in got} == {"p"}


def test_same_day_returns_and_cap_weighted_benchmark(panel, weights):
    got = (generate_returns_from_weights(weights, panel, lag=0, benchmark="cap")
           .orderBy("date").collect())
    assert [r["portfolio_return"] for r in got] == pytest.approx([.0025, .0425, 0.0, -.005])
    assert [r["return"] for r in got] == pytest.approx(
        [.01, (.2 + 1.5) / 40, (-.3 + .3) / 40, (.4 - .6) / 40])
    with pytest.raises(ValueError, match="unknown benchmark"):
        generate_returns_from_weights(weights, panel, benchmark="gold")


def returns_frame(spark, portfolio, bench=None):
    bench = bench or [.01] * len(portfolio)
    return spark.createDataFrame(
        [(day(f"2023-02-{i + 1:02d}"), "p", p, b) for i, (p, b) in enumerate(zip(portfolio, bench))],
        "date date, portfolio string, portfolio_return double, `return` double")


def test_cumulative_returns_compound(spark):
    rows = cumulative_returns(returns_frame(spark, [.1, -.2, .5])).orderBy("date").collect()
    assert [r["cumulative_return"] for r in rows] == pytest.approx([.1, -.12, .32])
    assert rows[-1]["benchmark_cumulative_return"] == pytest.approx(1.01 ** 3 - 1)


def test_nothing_compounds_after_a_total_loss(spark):
    rows = cumulative_returns(returns_frame(spark, [.1, -1.5, .5])).orderBy("date").collect()
    assert [r["cumulative_return"] for r in rows] == [pytest.approx(.1), None, None]
    assert performance_summary(returns_frame(spark, [.1, -1.5])).first()["total_return"] is None


def test_summary(spark):
    p, b = [.1, -.2, .05, .02], [.05, -.1, .01, .03]
    row = performance_summary(returns_frame(spark, p, b), 252).first()
    beta = statistics.covariance(p, b) / statistics.variance(b)
    assert row["n_periods"] == 4
    assert row["mean_return"] == pytest.approx(statistics.fmean(p) * 252)
    assert row["volatility"] == pytest.approx(statistics.stdev(p) * math.sqrt(252))
    assert row["sharpe"] == pytest.approx(
        statistics.fmean(p) / statistics.stdev(p) * math.sqrt(252))
    assert row["total_return"] == pytest.approx(1.1 * .8 * 1.05 * 1.02 - 1)
    assert row["max_drawdown"] == pytest.approx(-.2)
    assert row["beta"] == pytest.approx(beta)
    assert row["alpha"] == pytest.approx((statistics.fmean(p) - beta * statistics.fmean(b)) * 252)


def test_drawdown_counts_from_the_start(spark):
    assert performance_summary(returns_frame(spark, [-.1, -.1])).first()["max_drawdown"] == (
        pytest.approx(.81 - 1))


@pytest.fixture
def alphas(spark):
    import random
    rng = random.Random(11)
    rows = [(day(d), f"A{i:02d}", rng.gauss(0, 1), rng.uniform(.1, .3), rng.gauss(0, .02), 1.0)
            for d in DAYS for i in range(20)]
    return spark.createDataFrame(rows, "date date, barrid string, s_alpha double, "
                                       "specific_risk double, `return` double, market_cap double")


@pytest.mark.parametrize("target, column", [("forward_alpha", "s_alpha"),
                                            ("forward_return", "return")])
def test_information_coefficient(alphas, target, column):
    got = {str(r["date"]): r["IC"]
           for r in diag.information_coefficient(alphas, "s", target).collect()}
    now = {(str(r["date"]), r["barrid"]): r for r in alphas.collect()}
    names = sorted({b for _, b in now})
    want = {d: statistics.correlation([now[d, b]["s_alpha"] for b in names],
                                      [now[n, b][column] for b in names])
            for d, n in zip(DAYS, DAYS[1:])}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="unknown target"):
        diag.information_coefficient(alphas, "s", "nothing")


def test_information_coefficient_of_constants_is_left_out(spark):
    rows = [(day(d), b, 1.0) for d in DAYS for b in "AB"]
    df = spark.createDataFrame(rows, "date date, barrid string, s_alpha double")
    assert diag.information_coefficient(df, "s").count() == 0


def test_quantile_tables_agree(alphas):
    means = {(str(r["date"]), r["quantile"]): r["quantile_return"]
             for r in diag.quantile_returns(alphas, "s").collect()}
    assert len(means) == 20
    pivot = {str(r["date"]): r for r in diag.quantile_pivot(alphas, "s").collect()}
    spread = {str(r["date"]): r["spread"] for r in diag.quantile_spread(alphas, "s").collect()}
    for d in DAYS:
        assert [pivot[d][f"q{k}"] for k in range(5)] == pytest.approx(
            [means[d, k] for k in range(5)])
        assert spread[d] == pytest.approx(means[d, 4] - means[d, 0])
    ranked = sorted((r for r in alphas.collect() if str(r["date"]) == DAYS[0]),
                    key=lambda r: r["s_alpha"])
    assert means[DAYS[0], 0] == pytest.approx(statistics.fmean(r["return"] for r in ranked[:4]))


def test_too_few_assets_have_no_spread(spark):
    df = spark.createDataFrame([(day(DAYS[0]), "A", .5, .01)],
                               "date date, barrid string, s_alpha double, `return` double")
    with pytest.raises(ValueError, match="not enough data for all quantiles"):
        diag.require_spread(diag.quantile_spread(df, "s"))


def test_all_diagnostic_tables(alphas, spark):
    weights = alphas.selectExpr("date", "barrid", "1D / 20 AS weight")
    tables = diag.diagnostics(weights, alphas, alphas, "s")
    counts = {name: table.count() for name, table in tables.items()}
    assert counts == {"cumulative_returns": 3, "performance_summary": 1,
                      "information_coefficient": 3, "quantile_spread": 4,
                      "zscore_histogram": 50, "weight_histogram": 50}
    bins = tables["zscore_histogram"].collect()
    assert sum(r["count"] for r in bins) == 80


def test_a_loss_counts_even_if_the_asset_leaves_the_filtered_rows(spark):
    """A loses 60 % and falls under a price floor, B gains 1 %: half of each earns -29.5 %."""
    rows = [(day(DAYS[0]), "A", .0, 10.0), (day(DAYS[0]), "B", .0, 10.0),
            (day(DAYS[1]), "A", -.6, 4.0), (day(DAYS[1]), "B", .01, 10.1)]
    panel = spark.createDataFrame(rows, "date date, barrid string, `return` double, price double").selectExpr(
        "*", "0.1D AS s_alpha", "0.1D AS specific_risk")
    weights = panel.where(f"date = '{DAYS[0]}'").selectExpr("date", "barrid", "0.5D AS weight")
    tables = diag.diagnostics(weights, panel.where("price >= 5"), panel, "s")
    row, = tables["cumulative_returns"].collect()
    assert row["cumulative_return"] == row["benchmark_cumulative_return"] == pytest.approx(-.295)


def test_a_date_without_weights_stays(spark, panel):
    """Nothing is held on it: compounded returns stay, and it is no period."""
    weights = spark.createDataFrame(
        [(day(d), b, None if d == DAYS[1] else .5) for d in DAYS for b in "AB"], "date date, barrid string, weight double")
    returns = generate_returns_from_weights(weights, panel)
    got = {str(r["date"]): (r["portfolio_return"], r["status"]) for r in returns.collect()}
    assert list(sorted(got)) == DAYS[:3] and got[DAYS[1]] == (None, "no_weights")
    assert got[DAYS[0]] == (pytest.approx(.035), "held")
    grown = [r["cumulative_return"] for r in cumulative_returns(returns).orderBy("date").collect()]
    assert grown[1] == pytest.approx(grown[0]) and performance_summary(returns).first()["n_periods"] == 2
