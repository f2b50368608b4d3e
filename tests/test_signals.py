from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.errors import AnalysisException

from panelquant.operators import rolling
from panelquant.operators.crosssection import standardise
from panelquant.operators.signals import SIGNALS, compute_alphas
from tests.conftest import day

DAYS = [f"2023-01-{d:02d}" for d in range(1, 29)]


def series(df, column, asset="A"):
    return [r[column] for r in df.where(f"barrid = '{asset}'").orderBy("date").collect()]


@pytest.fixture
def returns(spark):
    rows = [(day(d), b, x) for b, xs in (("A", (.03, .007, -.022)), ("B", (-.004, .011, .05)))
            for d, x in zip(DAYS, xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "date date, barrid string, `return` double")


def test_rolling_deviation_of_returns(returns):
    config = {"window_size": 3, "min_periods": 2, "direction": 1, "shift": 0}
    out = SIGNALS["return_vol"](returns, "vol", config)
    assert out.count() == returns.count()
    values = series(out, "vol")
    assert values[0] is None
    assert values[1] == pytest.approx(statistics.stdev([.03, .007]))
    assert values[2] == pytest.approx(statistics.stdev([.03, .007, -.022]))


def test_missing_input_column_is_an_error(returns):
    with pytest.raises(AnalysisException):
        SIGNALS["return_vol"](returns.drop("return"), "vol", {"window_size": 2}).collect()


def brute_rolling(values, size, least, statistic):
    out = []
    for i in range(len(values)):
        present = [v for v in values[max(0, i - size + 1):i + 1] if v is not None]
        out.append(statistic(present) if len(present) >= least else None)
    return out


@pytest.fixture
def holes(spark):
    rng = random.Random(7)
    data = {b: [None if rng.random() < .2 else rng.uniform(-1, 1) for _ in DAYS] for b in "ABC"}
    rows = [(day(d), b, x) for b, xs in data.items() for d, x in zip(DAYS, xs)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "date date, barrid string, x double")


@pytest.mark.parametrize("size, least", [(1, 1), (4, 2), (5, 5), (40, 3)])
def test_rolling_statistics_against_brute_force(holes, size, least):
    data, df = holes
    out = df.withColumns({"mean": rolling.rolling_mean("x", size, least),
                          "total": rolling.rolling_sum("x", size, least)})
    for asset, values in data.items():
        assert series(out, "mean", asset) == pytest.approx(
            brute_rolling(values, size, least, statistics.fmean))
        assert series(out, "total", asset) == pytest.approx(
            brute_rolling(values, size, least, math.fsum))


def test_window_must_hold_the_minimum():
    with pytest.raises(ValueError, match="does not fit"):
        rolling.rolling_mean("x", 5, 6)


def test_lag_and_lead_stay_inside_the_asset(holes):
    data, df = holes
    out = df.withColumns({"back": rolling.lag("x", 2), "ahead": rolling.lead("x")})
    for asset, values in data.items():
        assert series(out, "back", asset) == [None, None] + values[:-2]
        assert series(out, "ahead", asset) == values[1:] + [None]


def test_idio_vol_is_late_and_named_as_asked(spark):
    rows = [(day(d), "A", float(i + 1)) for i, d in enumerate(DAYS[:6])]
    df = spark.createDataFrame(rows, "date date, barrid string, specific_risk double")
    out = SIGNALS["idio_vol"](df, "quiet", {"window_size": 2})
    assert series(out, "quiet") == [None, None, None, -1.5, -2.5, -3.5]
    out = SIGNALS["idio_vol"](df, "quiet", {"window_size": 2, "min_periods": 1, "shift": 0,
                                            "direction": 1})
    assert series(out, "quiet") == [1.0, 1.5, 2.5, 3.5, 4.5, 5.5]


def test_reversal_sums_log_returns(spark):
    xs = [.01 * (i - 10) for i in range(25)]
    df = spark.createDataFrame([(day(d), "A", x) for d, x in zip(DAYS, xs)],
                               "date date, barrid string, `return` double")
    out = SIGNALS["str"](df, "rev", {})
    assert "log_return" in out.columns
    values = series(out, "rev")
    assert values[:21] == [None] * 21
    assert values[21] == pytest.approx(-sum(math.log1p(x) for x in xs[:22]))
    assert series(SIGNALS["reversal"](df, "rev", {"window_size": 2}), "rev")[1] == pytest.approx(
        -math.log1p(xs[0]) - math.log1p(xs[1]))


def test_price_impact_and_cost(spark):
    rows = [(day(d), "A", -.02 * i, 10.0, float(100 * i), .01 * i) for i, d in enumerate(DAYS[:4])]
    df = spark.createDataFrame(
        rows, "date date, barrid string, `return` double, price double, daily_volume double, "
              "bid_ask_spread double")
    impact = SIGNALS["price_impact"](df, "i", {"window_size": 2, "min_periods": 1, "shift": 0})
    assert series(impact, "i") == pytest.approx([None, 2e-5, 2e-5, 2e-5])
    cost = SIGNALS["cost"](df, "c", {"window_size": 2, "shift": 1})
    assert series(cost, "c") == pytest.approx([None, None, .005, .015])


def test_unknown_signal_type(returns):
    with pytest.raises(ValueError, match="unknown signal type"):
        compute_alphas(returns, {"name": "x", "type": "unknown_signal"})


def test_scores_are_standardised_per_date(spark, monkeypatch):
    df = spark.createDataFrame([(day("2023-01-01"), i, 1.0, float(i)) for i in (1, 2, 3)],
                               "date date, permno int, specific_risk double, raw double")
    monkeypatch.setitem(SIGNALS, "plain", lambda d, name, config: d.withColumnRenamed("raw", name))
    out = compute_alphas(df, {"name": "s", "type": "plain"}).orderBy("permno").collect()
    assert [r["s_score"] for r in out] == pytest.approx([-1, 0, 1])
    assert [r["s_alpha"] for r in out] == pytest.approx([-1, 0, 1])
    assert set(df.columns) - {"raw"} < set(out[0].asDict())


def test_degenerate_cross_sections_have_no_score(spark):
    rows = [(day("2023-01-01"), 5.0), (day("2023-01-02"), 2.0), (day("2023-01-02"), 2.0),
            (day("2023-01-03"), None), (day("2023-01-03"), 1.0), (day("2023-01-03"), 3.0)]
    out = standardise(spark.createDataFrame(rows, "date date, x double"), "x", "z")
    scores = sorted(((str(r["date"]), r["x"], r["z"]) for r in out.collect()), key=repr)
    assert [s[2] for s in scores if s[0] < "2023-01-03"] == [None, None, None]
    assert sorted(s[2] for s in scores if s[0] == "2023-01-03" and s[1]) == pytest.approx(
        [-math.sqrt(.5), math.sqrt(.5)])
    assert len(scores) == 6
