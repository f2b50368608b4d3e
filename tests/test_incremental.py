from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from panelquant.operators.signals import REACH, SIGNALS, history
from panelquant.plans.incremental import latest_state, run_incremental
from panelquant.plans.research import run_pipeline
from panelquant.sources.panel import write_by_year

DAYS, ASSETS = 60, 14
FIRST = dt.date(2019, 11, 4)


@pytest.fixture(scope="module")
def panel_path(spark, tmp_path_factory):
    """Sixty days over a turn of year; asset 3 is away from day 12 to 44, asset 5 misses every seventh day,
    asset 9 falls under the floor at times, asset 11 starts late and asset 12 ends early."""
    cells = spark.range(DAYS * ASSETS).selectExpr(
        f"CAST(id DIV {ASSETS} AS int) AS d", f"CAST(id % {ASSETS} AS int) AS a", "id")
    cells = cells.where(f"NOT (a = 3 AND d BETWEEN 12 AND 44) AND NOT (a = 5 AND d % 7 = 3) AND NOT (a = 11 AND d < 38) "
                        "AND NOT (a = 12 AND d > 20)")
    noise = [F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0 for k in range(5)]
    panel = cells.select(
        F.date_add(F.lit(FIRST), F.col("d")).alias("date"), F.format_string("US%02d", "a").alias("barrid"),
        F.format_string("US%02d", "a").alias("rootid"), F.lit("USA").alias("iso_country_code"),
        (noise[0] * 6 - 3).alias("return"), (noise[1] * 5 - 2.5).alias("specific_return"),
        (noise[2] * 10 + 5).alias("specific_risk"), (noise[3] * 900 + 100).cast("long").alias("daily_volume"),
        F.when(F.col("a") == 9, noise[4] * 12).otherwise(noise[4] * 40 + 5).alias("price"),
        (noise[1] * 1e9 + 1e7).alias("market_cap"), (noise[3] + 0.5).alias("predicted_beta"),
        (noise[4] * 0.05).alias("bid_ask_spread"))
    path = str(tmp_path_factory.mktemp("incremental") / "panel")
    write_by_year(panel, path)
    return path


def study(path, results, kind, last_day, **signal):
    return {
        "data_loading": {"path": path, "start_date": str(FIRST), "end_date": str(FIRST + dt.timedelta(days=last_day)),
                         "columns": ["date", "barrid", "rootid", "iso_country_code", "return", "specific_return",
                                     "specific_risk", "daily_volume", "price", "market_cap", "predicted_beta",
                                     "bid_ask_spread"]},
        "data_cleaning": {"filters": [{"usa_only": True, "min_price": 4.0, "dollar_volume_percentile": 0.1}]},
        "signal": {"name": "s", "type": kind, **signal},
        "backtest": {"constraints": ["FullInvestment"], "gamma": 100},
        "output": {"results_path": str(results)},
    }


def same(got, expected, keys):
    columns = expected.columns
    assert sorted(got.columns) == sorted(columns)
    got, expected = (sorted(map(tuple, df.select(*columns).collect()), key=lambda r: [str(r[columns.index(k)]) for k in keys])
                     for df in (got, expected))
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-12) if isinstance(y, float) else y), (a, b)


@pytest.mark.parametrize("kind, ends, signal", [
    ("str", (25, 59), {"window_size": 5}),
    ("price_impact", (11, 12, 45, 59), {"window_size": 4, "min_periods": 2}),
    ("idio_vol", (30, 57, 59), {"window_size": 1, "shift": 0}),
])
def test_parts_equal_the_whole(spark, panel_path, tmp_path, kind, ends, signal):
    whole = run_pipeline(spark, study(panel_path, tmp_path / "whole", kind, DAYS, **signal), "run", write_alphas=True)
    for end in ends:
        parts = run_incremental(spark, study(panel_path, tmp_path / "parts", kind, end, **signal), "run")
    same(parts.alphas, whole.alphas, ("date", "barrid"))
    same(parts.weights, whole.weights, ("date", "barrid"))
    same(parts.returns, whole.returns, ("date",))


def test_asset_that_returns_pays_its_old_date(spark, panel_path, tmp_path):
    config = study(panel_path, tmp_path, "str", 30, window_size=2)
    before = {r["date"]: r for r in run_incremental(spark, config, "run").returns.collect()}
    after = {r["date"]: r for r in run_incremental(
        spark, study(panel_path, tmp_path, "str", 50, window_size=2), "run").returns.collect()}
    away = FIRST + dt.timedelta(days=11)
    assert after[away]["return"] != before[away]["return"]
    assert [d for d in before if after[d]["return"] != pytest.approx(before[d]["return"], rel=1e-12)] == [away]


def test_state_is_small_and_the_only_one(spark, panel_path, tmp_path):
    for end in (20, 40):
        run_incremental(spark, study(panel_path, tmp_path, "str", end, window_size=5), "run")
    folder = tmp_path / "run" / "state"
    (fingerprint,) = os.listdir(folder)
    assert [n for n in os.listdir(folder / fingerprint) if not n.startswith(".")] == [
        f"upto={FIRST + dt.timedelta(days=40)}"]
    state = latest_state(spark, str(folder / fingerprint))
    assert state.rows.groupBy("barrid").count().agg(F.max("count")).first()[0] == 4
    assert state.open.count() == ASSETS
    assert state.sums.count() == 41


def test_later_runs_read_new_dates_only(spark, panel_path, tmp_path):
    run_incremental(spark, study(panel_path, tmp_path, "str", 20, window_size=5), "run")
    # The first days are gone from the panel; the state has what is needed of them.
    newer = spark.read.parquet(panel_path).where(F.col("date") > F.lit(FIRST + dt.timedelta(days=20)))
    got = run_incremental(newer, study(panel_path, tmp_path, "str", 59, window_size=5), "run")
    whole = run_pipeline(spark, study(panel_path, tmp_path / "whole", "str", 59, window_size=5), "run")
    same(got.returns, whole.returns, ("date",))


def test_run_again_and_broken_runs(spark, panel_path, tmp_path):
    config = study(panel_path, tmp_path, "str", 59, window_size=5)
    run_incremental(spark, study(panel_path, tmp_path, "str", 20, window_size=5), "run")
    first = [r for r in run_incremental(spark, config, "run").returns.orderBy("date").collect()]
    assert run_incremental(spark, config, "run").returns.orderBy("date").collect() == first
    with pytest.raises(ValueError, match="already reach"):
        run_incremental(spark, study(panel_path, tmp_path, "str", 30, window_size=5), "run")
    # A state without its last table is none; the run starts anew and overwrites.
    (fingerprint,) = os.listdir(tmp_path / "run" / "state")
    folder = tmp_path / "run" / "state" / fingerprint
    os.remove(folder / f"upto={FIRST + dt.timedelta(days=59)}" / "sums" / "_SUCCESS")
    assert latest_state(spark, str(folder)) is None
    same(run_incremental(spark, config, "run").returns, spark.createDataFrame(first), ("date",))


def test_rows_that_are_all_screened_out(spark, panel_path, tmp_path):
    panel = spark.read.parquet(panel_path).drop("year")
    late = F.col("date") > F.lit(FIRST + dt.timedelta(days=20))
    panel = panel.withColumn("price", F.when(late, 1.0).otherwise(F.col("price")))
    for end in (20, 30):
        parts = run_incremental(panel, study(panel_path, tmp_path / "parts", "str", end, window_size=5), "run")
    whole = run_pipeline(panel, study(panel_path, tmp_path / "whole", "str", 30, window_size=5), "run")
    same(parts.weights, whole.weights, ("date", "barrid"))
    same(parts.returns, whole.returns, ("date",))


def test_other_settings_start_anew(spark, panel_path, tmp_path):
    run_incremental(spark, study(panel_path, tmp_path, "str", 40, window_size=5), "run")
    run_incremental(spark, study(panel_path, tmp_path, "str", 30, window_size=3), "run")
    # Back to the first settings: their old state is of results that are gone.
    got = run_incremental(spark, study(panel_path, tmp_path, "str", 50, window_size=5), "run")
    whole = run_pipeline(spark, study(panel_path, tmp_path / "whole", "str", 50, window_size=5), "run")
    same(got.weights, whole.weights, ("date", "barrid"))
    same(got.returns, whole.returns, ("date",))


def test_history():
    assert set(REACH) == set(SIGNALS)
    assert history({"type": "str"}) == 21
    assert history({"type": "cost", "window_size": 10}) == 11
    with pytest.raises(ValueError):
        history({"type": "str", "shift": -1})
    with pytest.raises(ValueError):
        history({"type": "none"})


def test_empty_panel(spark, panel_path, tmp_path):
    empty = spark.read.parquet(panel_path).limit(0)
    with pytest.raises(ValueError):
        run_incremental(empty, study(panel_path, tmp_path, "str", 20, window_size=5), "run")
