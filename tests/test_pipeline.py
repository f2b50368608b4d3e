from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest

from panelquant.operators.filters import apply_filters, prepare_data
from panelquant.operators.quantiles import exact_quantiles
from panelquant.operators.signals import compute_alphas
from panelquant.plans.quality import quality_screen
from panelquant.operators.returns import generate_returns_from_weights
from panelquant.plans.research import load_panel, realised_panel, run_pipeline
from panelquant.registry import spark_queries as registry
from panelquant.session import materialise, shared_dir
from panelquant.sources.panel import (load_assets, load_assets_by_date, parse_date, write_by_year)
from panelquant.sources.weekly import weekly_panel
from tests.conftest import RAW_SCHEMA, day

SMALL = "/root/testdata/sf0.001"

STUDY = {
    "data_loading": {
        "start_date": "2021-06-14", "end_date": "2021-06-18", "russell_filter": False,
        "columns": ["barrid", "date", "rootid", "iso_country_code", "price", "market_cap",
                    "daily_volume", "return", "specific_return", "specific_risk",
                    "predicted_beta"]},
    "data_cleaning": {"filters": [{"min_price": 3.0}]},
    "signal": {"name": "calm", "type": "idio_vol", "window_size": 4, "min_periods": 3,
               "direction": -1, "shift": 0},
    "backtest": {"constraints": ["LongOnly", "FullInvestment"], "gamma": 150},
}


@pytest.fixture
def panel(spark):
    # USP trades every day, USR misses one and starts below the floor; the rest never qualifies.
    rows = [
        ("2021-06-11", "USP", "USA", 5.0, 4.0, 7.0, 300, 7.8, 6e8, .8),
        ("2021-06-14", "USP", "USA", .7, .6, 7.0, 310, 8.0, 6e8, .8),
        ("2021-06-14", "USR", "USA", .4, .4, 14.0, 0, 2.5, 9e7, 1.4),
        ("2021-06-15", "USP", "USA", -1.4, -1.1, 7.2, 290, 7.9, 5.9e8, .8),
        ("2021-06-15", "DEX", "DEU", 7.0, 6.1, 9.0, 990, 60.0, 8e9, 1.1),
        ("2021-06-16", "USP", "USA", 3.5, 2.9, 7.1, 450, 8.2, 6.1e8, .8),
        ("2021-06-16", "USR", "USA", 2.1, 1.5, 14.3, 120, 3.2, 1.1e8, 1.4),
        ("2021-06-17", "USP", "USA", -.3, .2, 7.0, 380, 8.1, 6e8, .8),
        ("2021-06-17", "USR", "USA", -2.2, -2.6, 14.1, 80, 3.1, 1e8, 1.4),
        ("2021-06-17", "USN", "USA", .2, .2, 11.0, 60, float("nan"), 3e8, 1.0),
        ("2021-06-18", "USP", "USA", 1.2, .9, 6.9, 330, 8.2, 6.1e8, .8),
        ("2021-06-18", "USR", "USA", .9, .1, 13.8, 95, 3.2, 1.1e8, 1.4),
    ]
    rows = [(day(r[0]), r[1], r[1], *r[2:]) for r in rows]
    return spark.createDataFrame(rows, RAW_SCHEMA + ", predicted_beta double")


def test_load_and_clean(panel):
    loaded = load_panel(panel, STUDY)
    got = sorted((str(r["date"]), r["barrid"]) for r in loaded.collect())
    assert got == [("2021-06-14", "USP"), ("2021-06-15", "USP"),
                   *((f"2021-06-{d}", a) for d in (16, 17, 18) for a in ("USP", "USR"))]
    assert loaded.agg({"return": "max"}).first()[0] == pytest.approx(.035)
    assert loaded.columns == STUDY["data_loading"]["columns"]


def test_alphas_on_loaded_data(panel):
    alphas = compute_alphas(load_panel(panel, STUDY), STUDY["signal"])
    assert {"calm", "calm_score", "calm_alpha"} <= set(alphas.columns)
    assert alphas.where("calm_alpha IS NOT NULL").count() == 2


def test_full_run_writes_its_results(spark, panel, tmp_path):
    source = str(tmp_path / "panel")
    write_by_year(panel, source)
    config = {**STUDY, "output": {"results_path": str(tmp_path / "results")},
              "data_loading": {**STUDY["data_loading"], "path": source}}
    # A second run replaces the results of the first.
    for _ in range(2):
        result = run_pipeline(spark, config, "small", write_alphas=True)
    assert {name: os.path.relpath(p, tmp_path) for name, p in result.paths.items()} == {
        kind: f"results/small/small_{kind}.parquet" for kind in ("weights", "returns", "alphas")}
    weights = spark.read.parquet(result.paths["weights"])
    assert weights.count() == 2
    assert weights.agg({"weight": "sum"}).first()[0] == pytest.approx(1.0)
    assert spark.read.parquet(result.paths["alphas"]).count() == 8
    # The only weights are of the last day, which earns nothing any more.
    assert os.path.isdir(result.paths["returns"]) and result.returns.count() == 0
    assert result.returns.columns == ["date", "portfolio", "portfolio_return", "return", "status"]


def test_a_run_without_signal_or_data_is_refused(panel, tmp_path):
    config = {**STUDY, "output": {"results_path": str(tmp_path)}}
    with pytest.raises(ValueError, match="signal"):
        run_pipeline(panel, {k: v for k, v in config.items() if k != "signal"}, "x")
    with pytest.raises(ValueError, match="data validation failed"):
        run_pipeline(panel.where("false"), config, "x")


def test_scan_bounds_universe_and_missing_columns(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    flagged = panel.selectExpr("*", "barrid = 'USP' AS russell_1000",
                               "CASE WHEN barrid = 'USR' THEN true END AS russell_2000")
    write_by_year(flagged, path)
    scan = load_assets(spark, path, parse_date("2021-06-15"), "2021-06-16")
    assert scan.count() == 4
    member = load_assets(spark, path, "2021-06-15", "2021-06-16", in_universe=True)
    assert {r["barrid"] for r in member.collect()} == {"USP", "USR"}
    one_day = load_assets_by_date(spark, path, "2021-06-17", True, ["barrid", "price"])
    assert sorted(r["barrid"] for r in one_day.collect()) == ["USP", "USR"]
    wide = load_assets(spark, path, "2021-06-14", "2021-06-18", columns=["barrid", "yield"],
                       missing_as_null=True)
    assert dict(wide.dtypes) == {"barrid": "string", "yield": "double"}


def test_stages_of_the_quality_screen_are_not_collapsed(spark):
    rows = [(f"2023-01-{d:02d}", p, v, s) for d, p, v, s in (
        (1, 10., 100., .01), (2, 1., 100., .01), (3, 10., 1000., .5), (4, 10., 1000., .01),
        (5, 10., 1000., .01), (6, 10., 1000., .01))]
    df = spark.createDataFrame([(day(d), "A", p, v, s) for d, p, v, s in rows],
                               "date date, barrid string, price double, v double, s double")
    kept = quality_screen(df, 5, 5000, .1, "v", "s").orderBy("date").collect()
    # Day 3 goes by the price of day 2; day 4 then looks back at day 2 for its volume and goes;
    # day 5 opens the survivors, so it has no spread before it.
    assert [str(r["date"])[-2:] for r in kept] == ["06"]
    assert kept[0]["avg_daily_dollar_volume"] == 10000.0


def test_percentile_screens_use_the_same_rows(spark):
    rows = [(day("2023-01-01"), f"US{i}", f"US{i}", "USA", 1., 1., 1., i, 1., 1., float(-i))
            for i in range(1, 12)]
    df = spark.createDataFrame(rows, RAW_SCHEMA + ", bid_ask_spread double")
    spec = {"dollar_volume_percentile": .2, "bid_ask_spread_percentile": .3}
    kept = apply_filters(df, [spec]).collect()
    assert sorted(r["daily_volume"] for r in kept) == list(range(4, 12))
    assert kept[0].asDict().keys() == set(df.columns)


# --- plans -------------------------------------------------------------------------------------

def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    write_by_year(panel, path)
    config = {**STUDY, "data_loading": {**STUDY["data_loading"], "path": path}}
    alphas = compute_alphas(load_panel(spark, config), STUDY["signal"])
    text = plan(alphas.select("date", "barrid", "calm_alpha"))
    for scan in re.findall(r"FileScan.*", text):
        assert "GreaterThanOrEqual(price,3.0)" in scan and "EqualTo(iso_country_code,USA)" in scan
        assert "PartitionFilters: [isnotnull(year" in scan
        schema = scan[scan.index("ReadSchema"):]
        assert "market_cap" not in schema and "predicted_beta" not in schema


def exchanges(text: str) -> list[str]:
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (\w+)\(?([^\n]*?)\)?, ENSURE", text)


def test_an_alpha_moves_the_panel_by_asset_and_sums_by_date(spark, panel):
    alphas = compute_alphas(prepare_data(panel), STUDY["signal"])
    keys = [k for k, _ in exchanges(plan(alphas))]
    text = plan(alphas)
    assert keys.count("hashpartitioning") == 3
    # By asset for the signal, twice because of the statistics branch, and the per-date sums.
    assert len(re.findall(r"Exchange hashpartitioning\(barrid", text)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(date", text)) == 1
    assert "BroadcastHashJoin [date" in text


def test_the_quality_screen_sorts_once(spark, panel):
    panel = panel.selectExpr("*", "daily_volume * 1D AS v", "price * 0 AS s")
    text = plan(quality_screen(panel, 5, 1, 1, "v", "s"))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {
    # These write or solve while they are being built; their parts are covered here as well.
    "research_job", "panel_written_and_read", "alphas_written_and_read",
    "summary_written_and_read", "mvo_long_only", "mvo_long_only_budget", "mvo_long_only_check",
    "mvo_factor", "mvo_factor_budget", "mvo_factor_check", "mvo_factor_kkt", "holdings_csv_preamble",
    "reversal_study_returns", "reversal_study_summary", "panel_validation", "diagnostics_job",
    "holdings_csv_footer", "holdings_json", "pair_covariance", "daily_covariance",
    "portfolio_etf_beta", "asset_beta_vector", "neutral_overlay", "etf_beta_job"}))
def test_no_cross_joins_and_no_global_windows(spark, name):
    text = plan(registry.QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.splitlines()
    for above, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in above:
            # Only partial aggregates and rows of per-date tables may meet in one task.
            assert "partial_" in below or "portfolio_return#" in below, below


def test_quantiles_scan_their_input_once(spark):
    panel = weekly_panel(spark, SMALL)
    df = exact_quantiles(panel, "price", [.5])
    df.collect()
    text = plan(df)
    final = text[:text.index("Initial Plan")]
    assert len(re.findall(r"FileScan parquet .*l_suppkey", final)) == 1
    assert "ReusedExchange" in final


# --- checkpoint folder -------------------------------------------------------------------------

def test_checkpoints_go_to_the_named_folder(spark):
    folder = shared_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", "")
    assert not named or folder == named
    df = materialise(spark.range(3))
    assert df.count() == 3
    current = spark.sparkContext.getCheckpointDir()
    assert current.removeprefix("file:").startswith(folder.removeprefix("file:"))


def test_returns_come_from_rows_that_the_filters_remove(spark, tmp_path):
    # A loses 60 % and falls below the floor, then gains 50 %; B stands still.
    rows = [(day(d), a, a, "USA", r, r, 5.0, 1000, p, 1e9, 1.0) for a, d, r, p in (
        ("USA7", "2021-06-14", 0.0, 10.0), ("USA7", "2021-06-15", -60.0, 2.0), ("USA7", "2021-06-16", 50.0, 3.0),
        ("USB8", "2021-06-14", 0.0, 10.0), ("USB8", "2021-06-15", 1.0, 10.1), ("USB8", "2021-06-16", 0.0, 10.1))]
    frame = spark.createDataFrame(rows, RAW_SCHEMA + ", predicted_beta double")
    weights = spark.createDataFrame([(day("2021-06-14"), "USA7", 0.5), (day("2021-06-14"), "USB8", 0.5)],
                                    "date date, barrid string, weight double")
    paid = generate_returns_from_weights(weights, realised_panel(frame, STUDY)).collect()
    assert [r.portfolio_return for r in paid] == [pytest.approx(-0.295)]


OUTSIDE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
entry.queries()["daily_covariance"](spark, {data!r}).write.format("noop").mode("overwrite").save()
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", OUTSIDE.format(repo=repo, data=SMALL)],
                          cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
