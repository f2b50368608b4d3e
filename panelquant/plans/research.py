"""The research job: panel to signal to alphas to weights to returns."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelquant.operators.filters import apply_filters, prepare_data, validate_data
from panelquant.operators.optimizer import run_mvo_backtest
from panelquant.operators.returns import generate_returns_from_weights
from panelquant.operators.signals import compute_alphas
from panelquant.sources.panel import load_assets, parse_date, select_assets, write_by_year


@dataclass(frozen=True)
class ResearchResult:
    alphas: DataFrame
    weights: DataFrame
    returns: DataFrame
    #: The cleaned panel before its row filters, which weights are paid from.
    panel: DataFrame
    paths: dict[str, str]


def load_panel(source: SparkSession | DataFrame, config: dict) -> DataFrame:
    """Scan, clean and filter as configured. ``source`` is a session (then
    ``data_loading.path`` names the Parquet panel) or a panel frame."""
    loading, cleaning = config["data_loading"], config.get("data_cleaning", {})
    filters = cleaning.get("filters")
    options = {
        "start": parse_date(loading["start_date"]), "end": parse_date(loading["end_date"]),
        "in_universe": loading.get("russell_filter", False), "columns": loading["columns"],
        "filters": filters, "missing_as_null": cleaning.get("add_missing_columns", False),
    }
    if isinstance(source, SparkSession):
        panel = load_assets(source, loading["path"], **options)
    else:
        panel = select_assets(source, **options)
    panel = prepare_data(panel, cleaning)
    return apply_filters(panel, filters) if filters else panel


def realised_panel(source: SparkSession | DataFrame, config: dict) -> DataFrame:
    """The scan and cleaning of ``load_panel`` without its row filters: what was held is paid its
    next return even where the next row would not pass them."""
    cleaning = {k: v for k, v in config.get("data_cleaning", {}).items() if k != "filters"}
    return load_panel(source, {**config, "data_cleaning": cleaning})


def run_pipeline(source: SparkSession | DataFrame, config: dict, run_name: str,
                 write_alphas: bool = False) -> ResearchResult:
    """Runs one configured study and writes weights and returns below
    ``<output.results_path>/<run_name>/``."""
    if "signal" not in config:
        raise ValueError("configuration has no 'signal' section")
    signal, backtest = config["signal"], config["backtest"]
    # Asked of the panel before its screens, so that they are not run for a single row.
    realised = realised_panel(source, config)
    if not validate_data(realised):
        raise ValueError("data validation failed")
    spark = realised.sparkSession
    folder = os.path.join(config["output"]["results_path"], run_name)
    paths = {kind: os.path.join(folder, f"{run_name}_{kind}.parquet")
             for kind in ("weights", "returns", "alphas")}

    def written(df: DataFrame, kind: str) -> DataFrame:
        """What follows reads the written rows, so nothing is computed twice."""
        write_by_year(df, paths[kind])
        # The schema is given, since a result without rows has no file to take it from.
        return spark.read.schema(df.schema).parquet(paths[kind])

    # The rolling window and the screens are evaluated once, while the signal is written.
    alphas = compute_alphas(load_panel(source, config), signal, stored=True)
    if alphas.isEmpty():
        raise ValueError("data validation failed")
    if write_alphas:
        alphas = written(alphas, "alphas")
    else:
        del paths["alphas"]
    weights = run_mvo_backtest(alphas, signal["name"], backtest["constraints"],
                               backtest["gamma"], backtest.get("factors", ()),
                               backtest.get("factor_cov"))
    weights = written(weights, "weights")
    returns = written(generate_returns_from_weights(weights, realised, portfolio=run_name), "returns")
    return ResearchResult(alphas, weights, returns, realised, paths)
