"""Beta of a portfolio, and of every asset, to a basket of holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelquant.functions.columns import col
from panelquant.operators.covariance import (asset_beta, covariance_against, periodic, portfolio_beta,
                                             products_with)
from panelquant.operators.holdings import (align_weights, beta_neutral_overlay, dropped_tickers,
                                           map_tickers)
from panelquant.session import materialise, written


def aligned_by_asset(holdings: DataFrame, basket: DataFrame, ids: DataFrame) -> DataFrame:
    """``asset, portfolio_weight, basket_weight`` over the tickers with an asset id."""
    aligned = map_tickers(align_weights(holdings, basket), ids)
    # Two tickers of one asset are one position.
    return aligned.groupBy(col("barrid").alias("asset")).agg(
        F.sum("portfolio_weight").alias("portfolio_weight"),
        F.sum("basket_weight").alias("basket_weight"))


def etf_beta(holdings: DataFrame, basket: DataFrame, ids: DataFrame, returns: DataFrame,
             periods_per_year: int = 252) -> dict[str, DataFrame]:
    """``holdings`` and ``basket`` have ``ticker, weight``, ``ids`` maps ``ticker`` to ``barrid``
    and ``returns`` has ``barrid, date, return``.

    Returns of other assets are dropped before anything is paired, and only covariances of an asset
    with a member of the basket are computed, block by block and without a row for each. These returns, the
    positions and the covariances with the basket, one row per asset each, are written once; all tables read those.
    """
    aligned = materialise(aligned_by_asset(holdings, basket, ids))
    used = written(returns.join(aligned.select(col("asset").alias("barrid")), "barrid", "left_semi"), "beta-returns")
    cells = covariance_against(used, aligned.where(col("basket_weight") != 0), periods_per_year)
    products = materialise(products_with(periodic(cells, periods_per_year), aligned, "basket_weight"))
    beta = portfolio_beta(products, aligned, "portfolio_weight", "basket_weight")
    return {
        "beta": beta,
        "asset_beta": asset_beta(products, aligned, "basket_weight"),
        "overlay": beta_neutral_overlay(aligned, beta),
        "dropped": dropped_tickers(holdings, basket, ids),
    }
