"""Holdings: weights, ticker mapping, outer alignment and the beta-neutral overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelquant.functions.columns import col, divide


def holdings_weights(holdings: DataFrame) -> DataFrame:
    """Adds ``market_value`` and its share of the total (a scalar subquery, not a join)."""
    valued = holdings.withColumn("market_value", col("shares") * col("price"))
    total = valued.agg(F.sum("market_value")).scalar()
    return valued.withColumn("weight", divide(col("market_value"), total))


def last_by_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key, the value of its last row; combined on the map side."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def map_tickers(holdings: DataFrame, ids: DataFrame, order: str = "barrid") -> DataFrame:
    """Holdings with their asset id; tickers without one are left out."""
    return holdings.join(last_by_key(ids, "ticker", "barrid", order), "ticker")


def ticker_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ticker").union(b.select("ticker")).distinct()


def dropped_tickers(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """Tickers of either list that have no asset id."""
    return ticker_union(a, b).join(ids.select("ticker"), "ticker", "left_anti")


def align_weights(portfolio: DataFrame, basket: DataFrame, key: str = "ticker") -> DataFrame:
    """``key, portfolio_weight, basket_weight``; a weight absent on one side is zero."""
    a = portfolio.select(key, col("weight").alias("portfolio_weight"))
    b = basket.select(key, col("weight").alias("basket_weight"))
    zero = F.lit(0.0)
    return a.join(b, key, "outer").select(
        key, F.coalesce("portfolio_weight", zero).alias("portfolio_weight"),
        F.coalesce("basket_weight", zero).alias("basket_weight"))


def beta_neutral_overlay(aligned: DataFrame, beta: DataFrame, key: str = "asset") -> DataFrame:
    """Portfolio weight minus beta times basket weight; ``beta`` is a one-row table."""
    b = beta.select("beta").scalar()
    return aligned.select(
        key, (col("portfolio_weight") - b * col("basket_weight")).alias("weight"))
