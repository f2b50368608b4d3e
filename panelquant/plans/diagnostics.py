"""Diagnostic tables over an alpha frame and a weights table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelquant.functions.columns import col
from panelquant.functions.stats import correlation
from panelquant.operators.crosssection import recover_zscore
from panelquant.operators.histogram import histogram
from panelquant.operators.quantiles import quantile_bucket
from panelquant.operators.returns import (cumulative_returns, generate_returns_from_weights,
                                          performance_summary)
from panelquant.operators.rolling import lead

QUANTILES = 5


def information_coefficient(alphas: DataFrame, signal_name: str,
                            target: str = "forward_alpha") -> DataFrame:
    """``date, IC``: per-date correlation of the alpha with the asset's next alpha or return."""
    name = f"{signal_name}_alpha"
    following = {"forward_alpha": name, "forward_return": "return"}
    if target not in following:
        raise ValueError(f"unknown target: {target}")
    ahead = alphas.select("date", col(name).alias("now"), lead(following[target]).alias("next"))
    return (ahead.groupBy("date").agg(correlation("now", "next").alias("IC"))
            .where("IC IS NOT NULL"))


def quantile_returns(alphas: DataFrame, signal_name: str, buckets: int = QUANTILES) -> DataFrame:
    """``date, quantile, quantile_return``."""
    return (quantile_bucket(alphas, f"{signal_name}_alpha", buckets)
            .groupBy("date", "quantile").agg(F.avg("return").alias("quantile_return")))


def quantile_pivot(alphas: DataFrame, signal_name: str, buckets: int = QUANTILES) -> DataFrame:
    """``date, q0 .. q4``: conditional means in one aggregation over (date)."""
    bucketed = quantile_bucket(alphas, f"{signal_name}_alpha", buckets)
    return bucketed.groupBy("date").agg(
        *[F.avg(F.when(col("quantile") == k, col("return"))).alias(f"q{k}")
          for k in range(buckets)])


def quantile_spread(alphas: DataFrame, signal_name: str, buckets: int = QUANTILES) -> DataFrame:
    """``date, spread``: mean return of the top bucket minus the bottom one.

    Dates where either is absent have no spread; none at all is an error only the caller of an
    action can notice, see `require_spread`.
    """
    return (quantile_pivot(alphas, signal_name, buckets)
            .select("date", (col(f"q{buckets - 1}") - col("q0")).alias("spread"))
            .where("spread IS NOT NULL"))


def require_spread(spread: DataFrame) -> DataFrame:
    if spread.isEmpty():
        raise ValueError("not enough data for all quantiles")
    return spread


def zscore_histogram(alphas: DataFrame, signal_name: str, bins: int = 50) -> DataFrame:
    return histogram(recover_zscore(alphas, f"{signal_name}_alpha"), "zscore", bins)


def weight_histogram(weights: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(weights, "weight", bins)


def diagnostics(weights: DataFrame, alphas: DataFrame, panel: DataFrame, signal_name: str,
                periods_per_year: int = 252) -> dict[str, DataFrame]:
    """The tables behind the charts; each has at most a few rows per date.

    Returns are paid from ``panel``, the cleaned panel before its row filters; an asset that leaves the
    filtered alphas after a loss has still lost. ``alphas`` is read several times: pass a frame that is
    written out or checkpointed.
    """
    returns = generate_returns_from_weights(weights, panel)
    return {
        "cumulative_returns": cumulative_returns(returns),
        "performance_summary": performance_summary(returns, periods_per_year),
        "information_coefficient": information_coefficient(alphas, signal_name),
        "quantile_spread": quantile_spread(alphas, signal_name),
        "zscore_histogram": zscore_histogram(alphas, signal_name),
        "weight_histogram": weight_histogram(weights),
    }
