"""Quality screen on lagged price, dollar volume and spread."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelquant.functions.columns import col
from panelquant.operators.rolling import lag


def lagged_price_screen(panel: DataFrame, min_price: float) -> DataFrame:
    return panel.withColumn("price_lag", lag("price")).where(col("price_lag") >= min_price)


def lagged_dollar_volume_screen(panel: DataFrame, min_dollar_volume: float,
                                volume: str = "average_daily_volume_90") -> DataFrame:
    return (panel.withColumn("adv_lag", lag(volume))
            .withColumn("avg_daily_dollar_volume", col("adv_lag") * col("price_lag"))
            .where(col("avg_daily_dollar_volume") >= min_dollar_volume))


def lagged_spread_screen(panel: DataFrame, max_spread: float,
                         spread: str = "average_daily_bid_ask_spread_90") -> DataFrame:
    return panel.withColumn("spread_lag", lag(spread)).where(col("spread_lag") <= max_spread)


def quality_screen(panel: DataFrame, min_price: float = 5, min_dollar_volume: float = 2_000_000,
                   max_spread: float = 0.10, volume: str = "average_daily_volume_90",
                   spread: str = "average_daily_bid_ask_spread_90",
                   required: tuple[str, ...] = ()) -> DataFrame:
    """Three stages; each looks one row back among the rows the earlier stages kept.

    All windows share one partitioning and order: one exchange and one sort in all.
    """
    kept = lagged_price_screen(panel, min_price)
    if required:
        kept = kept.dropna(subset=list(required))
    kept = lagged_dollar_volume_screen(kept, min_dollar_volume, volume)
    kept = lagged_spread_screen(kept, max_spread, spread)
    return kept.dropna(subset=[*required, "avg_daily_dollar_volume", "spread_lag"])
