"""Signals: functions from panel to panel, looked up by type name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.functions.columns import col, divide, log_return
from panelquant.operators import rolling
from panelquant.operators.crosssection import alpha, standardise
from panelquant.session import written


def rolling_signal(df: DataFrame, name: str, statistic: Callable[..., Column], value: str | Column,
                   window_size: int, min_periods: int | None = None, direction: float = 1,
                   shift: int = 0) -> DataFrame:
    """``direction`` times a rolling statistic, then moved ``shift`` rows later per asset."""
    df = df.withColumn(name, statistic(value, window_size, min_periods) * direction)
    return df.withColumn(name, rolling.lag(name, shift)) if shift else df


#: Window and shift of each signal where its configuration names none.
REACH = {"idio_vol": (252, 2), "return_vol": (252, 0), "str": (22, 0), "reversal": (22, 0),
         "price_impact": (22, 2), "cost": (252, 2)}


def _window_and_shift(kind: str, config: dict) -> tuple[int, int]:
    window_size, shift = REACH[kind]
    return config.get("window_size", window_size), config.get("shift", shift)


def history(signal: dict) -> int:
    """How many of an asset's rows before a row its signal depends on."""
    if signal["type"] not in REACH:
        raise ValueError(f"unknown signal type: {signal['type']}")
    window_size, shift = _window_and_shift(signal["type"], signal)
    if shift < 0:
        raise ValueError("a signal that looks ahead has no past alone")
    return window_size - 1 + shift


def _from_config(df: DataFrame, name: str, config: dict, statistic, value, kind: str,
                 direction: float) -> DataFrame:
    window_size, shift = _window_and_shift(kind, config)
    return rolling_signal(df, name, statistic, value, window_size, config.get("min_periods"),
                          config.get("direction", direction), shift)


def compute_idio_vol(df: DataFrame, name: str, config: dict) -> DataFrame:
    """Minus the rolling mean of specific risk, known two rows late."""
    return _from_config(df, name, config, rolling.rolling_mean, "specific_risk", "idio_vol", -1)


def compute_return_vol(df: DataFrame, name: str, config: dict) -> DataFrame:
    """Rolling sample standard deviation of returns."""
    return _from_config(df, name, config, rolling.rolling_std, "return", "return_vol", 1)


def compute_str(df: DataFrame, name: str, config: dict) -> DataFrame:
    """Short-term reversal: minus the rolling sum of log returns. Leaves ``log_return``."""
    df = df.withColumn("log_return", log_return())
    return _from_config(df, name, config, rolling.rolling_sum, "log_return", "str", -1)


def compute_price_impact(df: DataFrame, name: str, config: dict) -> DataFrame:
    """Amihud (2002) illiquidity: mean of absolute return per unit of traded value."""
    impact = divide(F.abs(col("return")), col("price") * col("daily_volume"))
    return _from_config(df, name, config, rolling.rolling_mean, impact, "price_impact", 1)


def compute_cost(df: DataFrame, name: str, config: dict) -> DataFrame:
    """Rolling mean bid-ask spread."""
    return _from_config(df, name, config, rolling.rolling_mean, "bid_ask_spread", "cost", 1)


SIGNALS: dict[str, Callable[[DataFrame, str, dict], DataFrame]] = {
    "idio_vol": compute_idio_vol,
    "return_vol": compute_return_vol,
    "str": compute_str,
    "reversal": compute_str,
    "price_impact": compute_price_impact,
    "cost": compute_cost,
}


def compute_alphas(df: DataFrame, signal: dict, stored: bool = False, after: dt.date | None = None) -> DataFrame:
    """Adds the signal, its per-date z-score ``<name>_score`` and ``<name>_alpha``.

    Standardising needs the signal twice, for its sums per date and for its values. With ``stored`` the frame is
    written to the shared folder once it has the signal, so its window is evaluated once, and the sums read
    one narrow column; without, nothing is written and the window is evaluated twice. Rows up to the date
    ``after`` only fill the windows of later ones and are left out.
    """
    name, kind = signal["name"], signal["type"]
    if kind not in SIGNALS:
        raise ValueError(f"unknown signal type: {kind}")
    df = SIGNALS[kind](df, name, signal)
    if after is not None:
        df = df.where(col("date") > F.lit(after))
    if stored:
        df = written(df, "signal")
    df = standardise(df, name, f"{name}_score")
    return df.withColumn(f"{name}_alpha", alpha(f"{name}_score"))
