"""The reversal study: alphas divided by risk, weights and returns, on all rows and on screened ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelquant.functions.columns import col
from panelquant.operators.crosssection import alpha_divisive, standardise
from panelquant.operators.optimizer import run_mvo_backtest
from panelquant.operators.returns import generate_returns_from_weights, performance_summary
from panelquant.operators.signals import compute_str
from panelquant.plans.quality import quality_screen
from panelquant.session import written

CONSTRAINTS = ("FullInvestment", "LongOnly", "NoBuyingOnMargin", "UnitBeta")


@dataclass(frozen=True)
class Study:
    weights: DataFrame
    returns: DataFrame
    summary: DataFrame


def reversal_alphas(panel: DataFrame, window_size: int = 21) -> DataFrame:
    """Rows with an alpha: ``reversal``, its ``score`` per date, and the score over the risk in percent as
    ``reversal_alpha``; ``specific_risk`` leaves as a decimal.

    ``panel`` has decimal returns and risk in percent. The window is evaluated once, while the frame is written.
    """
    signal = written(compute_str(panel, "reversal", {"window_size": window_size}), "reversal")
    scored = standardise(signal, "reversal", "score")
    return (scored.withColumn("reversal_alpha", alpha_divisive("score"))
            .withColumn("specific_risk", col("specific_risk") / 100).where(col("reversal_alpha").isNotNull()))


def reversal_study(panel: DataFrame, screen: dict, window_size: int = 21, gamma: float = 10,
                   constraints: Iterable[str] = CONSTRAINTS, periods_per_year: int = 252) -> dict[str, Study]:
    """``all`` and ``quality``: the same backtest on every row with an alpha, and on those that pass
    ``quality_screen`` with the arguments ``screen``. Both are paid from the whole panel."""
    alphas = written(reversal_alphas(panel, window_size), "reversal-alphas")
    universes = {"all": alphas, "quality": quality_screen(alphas, required=("reversal",), **screen)}

    def study(name: str, rows: DataFrame) -> Study:
        weights = written(run_mvo_backtest(rows, "reversal", constraints, gamma), f"reversal-weights-{name}")
        returns = written(generate_returns_from_weights(weights, panel, portfolio=name), f"reversal-returns-{name}")
        return Study(weights, returns, performance_summary(returns, periods_per_year))

    return {name: study(name, rows) for name, rows in universes.items()}
