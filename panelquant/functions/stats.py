"""Aggregate expressions that follow one rule for degenerate groups: NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelquant.functions.columns import col, divide


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of the rows where both are present; NULL if either is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    xs, ys = F.when(both, col(x)), F.when(both, col(y))
    return divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def regression_beta(y: str | Column, x: str | Column) -> Column:
    both = col(x).isNotNull() & col(y).isNotNull()
    xs, ys = F.when(both, col(x)), F.when(both, col(y))
    return divide(F.covar_samp(ys, xs), F.var_samp(xs))
