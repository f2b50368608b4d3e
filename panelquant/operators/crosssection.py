"""Per-date standardisation and alphas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.functions.columns import col, divide
from panelquant.operators.perdate import join_by_date


def standardise(df: DataFrame, value: str, out: str, by: str = "date") -> DataFrame:
    """``(x - mean) / sample std`` per date.

    The two statistics are pre-aggregated on the map side and joined back, instead of a window
    that would move the whole panel and put all rows of one date into one task.
    """
    stats = df.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return (join_by_date(df, stats, by=by)
            .withColumn(out, divide(col(value) - col("_mean"), col("_std")))
            .drop("_mean", "_std"))


def alpha(score: str, risk: str = "specific_risk") -> Column:
    return col(score) * col(risk)


def alpha_divisive(score: str, risk: str = "specific_risk") -> Column:
    return divide(col(score), col(risk))


def recover_zscore(df: DataFrame, alpha_name: str, risk: str = "specific_risk",
                   out: str = "zscore") -> DataFrame:
    return df.withColumn(out, divide(col(alpha_name), col(risk))).where(col(out).isNotNull())
