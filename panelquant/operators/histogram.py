"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelquant.functions.columns import col, finite


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``bin, bin_left, bin_right, count`` for all bins, empty ones included.

    Bins are half-open except the last. Bounds are a one-row scalar subquery and the counts are
    combined on the map side, so at most ``bins`` rows per task are shuffled. A constant column
    gets a range of width one around its value.
    """
    data = df.select(finite(value).alias("x")).where("x IS NOT NULL")
    low, high = F.min("x"), F.max("x")
    half = F.when(low == high, 0.5).otherwise(0.0)
    bounds = data.agg(F.struct((low - half).alias("lo"), (high + half).alias("hi")).alias("b"))
    bound = bounds.scalar()
    lo, hi = bound.getField("lo"), bound.getField("hi")

    def edge(i):
        return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))

    guess = F.least(F.floor((col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    placed = data.withColumn("bin", guess.cast("bigint"))
    # The division may be off by one at an edge; the edges themselves decide.
    placed = placed.withColumn(
        "bin", F.when(col("x") < edge(col("bin")), col("bin") - 1)
        .when((col("x") >= edge(col("bin") + 1)) & (col("bin") < bins - 1), col("bin") + 1)
        .otherwise(col("bin")))
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))
    # The list of bins has a fixed size.
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (all_bins.join(F.broadcast(counts), "bin", "left")
            .select("bin", edge(col("bin")).alias("bin_left"),
                    edge(col("bin") + 1).alias("bin_right"),
                    F.coalesce("count", F.lit(0)).alias("count"))
            .where(lo.isNotNull()))
