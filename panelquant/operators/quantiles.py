"""Exact per-group quantiles without ever sorting a whole group in one task.

``percentile`` keeps all distinct values of a group in the memory of one task. Here the order
statistics are found by counting instead: values are rounded to few significant bits, counted
per rounded value, and only the bins that contain a wanted rank are opened at the next, finer
precision. Rounding is monotone, so the bins are ordered like the values, and it depends on
the value alone, so recomputing a lost partition gives the same bins. A bin opened at one
precision holds at most 2**21 distinct finer values, and the first precision has fewer than
2**23 bins in all, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelquant.functions.columns import col, finite
from panelquant.operators.perdate import join_by_date, small_by_date

# Significant bits kept at each step; the last step uses the values themselves.
COARSE_BITS, MEDIUM_BITS = 11, 32


def _round_bits(value: Column, bits: int) -> Column:
    """Nearest double with ``bits`` significant bits (Dekker's splitting)."""
    scaled = value * F.lit(float(2 ** (53 - bits) + 1))
    return scaled - (scaled - value)


def _placed(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the rank after the last row of every bin, counted from ``first`` of the outer bin."""
    frame = (Window.partitionBy(*keys).orderBy(value)
             .rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("last", F.expr("first") + F.sum("n").over(frame))


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    by: str | Sequence[str] = "date", out: str = "quantiles") -> DataFrame:
    """One row per ``by`` with an array of linearly interpolated quantiles.

    The positions are ``q * (n - 1)`` as in ``percentile`` / ``quantile_cont``. Missing values
    are ignored; groups without values do not appear. Behind a date, ``by`` may name columns of a
    fixed number of values, such as the kind of a measure.
    """
    by = [by] if isinstance(by, str) else list(by)
    # The three levels read one shuffled table of counts. Non-nullable keys keep the optimizer
    # from adding null checks to single branches, which would make it three tables. Coarse bins are
    # few, so they are counted before their shuffle; finer bins are formed only inside those opened.
    known = df.select(*by, finite(value).alias("x")).where(col("x").isNotNull())
    for key in by:
        known = known.where(col(key).isNotNull())
    exact = (known.select(*by, F.coalesce("x", F.lit(0.0)).alias("x"))
             .groupBy(*by, "x").agg(F.count("*").alias("n"))
             .withColumn("medium", _round_bits(col("x"), MEDIUM_BITS))
             .withColumn("coarse", _round_bits(col("medium"), COARSE_BITS)))
    coarse = exact.groupBy(*by, "coarse").agg(F.sum("n").alias("n"))

    places = [f"(double({float(q)!r}) * (total - 1))" for q in probs]
    ranks = [f"{side}{place}" for place in places for side in ("floor", "ceil")]
    wanted = " OR ".join(f"({r} >= last - n AND {r} < last)" for r in dict.fromkeys(ranks))

    def opened(placed: DataFrame, bin_name: str) -> DataFrame:
        """The bins with a wanted rank: at most two per quantile and group."""
        return placed.where(wanted).selectExpr(*by, bin_name, "last - n AS first", "total")

    total = F.sum("n").over(Window.partitionBy(*by))
    hit = opened(_placed(coarse.select("*", total.alias("total"), F.lit(0).alias("first")),
                         by, "coarse"), "coarse")
    inner = (exact.join(small_by_date(hit, by[0]), [*by, "coarse"])
             .groupBy(*by, "coarse", "medium", "first", "total").agg(F.sum("n").alias("n")))
    hit = opened(_placed(inner, [*by, "coarse"], "medium"), "medium")
    found = (_placed(exact.join(small_by_date(hit, by[0]), [*by, "medium"]), [*by, "medium"], "x")
             .where(wanted).groupBy(*by, "total")
             .agg(*[F.expr(f"max(CASE WHEN {r} >= last - n AND {r} < last THEN x END)")
                    .alias(f"x{k}") for k, r in enumerate(ranks)]))
    # The arithmetic of ``percentile``, to the last bit.
    values = [f"CASE WHEN x{2 * k} = x{2 * k + 1} THEN x{2 * k} ELSE (ceil{p} - {p}) * x{2 * k}"
              f" + ({p} - floor{p}) * x{2 * k + 1} END" for k, p in enumerate(places)]
    return found.selectExpr(*by, f"array({', '.join(values)}) AS {out}")


def quantile_bucket(df: DataFrame, value: str, buckets: int = 5, by: str = "date",
                    out: str = "quantile") -> DataFrame:
    """Bucket 0 .. buckets-1 per group; bins are closed on the right, NULL stays NULL."""
    probs = [k / buckets for k in range(1, buckets)]
    edges = exact_quantiles(df, value, probs, by, "_edges")
    above = [(col(value) > F.get("_edges", F.lit(k))).cast("int") for k in range(buckets - 1)]
    bucket = above[0]
    for term in above[1:]:
        bucket = bucket + term
    return join_by_date(df, edges, by=by).withColumn(out, bucket).drop("_edges")
