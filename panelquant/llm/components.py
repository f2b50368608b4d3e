"""Connected components of links by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelquant.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, component: each linked id with the smallest id reachable from it.

    ``edges`` has two id columns. Each round joins every id's larger neighbours (large star), then
    its smaller ones (small star), to the least id around it; the number of rounds grows with the
    logarithm of the longest path. An id's neighbours are only grouped to find their least, which
    is combined before the shuffle, and joined back, which may be split, so that an id linked to
    very many others is no single task's load. Each round is written to the shared folder; only
    two sums come to the driver. The rounds end with one that changes nothing, so links that are
    contracted already take one.
    """
    a, b = edges.columns
    now = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(),
                  name)
    seen = _state(now)
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u is linked to the least id around u.
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select("m", "v")
        # Small star on the result: of what v is linked to, all is linked to the least.
        down = large.unionByName(least.where("m < u").select("m", F.col("u").alias("v"))).where("m < v").distinct()
        lowest = down.groupBy("v").agg(F.min("m").alias("l"))
        small = down.join(lowest, "v").select(F.col("l").alias("lo"), F.col("m").alias("hi")).where("lo < hi").unionByName(
            lowest.select(F.col("l").alias("lo"), F.col("v").alias("hi")))
        now = written(small.distinct(), name)
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _state(now: DataFrame) -> tuple:
    """The number of links and the sum of their hashes."""
    return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
