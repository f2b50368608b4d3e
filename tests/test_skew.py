"""One date holds a third of all rows; one asset has by far the longest history."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelquant.operators.crosssection import standardise
from panelquant.operators.quantiles import exact_quantiles
from panelquant.operators.signals import compute_alphas
from panelquant.sources.panel import write_by_year
from tests.conftest import day


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(4)
    rows = [(day("2023-01-02"), f"A{i:05d}", rng.gauss(0, 1)) for i in range(6000)]
    rows += [(day(f"2023-01-{d:02d}"), f"A{i:05d}", rng.gauss(0, 1))
             for d in range(3, 27) for i in range(500)]
    return spark.createDataFrame(rows, "date date, barrid string, x double").repartition(8).cache()


def test_statistics_of_the_crowded_date(crowded):
    by_date = {}
    for r in crowded.collect():
        by_date.setdefault(r["date"], []).append(r["x"])
    scored = standardise(crowded, "x", "z")
    assert scored.count() == crowded.count()
    sums = {r["date"]: r for r in scored.groupBy("date")
            .agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()}
    medians = {r["date"]: r["quantiles"][0]
               for r in exact_quantiles(crowded, "x", [.5]).collect()}
    for date, xs in by_date.items():
        assert sums[date]["m"] == pytest.approx(0, abs=1e-9)
        assert sums[date]["s"] == pytest.approx(1)
        assert medians[date] == pytest.approx(statistics.median(xs))


def test_rows_are_not_gathered_by_date(crowded):
    """Only sums per date are exchanged by date; the rows stay where they are."""
    plan = standardise(crowded, "x", "z")._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange hashpartitioning(date")
    assert "partial_avg" in after and "Exchange hashpartitioning(date" not in after
    assert "BroadcastHashJoin" in before and "Window" not in plan


def test_a_key_that_is_not_a_date_is_not_broadcast_by_hint(crowded):
    stamped = crowded.withColumn("date", F.col("date").cast("timestamp"))
    plan = standardise(stamped, "x", "z")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan
    assert standardise(stamped, "x", "z").where("z IS NULL").count() == 0


def test_a_large_year_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "panel")
    panel = spark.range(0, 200_000, 1, 16).selectExpr(
        "date_add(DATE'2020-01-01', cast(id % 300 AS int)) AS date",
        "concat('US', cast(id % 5000 AS string)) AS barrid", "rand(1) AS price")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        write_by_year(panel, path)
    finally:
        spark.conf.set(key, before)
    written = spark.read.parquet(path)
    assert written.count() == 200_000
    assert written.select(F.input_file_name()).distinct().count() > 4


def test_a_long_history_beside_short_ones(spark):
    rng = random.Random(9)
    rows = [(day("2000-01-01"), "LONG", i, rng.uniform(-.1, .1)) for i in range(3000)]
    rows += [(day("2000-01-01"), f"S{k}", i, rng.uniform(-.1, .1))
             for k in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "start date, barrid string, i int, `return` double").select(
        F.date_add("start", F.col("i")).alias("date"), "barrid", "return",
        F.lit(1.0).alias("specific_risk"))
    out = compute_alphas(df, {"name": "s", "type": "return_vol", "window_size": 22})
    long = [r for r in out.where("barrid = 'LONG'").orderBy("date").collect()]
    assert len(long) == 3000 and long[20]["s"] is None
    for k in (21, 22, 1500, 2999):
        assert long[k]["s"] == pytest.approx(
            statistics.stdev(r["return"] for r in long[k - 21:k + 1]))
