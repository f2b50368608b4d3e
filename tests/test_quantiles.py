from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelquant.operators.histogram import histogram
from panelquant.operators.quantiles import exact_quantiles, quantile_bucket
from tests.conftest import day

PROBS = [0.0, 0.02, 0.2, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    shapes = {
        "2023-01-01": [rng.gauss(0, 1) for _ in range(5000)],
        "2023-01-02": [rng.choice([-1.0, 0.0, 0.0, 2.0]) for _ in range(777)],
        "2023-01-03": [rng.lognormvariate(0, 12) * rng.choice([-1, 1]) for _ in range(999)],
        "2023-01-04": [1.0 + k * 2.0 ** -52 for k in range(64)],
        "2023-01-05": [4.0],
        "2023-01-06": [None, float("nan"), 1.0, 2.0, None],
        "2023-01-07": [None],
    }
    rows = [(day(d), x) for d, xs in shapes.items() for x in xs]
    return spark.createDataFrame(rows, "date date, x double").repartition(7).cache()


def test_quantiles_equal_percentile_to_the_last_bit(values):
    got = {r["date"]: list(r["quantiles"]) for r in exact_quantiles(values, "x", PROBS).collect()}
    want = (values.where("x IS NOT NULL AND NOT isnan(x)").groupBy("date")
            .agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect())
    assert got == {r["date"]: list(r["q"]) for r in want}
    assert len(got) == 6


def test_no_window_sees_a_whole_date(values):
    """The only exchange keyed by date alone carries counts of coarse bins, not values."""
    df = exact_quantiles(values, "x", [0.5])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4
    assert all("medium" in w or "coarse" in w or "total" in w for w in windows)


def test_buckets_are_closed_on_the_right(spark):
    rows = [(day("2023-01-01"), float(x)) for x in range(11)] + [(day("2023-01-01"), None)]
    out = quantile_bucket(spark.createDataFrame(rows, "date date, x double"), "x").collect()
    bucket = {r["x"]: r["quantile"] for r in out}
    assert bucket == {None: None, 0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 3, 8: 3, 9: 4,
                      10: 4}
    assert len(out) == 12


def test_ties_share_a_bucket_and_may_leave_buckets_empty(spark):
    rows = [(day("2023-01-01"), x) for x in (1.0,) * 8 + (2.0, 3.0)]
    out = quantile_bucket(spark.createDataFrame(rows, "date date, x double"), "x").collect()
    assert {r["x"]: r["quantile"] for r in out if r["x"] == 1.0} == {1.0: 0}
    assert {r["quantile"] for r in out} == {0, 4}


@pytest.mark.parametrize("seed, bins", [(0, 50), (1, 7), (2, 1)])
def test_histogram_counts_like_numpy(spark, seed, bins):
    rng = np.random.default_rng(seed)
    xs = np.concatenate([rng.normal(size=500), np.linspace(-1, 1, 51), [0.1, 0.2, 0.3]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    got = histogram(df, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram(xs, bins=bins)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["bin_left"] for r in got] == pytest.approx(edges[:-1].tolist())
    assert [r["bin_right"] for r in got] == pytest.approx(edges[1:].tolist())


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    got = histogram(df, "x", 50).orderBy("bin").collect()
    counts, _ = np.histogram([2.0] * 3, bins=50)
    assert [r["count"] for r in got] == counts.tolist()
    assert histogram(df.where("x > 5"), "x").count() == 0
