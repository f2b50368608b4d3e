"""Checks made while a panel is written, tables by asset, and histories dealt in chunks."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from panelquant.operators import rolling
from panelquant.operators.signals import compute_alphas
from panelquant.operators.validation import observed, report
from panelquant.sources.panel import read_by_asset, write_by_asset
from panelquant.session import remove_scratch, scratch_path, written
from tests.conftest import day

SCHEMA = "date date, barrid string, `return` double, specific_risk double"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def check(df, path):
    return write_by_asset(df, str(path), 4)


def test_good_panel_with_holes(spark, tmp_path):
    df = spark.createDataFrame([(day("2022-05-02"), "A", .1, .2), (day("2022-05-03"), "A", None, .2),
                                (day("2022-05-02"), "B", float("nan"), None)], SCHEMA)
    seen = check(df, tmp_path / "t")
    assert seen.ok and (seen.rows, seen.repeated, seen.placeholders, seen.missing) == (3, 0, 0, ())
    assert seen.nulls == {"date": 0, "barrid": 0, "return": 2, "specific_risk": 1}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("date", "barrid").collect())) == sorted(
        (r["date"], r["barrid"]) for r in df.collect())


@pytest.mark.parametrize("rows, wrong", [
    ([], "rows"), ([("2022-05-02", "A"), ("2022-05-02", "A")], "repeated"), ([("2022-05-02", " - ")], "placeholders"),
    ([("2022-05-02", None)], "nulls"), ([(None, "A")], "nulls")])
def test_unusable_panels(spark, tmp_path, rows, wrong):
    df = spark.createDataFrame([(d and day(d), b, .1, .2) for d, b in rows], SCHEMA)
    seen = check(df, tmp_path / "t")
    assert not seen.ok
    assert {"rows": seen.rows == 0, "repeated": seen.repeated == 1, "placeholders": seen.placeholders == 1,
            "nulls": sum(seen.nulls.values()) == 1}[wrong]


def test_missing_columns_are_reported(spark, tmp_path):
    df = spark.createDataFrame([(day("2022-05-02"), "A", .1)], "date date, barrid string, `return` double")
    seen = check(df, tmp_path / "t")
    assert not seen.ok and seen.missing == ("specific_risk",) and seen.rows == 1
    frame, observation, missing = observed(df.drop("barrid"))
    assert not report(observation, missing).ok and missing == ("barrid", "specific_risk") and frame.count() == 1


def test_alphas_of_a_table_by_asset_move_nothing_by_asset(spark, tmp_path):
    rows = [(day("2022-05-02") + dt.timedelta(d), f"US{a}", .01 * ((7 * d + a) % 5 - 2), .1 + a / 100)
            for a in range(12) for d in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    write_by_asset(df, str(tmp_path / "t"), 4)
    table = read_by_asset(spark, str(tmp_path / "t"), 4)
    signal = {"name": "s", "type": "str", "window_size": 5}
    found = compute_alphas(table, signal)
    assert not re.search(r"Exchange hashpartitioning\(barrid", plan_of(found))
    assert re.search(r"Exchange hashpartitioning\(barrid", plan_of(compute_alphas(df, signal)))
    key = ("date", "barrid")
    assert {tuple(r[k] for k in key): r["s_alpha"] for r in found.collect()} == pytest.approx(
        {tuple(r[k] for k in key): r["s_alpha"] for r in compute_alphas(df, signal).collect()})


def test_a_stored_signal_is_evaluated_once(spark):
    df = spark.createDataFrame([(day("2022-05-02"), "A", .1, .2)], SCHEMA)
    signal = {"name": "s", "type": "str", "window_size": 5}
    assert "Window [" in plan_of(compute_alphas(df, signal))
    assert "Window [" not in plan_of(compute_alphas(df, signal, stored=True))


@pytest.mark.parametrize("chunk_rows", [7, 64, 4096])
def test_chunked_windows_equal_plain_ones(spark, chunk_rows):
    """One asset holds half of all rows; values are compared to the last bit."""
    start = day("1990-01-01")
    rows = [(start + dt.timedelta(3 * i), "LONG", ((i * 37) % 101) / 7 if i % 11 else None, 1.0) for i in range(1500)]
    rows += [(start + dt.timedelta(400 * (i % 5) + i), f"S{i % 300}", i / 3, 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spec = {"total": (F.sum, "return", 7, 5), "mean": (F.avg, "return", 3, None), "spread": (F.stddev_samp, "return", 6, 2)}
    plain = df.withColumns({"total": rolling.rolling_sum("return", 7, 5), "mean": rolling.rolling_mean("return", 3),
                            "spread": rolling.rolling_std("return", 6, 2)})
    made = rolling.chunked(df, spec, chunk_rows)
    assert made.columns == plain.columns
    assert sorted(map(repr, made.collect())) == sorted(map(repr, plain.collect()))
    with pytest.raises(ValueError, match="too short"):
        rolling.chunked(df, spec, 6)


def test_scratch_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("panelquant.session.shared_dir", lambda _: str(tmp_path))
    assert written(spark.range(3), "numbers").count() == 3
    other = tmp_path / "panelquant" / "another-application"
    other.mkdir()
    assert scratch_path(spark, "x").startswith(str(tmp_path)) and len(list((tmp_path / "panelquant").iterdir())) == 2
    remove_scratch(spark)
    assert [p.name for p in (tmp_path / "panelquant").iterdir()] == ["another-application"]
