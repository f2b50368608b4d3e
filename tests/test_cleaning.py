from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelquant.functions.columns import (add_missing_columns, nan_to_null, parse_number,
                                          strip_suffix)
from panelquant.operators.filters import (apply_filters, prepare_data, row_counts, validate_data)
from tests.conftest import RAW_SCHEMA, day


def by_asset(df, column):
    return {r["barrid"]: r[column] for r in df.collect()}


def test_percent_columns_become_decimals(raw_panel):
    out = prepare_data(raw_panel, {"replace_zero_volume": False})
    assert by_asset(out, "return") == pytest.approx(
        {"USK1": .03, "GBM4": -.012, "USQ8": .006, "USZ5": -.025})
    assert by_asset(out, "specific_risk") == pytest.approx(
        {"USK1": .08, "GBM4": .2, "USQ8": .06, "USZ5": .12})
    assert by_asset(out, "specific_return")["USQ8"] == pytest.approx(.008)
    assert by_asset(out, "daily_volume")["GBM4"] == 0
    assert out.columns == raw_panel.columns


def test_zero_volume_becomes_null(raw_panel):
    out = prepare_data(raw_panel, {"convert_returns_to_decimal": False})
    assert by_asset(out, "daily_volume") == {"USK1": 700, "GBM4": None, "USQ8": 90, "USZ5": 40}
    assert by_asset(out, "return")["USK1"] == 3.0


def test_both_cleaning_steps_are_on_by_default(raw_panel):
    out = prepare_data(raw_panel)
    assert by_asset(out, "return")["USZ5"] == pytest.approx(-.025)
    assert by_asset(out, "daily_volume")["GBM4"] is None


@pytest.mark.parametrize("spec, kept", [
    ({}, 3),
    ({"usa_only": False}, 4),
    ({"min_price": 12.5}, 1),
    ({"min_price": 0}, 3),
    ({"min_market_cap": 5e8}, 1),
    ({"usa_only": False, "min_price": 7.0, "min_market_cap": 4e8}, 3),
    ({"unknown_key": 1}, 3),
])
def test_filters(raw_panel, spec, kept):
    assert apply_filters(raw_panel, [spec]).count() == kept


def test_no_filters_keep_everything(raw_panel):
    assert apply_filters(raw_panel, []).count() == 4


def test_conditions_of_several_dicts_are_combined(raw_panel):
    specs = [{"usa_only": False, "min_price": 10.0}, {"usa_only": False, "min_market_cap": 5e8}]
    assert [r["barrid"] for r in apply_filters(raw_panel, specs).collect()] == ["USQ8"]


def test_missing_returns_and_risks_are_dropped(raw_panel):
    holes = raw_panel.withColumn("return", F.when(F.col("barrid") != "USK1", F.col("return")))
    assert apply_filters(holes, [{"usa_only": False}]).count() == 3
    assert apply_filters(holes, [{"usa_only": False, "require_returns": False}]).count() == 4
    risk = raw_panel.withColumn("specific_risk", F.lit(None).cast("double"))
    assert apply_filters(risk, [{"usa_only": False}]).count() == 0
    assert apply_filters(risk, [{"usa_only": False, "require_specific_risk": False}]).count() == 4


def test_root_and_prefix_belong_to_the_domestic_filter(spark):
    rows = [(day("2023-01-01"), b, r, "USA", 1., 1., 1., 1, 1., 1.)
            for b, r in (("US1", "US1"), ("US2", "US1"), ("XX3", "XX3"))]
    panel = spark.createDataFrame(rows, RAW_SCHEMA)
    assert [r["barrid"] for r in apply_filters(panel, [{}]).collect()] == ["US1"]


def test_validation(spark, raw_panel):
    assert validate_data(raw_panel) is True
    assert validate_data(raw_panel.where("price < 0")) is False
    assert validate_data(spark.createDataFrame([], "date date, barrid string")) is False
    assert validate_data(raw_panel.drop("specific_risk")) is False


def test_row_counts(raw_panel):
    row = row_counts(raw_panel, [{"min_price": 15.0}]).first()
    assert (row["rows_loaded"], row["rows_kept"]) == (4, 1)


def test_nan_and_infinity_become_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.5, 3)], "x double, k int")
    assert {r["k"]: r["x"] for r in nan_to_null(df).collect()} == {1: None, 2: None, 3: 2.5}


def test_absent_columns_are_added_as_typed_nulls(raw_panel):
    out = add_missing_columns(raw_panel, {"yield": "double", "price": "double"})
    assert dict(out.dtypes)["yield"] == "double"
    assert out.where("yield IS NOT NULL").count() == 0
    with pytest.raises(AnalysisException):
        raw_panel.select("yield")


@pytest.mark.parametrize("text, number", [
    ("$2,190,989", 2190989.0), ("-$1,156", -1156.0), ("-", None), ("", None), ("1.25", 1.25),
    ("$|,7", 7.0), ("n/a", None), (" 12 ", 12.0)])
def test_numbers_from_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_number("t").alias("n")).first()["n"] == number


@pytest.mark.parametrize("text, stripped", [
    ("NVDA US", "NVDA"), ("US", "US"), ("A US US", "A US"), ("BUS", "BUS"), ("X US B", "X US B")])
def test_only_a_trailing_suffix_goes(spark, text, stripped):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip_suffix("t").alias("s")).first()["s"] == stripped
