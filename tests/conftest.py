from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelquant.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


RAW_SCHEMA = ("date date, barrid string, rootid string, iso_country_code string, "
              "`return` double, specific_return double, specific_risk double, "
              "daily_volume bigint, price double, market_cap double")


@pytest.fixture
def raw_panel(spark):
    return spark.createDataFrame([
        (day("2021-06-14"), "USK1", "USK1", "USA", 3.0, 2.0, 8.0, 700, 12.0, 4e8),
        (day("2021-06-14"), "GBM4", "GBM4", "GBR", -1.2, -.9, 20.0, 0, 7.0, 3e9),
        (day("2021-06-15"), "USQ8", "USQ8", "USA", .6, .8, 6.0, 90, 31.0, 9e8),
        (day("2021-06-15"), "USZ5", "USZ5", "USA", -2.5, -2.0, 12.0, 40, 3.0, 6e7),
    ], RAW_SCHEMA)
