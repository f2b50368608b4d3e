"""Reading and writing the asset panel and the job's results as Parquet."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelquant.functions.columns import add_missing_columns, col, nan_to_null
from panelquant.operators.filters import row_predicates, where_all
from panelquant.operators.validation import Report, observed, report

UNIVERSE_COLUMN = "in_universe"

#: The names and types of the panel's columns.
PANEL_TYPES = {
    "date": "date", "rootid": "string", "barrid": "string", "issuerid": "string",
    "instrument": "string", "name": "string", "cusip": "string", "ticker": "string",
    "price": "double", "return": "double", "specific_return": "double", "market_cap": "double",
    "price_source": "string", "currency": "string", "iso_country_code": "string",
    "iso_currency_code": "string", "yield": "double", "total_risk": "double",
    "specific_risk": "double", "historical_beta": "double", "predicted_beta": "double",
    "russell_1000": "boolean", "russell_2000": "boolean", "daily_volume": "double",
    "average_daily_volume_30": "double", "average_daily_volume_60": "double",
    "average_daily_volume_90": "double", "bid_ask_spread": "double",
    "average_daily_bid_ask_spread_30": "double", "average_daily_bid_ask_spread_60": "double",
    "average_daily_bid_ask_spread_90": "double",
}

PANEL_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in PANEL_TYPES.items())


def select_assets(df: DataFrame, start, end, in_universe: bool = False,
                  columns: Sequence[str] | None = None, filters: Iterable[dict] | None = None,
                  missing_as_null: bool = False) -> DataFrame:
    """Date range (both ends included), universe membership and column choice.

    ``filters`` are applied to the raw columns here, so that they reach the Parquet reader;
    NaN passes ``>=`` and is turned into NULL afterwards, so the same filters have to be applied
    again downstream, where they are free.
    """
    bounds = [F.lit(b).cast("date") for b in (start, end)]
    df = df.where(col("date").between(*bounds))
    if "year" in df.columns:
        years = [F.year(b) for b in bounds]
        df = df.where(col("year").between(*years))
    if in_universe:
        df = df.where(universe_member(df))
    if filters is not None:
        df = where_all(df, row_predicates(filters))
    if columns is not None:
        if missing_as_null:
            df = add_missing_columns(df, {c: PANEL_TYPES.get(c, "double") for c in columns})
        df = df.select(*[col(c) for c in columns])
    return nan_to_null(df)


def universe_member(df: DataFrame) -> Column:
    """The membership flag, or either of the two index flags."""
    if UNIVERSE_COLUMN in df.columns:
        return col(UNIVERSE_COLUMN)
    return F.coalesce(col("russell_1000"), F.lit(False)) | F.coalesce(
        col("russell_2000"), F.lit(False))


def load_assets(spark: SparkSession, path: str, start, end, in_universe: bool = False,
                columns: Sequence[str] | None = None, filters: Iterable[dict] | None = None,
                missing_as_null: bool = False) -> DataFrame:
    return select_assets(spark.read.parquet(path), start, end, in_universe, columns, filters,
                         missing_as_null)


def load_assets_by_date(spark: SparkSession, path: str, date, in_universe: bool = False,
                        columns: Sequence[str] | None = None) -> DataFrame:
    return load_assets(spark, path, date, date, in_universe, columns)


def parse_date(text: str | dt.date) -> dt.date:
    return dt.datetime.strptime(text, "%Y-%m-%d").date() if isinstance(text, str) else text


def write_by_year(df: DataFrame, path: str, only_years: bool = False) -> None:
    """Overwrites ``path`` with one folder per year; with ``only_years`` just the years that ``df`` has rows of.

    Rows are rebalanced by year: the adaptive planner splits years that are large and merges
    small ones, so files have a sensible size at any scale and no task writes a whole large year.
    Rows are sorted by asset and date inside each file.
    """
    dated = df.withColumn("year", F.year("date")).hint("rebalance", col("year"))
    order = [c for c in ("year", "barrid", "date") if c in dated.columns]
    (dated.sortWithinPartitions(*order).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic" if only_years else "static").partitionBy("year").parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_asset(df: DataFrame, path: str, buckets: int) -> Report:
    """The panel as a table bucketed by asset and sorted by asset and date, checked on the way.

    Rolling windows, lags and alphas over such a table need no exchange. Every bucket is one file, so
    ``buckets`` should grow with the panel; an asset has at most one row per date, so no bucket is much larger
    than the others. The check uses the same exchange.
    """
    checked, observation, missing = observed(df.repartition(buckets, "barrid"))
    (checked.sortWithinPartitions("barrid", "date").write.format("parquet").mode("overwrite")
     .bucketBy(buckets, "barrid").sortBy("barrid", "date").option("path", path)
     .saveAsTable(f"by_asset_{uuid.uuid4().hex}"))
    return report(observation, missing)


def read_by_asset(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table that ``write_by_asset`` wrote, in this or another session, known to be bucketed."""
    name = f"by_asset_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
              f"CLUSTERED BY (barrid) SORTED BY (barrid, date) INTO {int(buckets)} BUCKETS")
    return spark.table(name)
