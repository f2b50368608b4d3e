"""Holdings files: CSV with a preamble, CSV with footer prose, JSON responses.

Such a file describes one fund and is small; many files are read in parallel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelquant.functions.columns import col, parse_number, strip_suffix

# Column names given by position.
PREAMBLE_COLUMNS = (
    "underlying_security", "ticker", "cusip", "underlying_security_type", "strike_price",
    "quantity", "notional_value", "market_value", "weight_percent", "current_market_value",
)
FOOTER_COLUMNS = (
    "ticker", "name", "sector", "asset_class", "market_value", "weight_percent",
    "notional_value", "shares", "price", "location", "exchange", "currency", "fx_rate",
    "market_currency", "accrual_date",
)


def _read_text_csv(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"')
    # A CRLF file leaves the carriage return in the last field, a BOM stays in the first.
    return df.select(*[F.regexp_replace(col(n), "[\r\ufeff]", "").alias(n) for n in names])


def _weight(percent: str | Column) -> Column:
    return F.trim(percent).try_cast("double") / 100


def clean_preamble_holdings(raw: DataFrame) -> DataFrame:
    """Numbers from text, tickers without their suffix, header, blank and cash rows removed.

    The rows a position-based cut would drop (the header record, the blank record, zero weights
    and cash) are recognised by their content, so the file may have any number of holdings. Cash
    is a bare currency code as ticker with the provider's own number in place of a security's.
    """
    cash = F.coalesce(col("ticker").rlike("^[A-Z]{3}$") & col("cusip").contains("_"), F.lit(False))
    cleaned = raw.where(~cash).select(
        "underlying_security", strip_suffix("ticker").alias("ticker"), "cusip",
        "underlying_security_type", "strike_price",
        F.replace(col("quantity"), F.lit(","), F.lit("")).try_cast("bigint").alias("quantity"),
        parse_number("notional_value").alias("notional_value"),
        parse_number("market_value").alias("market_value"),
        parse_number("current_market_value").alias("current_market_value"),
        _weight(col("weight_percent")).alias("weight_decimal"))
    return cleaned.where(
        (col("ticker") != "") & (col("weight_decimal") != 0))


def clean_footer_holdings(raw: DataFrame) -> DataFrame:
    """``ticker, weight`` and the other text columns; prose has no numeric weight."""
    weight = _weight(col("weight_percent"))
    return (raw.withColumn("weight", weight)
            .where(col("weight").isNotNull() & ~F.isnan("weight"))
            .where(col("ticker") != "").drop("weight_percent"))


def read_preamble_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_preamble_holdings(_read_text_csv(spark, path, PREAMBLE_COLUMNS))


def read_footer_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_footer_holdings(_read_text_csv(spark, path, FOOTER_COLUMNS))


def read_holdings_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``ticker, shares, price`` of the records under ``holdings``."""
    schema = "holdings array<struct<ticker: string, shares: double, price: double>>"
    return (spark.read.schema(schema).json(path, multiLine=multi_line)
            .select(F.explode("holdings").alias("h")).select("h.*"))


# --- many files in one read --------------------------------------------------------------------

#: Fund and date in a file's name, or in that of the folder that holds its parts: ``FUND_2001-10-29``.
_FUND_AND_DATE = r"/([^/]+)_(\d{4}-\d{2}-\d{2})(?:\.[A-Za-z]+)?(?:/[^/]*)?$"
#: Names in a header by which columns are known, in lower case.
HEADER_NAMES = {
    "ticker": ("ticker", "symbol"),
    "market_value": ("market value", "market", "notional value"),
    "weight_percent": ("weight (%)", "weight %", "weight"),
}


def fund_and_date() -> list[Column]:
    """``fund`` and ``as_of`` of the file a row comes from; NULL where its path does not tell them."""
    path = F.col("_metadata.file_path")
    found = [F.nullif(F.regexp_extract(path, _FUND_AND_DATE, k), F.lit("")) for k in (1, 2)]
    return [found[0].alias("fund"), found[1].try_cast("date").alias("as_of")]


def read_many_csv(spark: SparkSession, path: str, names: dict[str, tuple[str, ...]] | None = None,
                  width: int = 32) -> DataFrame:
    """``fund, as_of, ticker, market_value, weight`` from any number of CSV files, each with a header of its own.

    A file's header is the record that names every wanted column; what stands before it or has no weight
    behind it is left out, and columns are taken by the header's order. So files of several funds and layouts
    need one read. Files without such a record give no rows.
    """
    names = names or HEADER_NAMES
    schema = ", ".join(f"c{k} string" for k in range(width))
    raw = spark.read.csv(path, schema=schema, header=False, multiLine=True, quote='"', escape='"')
    cells = F.transform(F.array(*[f"c{k}" for k in range(width)]),
                        lambda x: F.trim(F.regexp_replace(x, "[\r﻿]", "")))
    rows = raw.select(F.col("_metadata.file_path").alias("file"), *fund_and_date(), cells.alias("cells"))

    def place(known: tuple[str, ...]) -> Column:
        lowered = F.transform("cells", F.lower)
        return F.coalesce(*[F.nullif(F.array_position(lowered, F.lit(x)), F.lit(0)) for x in known])

    placed = rows.withColumns({f"at_{name}": place(known).cast("int") for name, known in names.items()})
    header = reduce(lambda a, b: a & b, [col(f"at_{name}").isNotNull() for name in names])
    places = F.struct(*[f"at_{name}" for name in names])
    # One row per file.
    headers = placed.where(header).groupBy("file").agg(F.min(places).alias("places"))
    found = placed.where(~header).join(headers, "file").select(
        "fund", "as_of", *[F.get("cells", F.col(f"places.at_{name}") - 1).alias(name) for name in names])
    cash = F.coalesce(col("ticker").rlike("^[A-Z]{3}$") & (col("weight") < 0), F.lit(False))
    weighed = found.withColumn("weight", _weight(col("weight_percent")))
    return (weighed.where(col("weight").isNotNull() & ~F.isnan("weight") & (col("weight") != 0))
            .withColumn("ticker", strip_suffix("ticker")).where((col("ticker") != "") & ~cash)
            .select("fund", "as_of", "ticker", parse_number("market_value").alias("market_value"), "weight"))


def read_many_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``fund, as_of, ticker, shares, price`` from any number of responses."""
    schema = "holdings array<struct<ticker: string, shares: double, price: double>>"
    return (spark.read.schema(schema).json(path, multiLine=multi_line)
            .select(*fund_and_date(), F.explode("holdings").alias("h")).select("fund", "as_of", "h.*"))
