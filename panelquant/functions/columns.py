"""Scalar column expressions. All of them stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PERCENT_COLUMNS = ("return", "specific_return", "specific_risk")


def col(name: str | Column) -> Column:
    return F.col(f"`{name}`") if isinstance(name, str) else name


def finite(c: str | Column) -> Column:
    """NULL for NaN and infinities (NaN sorts above every number, so one comparison does)."""
    return F.when(F.abs(col(c)) < float("inf"), col(c))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: finite(name) for name in floats}) if floats else df


def divide(numerator: Column, denominator: Column) -> Column:
    """Division whose zero denominator gives NULL instead of an ANSI error."""
    return F.try_divide(numerator, denominator)


def zero_to_null(name: str) -> Column:
    return F.nullif(col(name), F.lit(0))


def log_return(name: str = "return") -> Column:
    return F.log1p(col(name))


def strip_suffix(c: str | Column, suffix: str = " US") -> Column:
    return F.when(F.endswith(col(c), F.lit(suffix)),
                  F.left(col(c), F.length(col(c)) - len(suffix))).otherwise(col(c))


def parse_number(c: str | Column, to: str = "double") -> Column:
    """Text such as ``-$1,234`` to a number; text that is not a number gives NULL."""
    return F.regexp_replace(F.trim(col(c)), r"[$|,]", "").try_cast(to)


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Requested columns the source lacks, as typed NULLs."""
    absent = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df
