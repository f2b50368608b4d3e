"""Joining one-row-per-date tables back to the panel.

A DATE has 3,652,059 possible values (years 1 to 9999), and a trading calendar has a few
thousand, so a table keyed by date has a size bound that does not depend on the panel. Such
a table is broadcast and the panel is not shuffled by date, which also means that a date
holding a large share of the rows never lands in a single task. Any other key type carries
no such bound and is joined without a hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def small_by_date(table: DataFrame, by: str = "date") -> DataFrame:
    bounded = isinstance(table.schema[by].dataType, T.DateType)
    return F.broadcast(table) if bounded else table


def join_by_date(df: DataFrame, table: DataFrame, how: str = "left", by: str = "date") -> DataFrame:
    return df.join(small_by_date(table, by), by, how)
