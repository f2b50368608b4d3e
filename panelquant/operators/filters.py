"""Row filters from configuration, percentile screens and panel validation."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelquant.functions.columns import PERCENT_COLUMNS, col, zero_to_null
from panelquant.operators.perdate import join_by_date
from panelquant.operators.quantiles import exact_quantiles
from panelquant.operators.validation import REQUIRED_COLUMNS

log = logging.getLogger(__name__)


def domestic() -> Column:
    """Primary listings of the home country."""
    return ((col("iso_country_code") == "USA") & (col("rootid") == col("barrid"))
            & F.startswith(col("barrid"), F.lit("US")))


def at_least(name: str, floor: float | None) -> Column | None:
    """No condition without a floor; a floor of 0 is none either."""
    return col(name) >= float(floor) if floor else None


def present(name: str) -> Column:
    return col(name).isNotNull()


def prepare_data(df: DataFrame, cleaning: dict | None = None) -> DataFrame:
    """Percent columns to decimals and zero volume to NULL, each unless switched off."""
    steps = {"convert_returns_to_decimal": True, "replace_zero_volume": True, **(cleaning or {})}
    if steps["convert_returns_to_decimal"]:
        df = df.withColumns({name: col(name) / 100 for name in PERCENT_COLUMNS})
    if steps["replace_zero_volume"]:
        df = df.withColumn("daily_volume", zero_to_null("daily_volume"))
    return df


def row_predicates(filters: Iterable[dict]) -> list[Column]:
    """The conditions of all filter dicts; a row has to satisfy every one of them."""
    conditions: list[Column | None] = []
    for spec in filters:
        conditions += [
            domestic() if spec.get("usa_only", True) else None,
            at_least("price", spec.get("min_price")),
            at_least("market_cap", spec.get("min_market_cap")),
            present("return") if spec.get("require_returns", True) else None,
            present("specific_risk") if spec.get("require_specific_risk", True) else None,
        ]
    return [condition for condition in conditions if condition is not None]


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def percentile_screens(df: DataFrame, filters: Iterable[dict]) -> DataFrame:
    """Per date, keep rows at or above the quantile of dollar volume and at or below the upper
    quantile of the spread. All quantiles are taken over the same rows, those given, in one pass."""
    volume, spread = col("price") * col("daily_volume"), col("bid_ask_spread")
    values, probs, tests = [], [], []
    for spec in filters:
        if spec.get("dollar_volume_percentile"):
            tests.append(volume >= col(f"_cut{len(values)}"))
            values.append(volume)
            probs.append(spec["dollar_volume_percentile"])
        if spec.get("bid_ask_spread_percentile"):
            tests.append(spread <= col(f"_cut{len(values)}"))
            values.append(spread)
            probs.append(1 - spec["bid_ask_spread_percentile"])
    if not values:
        return df
    measures = F.posexplode(F.array(*[v.cast("double") for v in values])).alias("_measure", "_value")
    quantiles = exact_quantiles(df.select("date", measures), "_value", probs, ["date", "_measure"], "_cuts")
    cuts = quantiles.groupBy("date").agg(*[
        F.max(F.when(col("_measure") == k, F.get("_cuts", F.lit(k)))).alias(f"_cut{k}") for k in range(len(values))])
    return where_all(join_by_date(df, cuts), tests).select(*[col(c) for c in df.columns])


def apply_filters(df: DataFrame, filters: Iterable[dict]) -> DataFrame:
    """Row conditions first, then the percentile screens among the rows that pass them."""
    filters = list(filters)
    return percentile_screens(where_all(df, row_predicates(filters)), filters)


def validate_data(df: DataFrame) -> bool:
    """False if a required column is missing or there are no rows (one small job).

    Best asked of the panel before its filters; ``validation.observed`` counts more, while the panel is written.
    """
    missing = [name for name in REQUIRED_COLUMNS if name not in df.columns]
    if missing:
        log.error("missing columns: %s", missing)
        return False
    if df.isEmpty():
        log.warning("data is empty")
        return False
    return True


def row_counts(df: DataFrame, filters: Iterable[dict]) -> DataFrame:
    """Rows before and after the row filters in one pass."""
    conditions = row_predicates(filters)
    passed = reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)
    return df.agg(F.count("*").alias("rows_loaded"), F.count_if(passed).alias("rows_kept"))
