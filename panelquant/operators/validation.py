"""Checking a panel while it is written, without a pass of its own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from panelquant.functions.columns import col
from panelquant.operators.rolling import lag

#: What a panel cannot do without; together the first two are its key.
REQUIRED_COLUMNS = ("date", "barrid", "return", "specific_risk")


@dataclass(frozen=True)
class Report:
    """Rows, required columns that are absent, NULLs (and NaNs) per required column, rows that repeat the
    (date, barrid) of another one, and rows whose id is only a placeholder."""

    rows: int = 0
    missing: tuple[str, ...] = ()
    nulls: dict[str, int] = field(default_factory=dict)
    repeated: int = 0
    placeholders: int = 0

    @property
    def ok(self) -> bool:
        """Usable: rows, every column, and a key that is known and names one row. Values may be missing."""
        return not (self.rows == 0 or self.missing or self.repeated or self.placeholders
                    or any(self.nulls.get(name) for name in ("date", "barrid")))


def placeholder() -> Column:
    """An id without a letter or digit, such as ``-`` or blanks."""
    return ~F.coalesce(col("barrid").rlike("[A-Za-z0-9]"), F.lit(True))


def observed(df: DataFrame) -> tuple[DataFrame, Observation | None, tuple[str, ...]]:
    """``df`` with metrics that its next action fills in, and the required columns it lacks.

    A repeated key is seen by comparing a row with the asset's row before, by the partitioning and order
    that rolling windows and the table by asset have anyway.
    """
    missing = tuple(name for name in REQUIRED_COLUMNS if name not in df.columns)
    if "date" in missing or "barrid" in missing:
        return df, None, missing
    present = [name for name in REQUIRED_COLUMNS if name not in missing]
    kinds = dict(df.dtypes)

    def absent(name: str) -> Column:
        empty = col(name).isNull()
        return empty | F.isnan(col(name)) if kinds[name] in ("double", "float") else empty

    observation = Observation()
    flagged = df.withColumn("_repeated", F.coalesce(lag("date") == col("date"), F.lit(False)))
    flagged = flagged.observe(
        observation, F.count("*").alias("rows"), F.count_if(col("_repeated")).alias("repeated"),
        F.count_if(placeholder()).alias("placeholders"),
        *[F.count_if(absent(name)).alias(f"null_{name}") for name in present])
    return flagged.drop("_repeated"), observation, missing


def report(observation: Observation | None, missing: tuple[str, ...]) -> Report:
    """What the observed action saw; waits for it to end."""
    if observation is None:
        return Report(missing=missing)
    seen = observation.get
    return Report(seen["rows"], missing,
                  {k.removeprefix("null_"): v for k, v in seen.items() if k.startswith("null_")},
                  seen["repeated"], seen["placeholders"])
