"""Per-asset rolling and lag expressions over ROWS frames ordered by date.

The panel holds one row per (date, barrid), so an asset never has more rows than the calendar
has days; windows keyed by barrid are bounded however large the panel grows. Every expression
uses the same partitioning and order, so Spark plans one exchange and one sort for a chain of
them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelquant.functions.columns import col


def by_asset(keys: tuple[str, ...] = ("barrid",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def trailing(window_size: int, keys: tuple[str, ...] = ("barrid",)) -> WindowSpec:
    return by_asset(keys).rowsBetween(-(window_size - 1), 0)


def _rolling(aggregate, value: str | Column, window_size: int, min_samples: int | None,
             keys: tuple[str, ...] = ("barrid",)) -> Column:
    needed = window_size if min_samples is None else min_samples
    if window_size < 1 or needed > window_size:
        raise ValueError(f"min_samples {needed} does not fit a window of {window_size} rows")
    frame = trailing(window_size, keys)
    return F.when(F.count(col(value)).over(frame) >= needed, aggregate(col(value)).over(frame))


#: Rows of one asset that a task handles at most in ``chunked``, besides the halo.
CHUNK_ROWS = 4096


def chunked(df: DataFrame, columns: dict[str, tuple[Callable[..., Column], str | Column, int, int | None]],
            chunk_rows: int = CHUNK_ROWS, coarse: Column | None = None) -> DataFrame:
    """``df`` with rolling columns ``name: (aggregate, value, window_size, min_samples)``, long histories
    being dealt to several tasks.

    An asset's rows are numbered in order, by counts of coarse parts of time (years, or ``coarse``, any rising
    function of ``date``) and row numbers inside them. Chunks of ``chunk_rows`` rows are then windows of
    their own, each with a halo: the rows of the chunk before that its first window reaches, which only
    help. So the results are those of the plain windows bit by bit, and a key with half of all rows is no
    single task's load.
    """
    window_size = max(spec[2] for spec in columns.values())
    if chunk_rows < window_size:
        raise ValueError(f"chunks of {chunk_rows} rows are too short for a window of {window_size}")
    part = F.year("date") if coarse is None else coarse
    rows = df.withColumn("_part", part)
    counts = rows.groupBy("barrid", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("barrid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(
        "barrid", "_part", "_before")
    inside = F.row_number().over(Window.partitionBy("barrid", "_part").orderBy("date")) - 1
    placed = rows.withColumn("_at", inside).join(counts, ["barrid", "_part"]).withColumn(
        "_at", col("_at") + col("_before"))
    chunk = F.floor(col("_at") / chunk_rows)
    halo = col("_at") % chunk_rows >= chunk_rows - (window_size - 1)
    copies = F.when(halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    dealt = placed.withColumn("_own", chunk).withColumn("_chunk", F.explode(copies))
    made = {name: _rolling(*spec, keys=("barrid", "_chunk")) for name, spec in columns.items()}
    return dealt.withColumns(made).where(col("_own") == col("_chunk")).select(*df.columns, *columns)


def rolling_mean(value: str | Column, window_size: int, min_samples: int | None = None) -> Column:
    return _rolling(F.avg, value, window_size, min_samples)


def rolling_sum(value: str | Column, window_size: int, min_samples: int | None = None) -> Column:
    return _rolling(F.sum, value, window_size, min_samples)


def rolling_std(value: str | Column, window_size: int, min_samples: int | None = None) -> Column:
    return _rolling(F.stddev_samp, value, window_size, min_samples)


def lag(value: str | Column, rows: int = 1) -> Column:
    return F.lag(col(value), rows).over(by_asset())


def lead(value: str | Column, rows: int = 1) -> Column:
    return F.lead(col(value), rows).over(by_asset())
