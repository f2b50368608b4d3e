"""The research job in parts: each run reads only the dates that are new since the last one.

What a later date needs from earlier ones is carried in a small state below the results:

* ``rows``: per asset its last screened rows, as many as the signal's window and shift reach back;
* ``open``: per asset its last row with its weight, whose next return is still to come;
* ``sums``: per date the sums that its returns are made of. An asset that comes back after a gap
  pays into the date it was last seen, so old dates are amended without reading old rows.

Alphas and weights of a date need that date's rows alone. Results lie by year as those of
``run_pipeline``; only the year in which the last run ended is read back and written again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelquant.functions.columns import col, divide
from panelquant.operators.filters import validate_data
from panelquant.operators.optimizer import run_mvo_backtest
from panelquant.operators.rolling import lead
from panelquant.operators.signals import compute_alphas, history
from panelquant.plans.research import ResearchResult, load_panel, realised_panel
from panelquant.session import filesystem, written
from panelquant.sources.panel import parse_date, write_by_year

#: The sums per date that returns are made of.
SUMS = ("weighted", "n_weighted", "earned", "n_earned", "n_rows", "n_weights")


@dataclass(frozen=True)
class State:
    upto: dt.date
    rows: DataFrame
    open: DataFrame
    sums: DataFrame


def _fingerprint(config: dict) -> str:
    """A state only serves the settings it was made with; the end date may move."""
    loading = {k: v for k, v in config["data_loading"].items() if k != "end_date"}
    kept = [loading, *(config.get(k) for k in ("data_cleaning", "signal", "backtest"))]
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _finished(spark: SparkSession, folder: str) -> list[dt.date]:
    """Last dates of the complete states; ``sums`` is written last."""
    fs, path = filesystem(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    complete = [n for n in names if fs.exists(filesystem(spark, f"{folder}/{n}/sums/_SUCCESS")[1])]
    return sorted(dt.date.fromisoformat(n.split("=")[1]) for n in complete)


def latest_state(spark: SparkSession, folder: str) -> State | None:
    found = _finished(spark, folder)
    if not found:
        return None
    read = [spark.read.parquet(f"{folder}/upto={found[-1]}/{part}") for part in ("rows", "open", "sums")]
    return State(found[-1], *read)


def _write_state(spark: SparkSession, folder: str, state: State) -> None:
    """Writes a state, then removes those before it, which nothing reads any more."""
    for part in ("rows", "open", "sums"):
        getattr(state, part).write.mode("overwrite").parquet(f"{folder}/upto={state.upto}/{part}")
    for date in _finished(spark, folder):
        if date < state.upto:
            fs, path = filesystem(spark, f"{folder}/upto={date}")
            fs.delete(path, True)


def _paid(realised: DataFrame, weights: DataFrame, state: State | None) -> DataFrame:
    """New rows and the open ones with the asset's next return; ``last`` marks rows that have no next row."""
    held = weights.select("date", "barrid", "weight", F.lit(True).alias("held"))
    rows = realised.select("date", "barrid", "return").join(held, ["date", "barrid"], "left").withColumn(
        "new", F.lit(True))
    if state is not None:
        rows = rows.unionByName(state.open.withColumns({"return": F.lit(None).cast("double"), "new": F.lit(False)}))
    return rows.select("date", "barrid", "weight", "held", "new", lead("return").alias("earned"),
                       lead("date").isNull().alias("last"))


def _sums(paid: DataFrame, state: State | None) -> DataFrame:
    """The sums of every date so far. A row is counted when it is new and earns when its next row comes."""
    product = col("weight") * col("earned")
    sums = paid.groupBy("date").agg(
        F.coalesce(F.sum(product), F.lit(0.0)).alias("weighted"), F.count(product).alias("n_weighted"),
        F.coalesce(F.sum("earned"), F.lit(0.0)).alias("earned"), F.count("earned").alias("n_earned"),
        F.count_if(col("new") & col("held")).alias("n_rows"),
        F.count_if(col("new") & col("weight").isNotNull()).alias("n_weights"))
    if state is None:
        return sums
    return state.sums.unionByName(sums).groupBy("date").agg(*[F.sum(c).alias(c) for c in SUMS])


def returns_from_sums(sums: DataFrame, portfolio: str) -> DataFrame:
    """The columns and rows of ``generate_returns_from_weights``."""
    none = (col("n_rows") > 0) & (col("n_weights") == 0) & (col("n_earned") > 0)
    return (sums.where((col("n_weighted") > 0) | none)
            .select("date", F.lit(portfolio).alias("portfolio"),
                    F.when(col("n_weighted") > 0, col("weighted")).alias("portfolio_return"),
                    divide(col("earned"), col("n_earned")).alias("return"),
                    F.when(none, "no_weights").otherwise("held").alias("status")))


def run_incremental(source: SparkSession | DataFrame, config: dict, run_name: str) -> ResearchResult:
    """``run_pipeline`` for the dates after the last run's, up to ``data_loading.end_date``; results of all
    dates, equal to those of one run over all of them.

    The first run, or one with other settings, takes all dates and overwrites. Without new rows the results stay as
    they are. A run that broke off is to be run again with the same or a later end date: results are replaced
    by year and the state is written last, so nothing is counted twice. Rows that are added later for
    dates already done are not seen, and an end before the last run's is refused. Alphas are always written.
    """
    if "signal" not in config:
        raise ValueError("configuration has no 'signal' section")
    spark = source if isinstance(source, SparkSession) else source.sparkSession
    signal, backtest, loading = config["signal"], config["backtest"], config["data_loading"]
    reach = history(signal)
    folder = os.path.join(config["output"]["results_path"], run_name)
    paths = {kind: os.path.join(folder, f"{run_name}_{kind}.parquet") for kind in ("weights", "returns", "alphas")}
    states = os.path.join(folder, "state", _fingerprint(config))
    state = latest_state(spark, states)
    if state is not None:
        if parse_date(loading["end_date"]) < state.upto:
            raise ValueError(f"results already reach {state.upto}")
        config_new = {**config, "data_loading": {**loading, "start_date": state.upto + dt.timedelta(days=1)}}
    else:
        config_new = config

    def result(sums: DataFrame) -> ResearchResult:
        # A first run over one date has no returns yet, so no file to take their schema from.
        returns = spark.read.schema(returns_from_sums(sums, run_name).schema).parquet(paths["returns"])
        return ResearchResult(spark.read.parquet(paths["alphas"]), spark.read.parquet(paths["weights"]), returns,
                              realised_panel(source, config), paths)

    realised = realised_panel(source, config_new)
    if state is not None and realised.isEmpty():
        return result(state.sums)
    if not validate_data(realised):
        raise ValueError("data validation failed")

    panel = load_panel(source, config_new)
    screened = panel.columns
    known = panel if state is None else state.rows.unionByName(panel)
    after = None if state is None else state.upto
    alphas = written(compute_alphas(known, signal, stored=True, after=after), "alphas")
    if state is None and alphas.isEmpty():
        raise ValueError("data validation failed")
    weights = written(run_mvo_backtest(alphas, signal["name"], backtest["constraints"], backtest["gamma"],
                                       backtest.get("factors", ()), backtest.get("factor_cov")), "weights")
    paid = written(_paid(realised, weights, state), "paid")
    sums = written(_sums(paid, state), "sums")

    if state is None:
        # The results of other settings are about to be overwritten, and with them goes the use of their states.
        fs, others = filesystem(spark, os.path.dirname(states))
        fs.delete(others, True)
    for kind, rows in (("alphas", alphas), ("weights", weights)):
        if state is None:
            write_by_year(rows, paths[kind])
            continue
        # The year that the last run ended in is one folder: its rows so far are written again.
        old = spark.read.schema(rows.schema).parquet(paths[kind]).where(
            (col("year") == state.upto.year) & (col("date") <= F.lit(state.upto))).select(rows.columns)
        write_by_year(written(old.unionByName(rows), kind), paths[kind], only_years=True)
    write_by_year(returns_from_sums(sums, run_name), paths["returns"])

    rows = alphas.select(*[col(c) for c in screened])
    rows = rows if state is None else state.rows.unionByName(rows)
    newest = Window.partitionBy("barrid").orderBy(F.desc("date"))
    rows = rows.withColumn("_back", F.row_number().over(newest)).where(col("_back") <= reach).drop("_back")
    upto = paid.agg(F.max("date")).first()[0]
    _write_state(spark, states, State(upto, rows, paid.where("last").select("date", "barrid", "weight", "held"), sums))
    return result(sums)
