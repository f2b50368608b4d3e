from __future__ import annotations

import json

import numpy as np
import pytest

from panelquant.operators.covariance import (asset_beta, both_triangles, covariance_against,
                                             construct_covariance_matrix, matrix_vector, periodic,
                                             portfolio_beta, products_with, trailing_returns)
from panelquant.operators.holdings import (align_weights, dropped_tickers, holdings_weights,
                                           last_by_key, map_tickers, ticker_union)
from panelquant.plans.etf_beta import etf_beta
from panelquant.sources.holdings_files import (read_footer_csv, read_holdings_json, read_many_csv,
                                               read_many_json, read_preamble_csv)
from tests.conftest import day

PREAMBLE = (
    '"ALL HOLDINGS\r\n(As of 01/02/2023)",TICKER,CUSIP,SECURITY,STRIKE,QUANTITY,NOTIONAL,'
    'MARKET,WEIGHT %,CURRENT\r\n'
    ',,,,,,,,,\r\n'
    '"Alpha, Inc. ""A""",ALP US,1,-,-,"1,200","$2,000","$2,000",60.5,"$2,000"\r\n'
    'Beta plc,BET,2,-,-,-,"-$1,000","$1,000.50",39.5,"$1,000"\r\n'
    'Gone Corp,GON US,3,-,-,5,$1,$1,0,$1\r\n'
    'No Ticker,,3,-,-,5,$1,$1,2,$1\r\n'
    'Dollar Fund,USD US,4,-,-,7,$7,$7,5,$7\r\n'
    'EURO,EUR,MD_2,-,-,7,$7,$7,-0.5,$7\r\n'
    'US DOLLARS,USD,MD_1,-,-,"-1,156","-$1,156","-$1,156",-0.01,"-$1,156"')

FOOTER = (
    '﻿Ticker,Name,Sector,Asset Class,Market Value,Weight (%),Notional Value,Shares,Price,'
    'Location,Exchange,Currency,FX Rate,Market Currency,Accrual Date\n'
    '"ALP","Alpha, Inc.","Tech","Equity","1,000.00","60.50","1,000.00","10","100","US","X","USD",'
    '"1.00","USD","-"\n'
    '"KRW","KRW CASH","Cash","Cash","-5","-0.02","-5","-5","1","K","-","USD","1","KRW","-"\n'
    '"NIL","Nothing","Cash","Cash","-5","-","-5","-5","1","K","-","USD","1","KRW","-"\n'
    ' \n'
    '"Prose in quotes, with a comma."\n'
    'Holdings subject to change, see the web page, always.\n')


def test_csv_with_a_preamble(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(PREAMBLE.encode())
    got = {r["ticker"]: r for r in read_preamble_csv(spark, str(path)).collect()}
    assert set(got) == {"ALP", "BET", "USD"}
    alp, bet = got["ALP"], got["BET"]
    assert alp["underlying_security"] == 'Alpha, Inc. "A"'
    assert (alp["quantity"], alp["notional_value"], alp["weight_decimal"],
            alp["current_market_value"]) == (1200, 2000.0, .605, 2000.0)
    assert (bet["quantity"], bet["notional_value"], bet["market_value"]) == (None, -1000.0, 1000.5)
    assert "weight_percent" not in alp.asDict()


def test_csv_with_a_footer(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_bytes(FOOTER.encode())
    got = {r["ticker"]: r for r in read_footer_csv(spark, str(path)).collect()}
    assert {t: r["weight"] for t, r in got.items()} == pytest.approx({"ALP": .605, "KRW": -.0002})
    assert got["ALP"]["name"] == "Alpha, Inc."


def test_json_records(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"holdings": [
        {"ticker": "ALP", "shares": 3, "price": 10.5, "fund": "x"},
        {"ticker": "BET", "shares": 1.5, "price": 2}]}, indent=1))
    got = holdings_weights(read_holdings_json(spark, str(path))).orderBy("ticker").collect()
    assert [r["market_value"] for r in got] == [31.5, 3.0]
    assert [r["weight"] for r in got] == pytest.approx([31.5 / 34.5, 3 / 34.5])


def weights(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "ticker string, weight double")


@pytest.fixture
def ids(spark):
    return spark.createDataFrame(
        [("ALP", "US1"), ("BET", "US0"), ("BET", "US2"), ("GAM", "US3")],
        "ticker string, barrid string")


def test_ticker_operations(spark, ids):
    a, b = weights(spark, {"ALP": .5, "XXX": .5}), weights(spark, {"BET": 1.0, "ALP": .0})
    assert {r["ticker"] for r in ticker_union(a, b).collect()} == {"ALP", "XXX", "BET"}
    assert ticker_union(a, b).count() == 3
    assert [r["ticker"] for r in dropped_tickers(a, b, ids).collect()] == ["XXX"]
    assert {r["ticker"]: r["barrid"] for r in last_by_key(ids, "ticker", "barrid", "barrid")
            .collect()} == {"ALP": "US1", "BET": "US2", "GAM": "US3"}
    mapped = map_tickers(b, ids).collect()
    assert {(r["ticker"], r["barrid"]) for r in mapped} == {("ALP", "US1"), ("BET", "US2")}
    both = {r["ticker"]: (r["portfolio_weight"], r["basket_weight"])
            for r in align_weights(a, b).collect()}
    assert both == {"ALP": (.5, 0.0), "XXX": (.5, 0.0), "BET": (0.0, 1.0)}


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(30, 23))
    gaps = rng.random(data.shape) < .15
    gaps[:, 0] = True
    gaps[3, 0] = False
    gaps[:, 1] = gaps[:, 2] = False
    rows = [(day(f"2023-01-{t + 1:02d}"), f"US{i:02d}", None if gaps[t, i] else float(data[t, i]))
            for t in range(30) for i in range(23)]
    frame = spark.createDataFrame(rows, "date date, barrid string, `return` double")
    return trailing_returns(frame, "2023-01-30", 25), np.where(gaps, np.nan, data)[5:]


def brute_covariance(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    return (int(both.sum()), np.cov(x[both, i], x[both, j])[0, 1] * 252
            if both.sum() > 1 else None)


@pytest.mark.parametrize("blocks", [1, 2, 5, 40])
def test_covariance_of_every_pair(returns, blocks):
    frame, x = returns
    rows = construct_covariance_matrix(frame, 252, blocks).collect()
    got = {(int(r["asset_i"][2:]), int(r["asset_j"][2:])): (r["n"], r["cov"]) for r in rows}
    assert len(rows) == len(got)
    want = {}
    for i in range(x.shape[1]):
        for j in range(i, x.shape[1]):
            n, c = brute_covariance(x, i, j)
            if n:
                want[i, j] = (n, c)
    assert got.keys() == want.keys()
    for key, (n, c) in want.items():
        assert got[key][0] == n
        assert got[key][1] == (None if c is None else pytest.approx(c))


@pytest.fixture
def cov(spark):
    v = np.array([[4., 1., .5], [1., 9., 2.], [.5, 2., 16.]]) * 2.52
    names = ["US1", "US2", "US3"]
    rows = [(names[i], names[j], float(v[i, j])) for i in range(3) for j in range(i, 3)]
    return spark.createDataFrame(rows, "asset_i string, asset_j string, cov double"), v / 252


def test_products_with_the_covariance(spark, cov):
    table, v = cov
    assert both_triangles(table).count() == 9
    wp, we = np.array([.2, .3, .5]), np.array([.6, 0., .4])
    rows = [(f"US{i + 1}", float(wp[i]), float(we[i])) for i in range(3)]
    aligned = spark.createDataFrame(
        rows, "asset string, portfolio_weight double, basket_weight double")
    row = portfolio_beta(matrix_vector(periodic(table), aligned, "basket_weight"), aligned, "portfolio_weight", "basket_weight").first()
    assert row["covariance"] == pytest.approx(wp @ v @ we)
    assert row["variance"] == pytest.approx(we @ v @ we)
    assert row["beta"] == pytest.approx(wp @ v @ we / (we @ v @ we))
    betas = {r["asset"]: r["beta"]
             for r in asset_beta(matrix_vector(periodic(table), aligned, "basket_weight"), aligned, "basket_weight").collect()}
    assert betas == pytest.approx(dict(zip(["US1", "US2", "US3"], v @ we / (we @ v @ we))))


def test_no_variance_means_no_beta(spark, cov):
    aligned = spark.createDataFrame([("US1", .5, 0.0)],
                                    "asset string, portfolio_weight double, basket_weight double")
    assert portfolio_beta(matrix_vector(cov[0], aligned, "basket_weight"), aligned, "portfolio_weight", "basket_weight").first()["beta"] == 0


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_covariance_against_members_only(returns, blocks):
    frame, x = returns
    members = frame.sparkSession.createDataFrame([("US03",), ("US07",), ("US22",), ("none",)], "asset string")
    rows = covariance_against(frame, members, 252, blocks).collect()
    got = {(int(r["asset_i"][2:]), int(r["asset_j"][2:])): (r["n"], r["cov"]) for r in rows}
    assert len(rows) == len(got)
    want = {(i, j): brute_covariance(x, i, j) for i in range(x.shape[1]) for j in (3, 7, 22)}
    want = {k: v for k, v in want.items() if v[0]}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    for key, (_, c) in want.items():
        assert got[key][1] == (None if c is None else pytest.approx(c))


@pytest.mark.parametrize("blocks", [1, 3, 9])
def test_products_of_blocks_make_no_row_for_a_cell(returns, blocks):
    """Gaps, assets without a common date or with one only, repeated, zero and missing weights: as from the cells."""
    frame, x = returns
    spark = frame.sparkSession
    alone = [(day("2023-01-20"), "US30", .5), (day("2023-01-20"), "US31", .25), (day("2022-01-01"), "US32", 1.)]
    frame = frame.unionByName(spark.createDataFrame(alone, "date date, barrid string, `return` double"))
    held = [("US03", .5), ("US07", -.25), ("US07", .5), ("US22", 0.), ("US30", 2.), ("US05", None), ("none", 1.), (None, 1.)]
    weights = spark.createDataFrame(held, "asset string, w double")
    cells = periodic(covariance_against(frame, weights, 252, blocks), 252)
    got = products_with(cells, weights, "w")
    # The old way: every cell a row, joined with the weights.
    rows = products_with(cells.select("*"), weights, "w")
    assert {r["asset"]: r["product"] for r in got.collect()} == {
        r["asset"]: None if r["product"] is None else pytest.approx(r["product"]) for r in rows.collect()}
    assert None in {r["product"] for r in got.collect()}
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in (got, rows)]
    assert ["asset_j" in plan for plan in plans] == [False, True]
    assert covariance_against(frame, weights, 252, blocks).count() == cells.count()


def test_the_beta_job_makes_its_returns_once(spark, ids):
    """Counts how often the returns are read to get all of the job's tables."""
    names = ["US1", "US2", "US3"]
    rows = [(day(f"2023-01-{1 + t:02d}"), n, (t * (i + 3) % 7) / 10) for t in range(20) for i, n in enumerate(names)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "date date, barrid string, `return` double"
    table = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    tables = etf_beta(weights(spark, {"ALP": .2, "BET": .8}), weights(spark, {"ALP": .6, "GAM": .4}), ids, table)
    assert tables["asset_beta"].count() == 3 and tables["overlay"].count() == 3 and tables["beta"].count() == 1
    assert read.value == len(rows)


def test_the_whole_beta_job(spark, ids):
    x = np.random.default_rng(11).normal(size=(40, 4))
    names = ["US1", "US2", "US3", "US4"]  # the last is neither held nor in the basket
    table = spark.createDataFrame([(day("2023-01-01"), "US9", 1.0)] + [
        (day(f"2023-{1 + t // 20:02d}-{1 + t % 20:02d}"), n, float(x[t, i]))
        for t in range(40) for i, n in enumerate(names)], "date date, barrid string, `return` double")
    v = np.cov(x[:, :3].T)
    holdings = weights(spark, {"ALP": .2, "BET": .3, "ZZZ": .5})
    basket = weights(spark, {"ALP": .6, "GAM": .4})
    tables = etf_beta(holdings, basket, ids, table)
    wp, we = np.array([.2, .3, 0.]), np.array([.6, 0., .4])
    beta = wp @ v @ we / (we @ v @ we)
    assert tables["beta"].first()["beta"] == pytest.approx(beta)
    assert {r["asset"]: r["weight"] for r in tables["overlay"].collect()} == pytest.approx(
        dict(zip(["US1", "US2", "US3"], wp - beta * we)))
    assert [r["ticker"] for r in tables["dropped"].collect()] == ["ZZZ"]
    assert tables["asset_beta"].count() == 3


def test_many_files_with_headers_of_their_own(spark, tmp_path):
    """Funds and dates come from the names; a file without a header, or without a date, is told apart."""
    (tmp_path / "AAA_2023-01-02.csv").write_bytes(PREAMBLE.encode())
    (tmp_path / "BBB_2023-01-03.csv").write_text(FOOTER)
    (tmp_path / "CCC_2023-01-04.csv").write_text("Fund C\nas of today\nWeight,Name,Symbol,Market Value\n40,x,ONE,$4\n60,y,TWO,$6\n")
    (tmp_path / "none_2023-01-05.csv").write_text("1,2,3\n")
    (tmp_path / "undated.csv").write_text("Ticker,Weight,Market Value\nTHR,100,1\n")
    got = {(r["fund"], str(r["as_of"]), r["ticker"]): (r["market_value"], r["weight"])
           for r in read_many_csv(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[0] == "CCC"} == {
        ("CCC", "2023-01-04", "ONE"): (4.0, .4), ("CCC", "2023-01-04", "TWO"): (6.0, .6)}
    assert got["BBB", "2023-01-03", "ALP"] == (1000.0, .605) and got[None, "None", "THR"] == (1.0, 1.0)
    assert {k[2] for k in got if k[0] == "BBB"} == {"ALP"} and not any(k[0] == "none" for k in got)
    for k in (1, 2):
        (tmp_path / f"J{k}_2023-02-0{k}.json").write_text(json.dumps({"holdings": [{"ticker": f"T{k}", "shares": k, "price": 2}]}))
    rows = read_many_json(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r["fund"], str(r["as_of"]), r["ticker"], r["shares"]) for r in rows) == [
        ("J1", "2023-02-01", "T1", 1.0), ("J2", "2023-02-02", "T2", 2.0)]


def test_covariance_moves_every_return_once(spark):
    # Packed by block, then each block to the tasks that multiply it: no row goes to every pair of blocks.
    rows = spark.range(64).crossJoin(spark.range(20).withColumnRenamed("id", "t")).selectExpr(
        "concat('US', id) AS barrid", "date_add(DATE '2023-01-02', int(t)) AS date", "pmod(hash(id, t), 1000) / 100D AS `return`")
    table = construct_covariance_matrix(rows, 252, 16)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in text and "CartesianProduct" in text
    assert table.count() == 64 * 65 // 2
    every = sum(r["n"] for r in table.collect())
    assert every == 64 * 65 // 2 * 20


@pytest.mark.parametrize("name, side", [("pair_covariance", "upper"), ("daily_covariance", "both")])
def test_covariance_queries_have_every_pair_of_the_window(spark, name, side):
    from panelquant.registry import spark_queries as registry
    data = "/root/testdata/sf0.001"
    held = [(r["barrid"], r["date"]) for r in registry.window_returns(spark, data).collect()]
    days = {}
    for asset, date in held:
        days.setdefault(asset, set()).add(date)
    want = {(a, b) for a in days for b in days if days[a] & days[b] and (side == "both" or a <= b)}
    got = [(r["asset_i"], r["asset_j"]) for r in registry.QUERIES[name](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
