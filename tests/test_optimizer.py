from __future__ import annotations

import itertools

import numpy as np
import pytest

from panelquant.operators import optimizer
from panelquant.operators.constraints import Constraints, parse_constraints
from panelquant.operators.optimizer import backtest_input, run_mvo_backtest
from tests.conftest import day

GAMMA = 20.0
FACTORS = ("market", "size")
SCHEMA = ("date date, barrid string, s_alpha double, predicted_beta double, "
          "specific_risk double, market double, size double")


def best_by_enumeration(alpha, sigma, beta, rules: Constraints):
    """Tries every set of assets held and every choice of binding budget."""
    n, best, best_w = len(alpha), -np.inf, None
    subsets = ([c for k in range(n + 1) for c in itertools.combinations(range(n), k)]
               if rules.long_only else [tuple(range(n))])
    budgets = {"equal": [True], "upper": [True, False], "free": [False]}[rules.budget]
    for held, budget in itertools.product(subsets, budgets):
        held = list(held)
        rows = ([np.ones(n)] if budget else []) + ([beta] if rules.unit_beta else [])
        a = np.array([r[held] for r in rows]).reshape(len(rows), len(held))
        s = GAMMA * sigma[np.ix_(held, held)]
        kkt = np.block([[s, a.T], [a, np.zeros((len(rows), len(rows)))]])
        rhs = np.concatenate([alpha[held], np.ones(len(rows))])
        solution = np.linalg.lstsq(kkt, rhs, rcond=None)[0] if len(rhs) else rhs
        w = np.zeros(n)
        w[held] = solution[:len(held)]
        ok = all(abs(r @ w - 1) < 1e-7 for r in rows)
        ok &= not rules.long_only or w.min(initial=0) >= -1e-9
        ok &= rules.budget != "upper" or w.sum() <= 1 + 1e-9
        value = alpha @ w - GAMMA / 2 * w @ sigma @ w
        if ok and value > best:
            best, best_w = value, w
    return best_w


@pytest.fixture(scope="module")
def cross_sections(spark):
    rng = np.random.default_rng(5)
    rows, arrays = [], {}
    for k in range(12):
        date, n = f"2023-01-{k + 1:02d}", 6
        risk = rng.uniform(.05, .3, n)
        alpha = rng.normal(size=n) * .2
        beta = np.round(rng.uniform(.4, 1.7, n), 2)
        beta[0], beta[1] = .8, 1.3
        if k == 9:
            beta[:] = [1.0, 1.2, 1.3, 1.4, 1.0, 1.1]
        if k == 10:
            beta[:] = [1.01, 1.2, 1.3, 1.4, 1.5, 1.1]
        if k == 11:
            beta[:] = 1.0
        exposures = rng.normal(size=(n, 2))
        arrays[date] = alpha, risk, beta, exposures
        rows += [(day(date), f"A{i}", float(alpha[i]), float(beta[i]), float(risk[i]),
                  *map(float, exposures[i])) for i in range(n)]
    f = np.array([[.04, .01], [.01, .02]])
    cov = [(day(d), FACTORS[i], FACTORS[j], float(f[i, j]))
           for d in arrays for i in range(2) for j in range(2)]
    return (spark.createDataFrame(rows, SCHEMA).cache(), arrays,
            spark.createDataFrame(cov, "date date, factor_i string, factor_j string, cov double"),
            f)


def weights_by_date(solved):
    out = {}
    for r in solved.orderBy("date", "barrid").collect():
        out.setdefault(str(r["date"]), []).append((r["weight"], r["status"]))
    return out


CASES = [
    ("FullInvestment",), ("FullInvestment", "UnitBeta"), ("NoBuyingOnMargin",), ("UnitBeta",),
    ("NoBuyingOnMargin", "UnitBeta"), (),
    ("FullInvestment", "LongOnly"), ("LongOnly",), ("LongOnly", "NoBuyingOnMargin"),
    ("LongOnly", "UnitBeta"), ("FullInvestment", "LongOnly", "NoBuyingOnMargin", "UnitBeta"),
    ("LongOnly", "NoBuyingOnMargin", "UnitBeta"),
]


def assert_optimal(solved, arrays, rules, sigma):
    got = weights_by_date(solved)
    assert len(got) == len(arrays)
    for date, (alpha, risk, beta, x) in arrays.items():
        want = best_by_enumeration(alpha, sigma(risk, x), beta, rules)
        weights, statuses = zip(*got[date])
        if want is None:
            assert set(weights) == {None} and set(statuses) == {"infeasible"}, date
        else:
            assert set(statuses) == {"optimal"}, date
            assert np.array(weights) == pytest.approx(want, abs=1e-7), date


@pytest.mark.parametrize("names", CASES)
def test_diagonal_weights_are_optimal(cross_sections, names):
    df, arrays, _, _ = cross_sections
    rules = parse_constraints(names)
    assert_optimal(run_mvo_backtest(df, "s", names, GAMMA), arrays, rules,
                   lambda risk, x: np.diag(risk ** 2))


@pytest.mark.parametrize("names", CASES)
def test_factor_weights_are_optimal(cross_sections, names):
    df, arrays, cov, f = cross_sections
    assert_optimal(run_mvo_backtest(df, "s", names, GAMMA, FACTORS, cov), arrays,
                   parse_constraints(names),
                   lambda risk, x: np.diag(risk ** 2) + x @ f @ x.T)


def test_one_date_with_half_of_all_rows(spark):
    """Skewed dates are solved like any other: checked by the optimality conditions."""
    rng = np.random.default_rng(3)
    dates = ["2023-02-01"] * 2000 + [f"2023-02-{d:02d}" for d in range(2, 22) for _ in range(100)]
    rows = [(day(d), f"A{i}", float(rng.normal() * .1), float(rng.uniform(.4, 1.7)),
             float(rng.uniform(.05, .3)), 0.0, 0.0) for i, d in enumerate(dates)]
    names = ("FullInvestment", "LongOnly", "UnitBeta")
    df = spark.createDataFrame(rows, SCHEMA)
    out = run_mvo_backtest(df, "s", names, GAMMA).join(df, ["date", "barrid"]).toPandas()
    assert len(out) == len(rows) and set(out["status"]) == {"optimal"}
    for _, one in out.groupby("date"):
        assert kkt_residual(*(one[c].to_numpy() for c in (
            "weight", "s_alpha", "predicted_beta", "specific_risk"))) < 1e-7


def kkt_residual(w, alpha, beta, risk):
    """Largest violation of the conditions of a full-investment, long-only, unit-beta optimum."""
    slope = alpha - GAMMA * risk ** 2 * w
    held = w > 1e-12
    z = np.column_stack([np.ones(held.sum()), beta[held]])
    u = np.linalg.lstsq(z, slope[held], rcond=None)[0]
    rest = slope - u[0] - u[1] * beta
    return max(abs(w.sum() - 1), abs(w @ beta - 1), np.abs(rest[held]).max(),
               rest[~held].max(initial=0.0), -w.min())


def test_feasible_weights_that_are_not_optimal_are_noticed():
    alpha, risk = np.array([.3, .1, .2]), np.array([.1, .2, .3])
    assert kkt_residual(np.array([.25, .5, .25]), alpha, np.array([.5, 1., 1.5]), risk) > 1e-2


def test_unfinished_dates_get_no_weights(cross_sections, monkeypatch):
    monkeypatch.setattr(optimizer, "MAX_STEPS", 0)
    out = run_mvo_backtest(cross_sections[0], "s", ("FullInvestment", "LongOnly"), GAMMA).collect()
    assert {(r["weight"], r["status"]) for r in out} == {(None, "not_converged")}


@pytest.mark.parametrize("long_only", [(), ("LongOnly",)])
def test_rows_that_cannot_enter_are_kept_without_weight(spark, long_only):
    df = spark.createDataFrame([
        (day("2023-01-01"), "A", .1, 1.0, .1, 0., 0.), (day("2023-01-01"), "B", None, 1.0, .1, 0., 0.),
        (day("2023-01-01"), "C", .2, None, .1, 0., 0.), (day("2023-01-01"), "D", .2, 1.0, 0.0, 0., 0.),
        (day("2023-01-02"), "D", .2, 1.0, None, 0., 0.),
    ], SCHEMA)
    got = run_mvo_backtest(df, "s", ("FullInvestment", "UnitBeta", *long_only), GAMMA)
    assert [(w, s) for v in weights_by_date(got).values() for w, s in v] == [
        (pytest.approx(1.0), "optimal"), (None, "excluded"), (None, "excluded"), (None, "excluded")]
    got = run_mvo_backtest(df, "s", ("FullInvestment", *long_only), GAMMA)
    assert [s for v in weights_by_date(got).values() for _, s in v] == [
        "optimal", "optimal", "excluded", "excluded"]
    assert {r["barrid"] for r in backtest_input(df, "s").collect()} == {"A", "C", "D"}
    assert backtest_input(df, "s").columns == ["date", "barrid", "alpha", "predicted_beta"]


def test_dates_without_factor_covariance_are_kept(cross_sections):
    df, _, cov, _ = cross_sections
    got = weights_by_date(run_mvo_backtest(df, "s", ("FullInvestment",), GAMMA, FACTORS,
                                           cov.where("date > '2023-01-01'")))
    assert {s for _, s in got["2023-01-01"]} == {"excluded"} and len(got) == 12


@pytest.mark.parametrize("names", [("FullInvestment",), ("FullInvestment", "LongOnly")])
def test_no_rows_give_no_weights(cross_sections, names):
    df = cross_sections[0].where("false")
    out = run_mvo_backtest(df, "s", names, GAMMA)
    assert out.columns == ["date", "barrid", "weight", "status"] and out.count() == 0


def test_unknown_constraint(cross_sections):
    with pytest.raises(ValueError, match="unknown constraint: Lucky"):
        run_mvo_backtest(cross_sections[0], "s", ("LongOnly", "Lucky"), GAMMA)


def test_constraint_names_combine():
    assert parse_constraints(["NoBuyingOnMargin", "FullInvestment"]).budget == "equal"
    assert parse_constraints(["FullInvestment", "NoBuyingOnMargin"]).budget == "equal"
    assert parse_constraints([]) == Constraints("free", False, False)


def test_steps_stay_few_on_random_problems():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, k = int(rng.integers(2, 200)), int(rng.integers(0, 4))
        problem = optimizer.Problem("equal", True, True, k, 400.0)
        risk = rng.uniform(.01, .1, n)
        d, alpha = 1 / (400 * risk ** 2), rng.normal(size=n) * risk
        beta = rng.uniform(.3, 1.8, n)
        if not problem.feasible(beta.min(), beta.max()):
            continue
        z = np.column_stack([np.ones(n), beta, rng.normal(size=(n, k))])
        found = problem.solve(z, alpha, d, np.eye(problem.size))
        status, steps, u = found.status, found.steps, found.points[0]
        assert status == "optimal" and steps < 60
        w = d * np.maximum(alpha - z @ u, 0)
        assert w.sum() == pytest.approx(1) and w @ beta == pytest.approx(1)


def test_sixty_factors(spark):
    """Wide factor models compile, converge within a few rounds, and are optimal on rows dealt to several tasks."""
    rng = np.random.default_rng(8)
    names = [f"f{k}" for k in range(60)]
    half = rng.normal(size=(60, 60)) * .02
    f = half @ half.T
    rows, cov = [], []
    for d, n in (("2023-03-01", 900), ("2023-03-02", 120)):
        rows += [(day(d), f"A{i}", float(rng.normal() * .1), float(rng.uniform(.4, 1.7)), float(rng.uniform(.05, .3)),
                  *map(float, rng.normal(size=60))) for i in range(n)]
        cov += [(day(d), names[i], names[j], float(f[i, j])) for i in range(60) for j in range(60)]
    schema = ("date date, barrid string, s_alpha double, predicted_beta double, specific_risk double, "
              + ", ".join(f"{x} double" for x in names))
    df = spark.createDataFrame(rows, schema)
    factor_cov = spark.createDataFrame(cov, "date date, factor_i string, factor_j string, cov double")
    solved = run_mvo_backtest(df, "s", ("FullInvestment", "LongOnly", "UnitBeta"), GAMMA, names, factor_cov)
    out = solved.join(df, ["date", "barrid"]).toPandas()
    assert set(out["status"]) == {"optimal"} and len(out) == len(rows)
    for _, one in out.groupby("date"):
        x, w = one[names].to_numpy(), one["weight"].to_numpy()
        alpha = one["s_alpha"].to_numpy() - GAMMA * x @ (f @ (x.T @ w))
        assert kkt_residual(w, alpha, one["predicted_beta"].to_numpy(), one["specific_risk"].to_numpy()) < 1e-6


@pytest.mark.parametrize("sample", [4, 512])
def test_rounds_stay_few(spark, monkeypatch, sample):
    """The first trial comes from a sample; dates beyond it need a few rounds, the others one."""
    monkeypatch.setattr(optimizer, "SAMPLE_ROWS", sample)
    rounds = []
    inner = optimizer._by_date
    monkeypatch.setattr(optimizer, "_by_date", lambda *a: rounds.append(1) or inner(*a))
    rng = np.random.default_rng(4)
    rows = [(day(f"2023-04-{d + 1:02d}"), f"A{i}", float(rng.normal() * .1), float(rng.uniform(.4, 1.7)),
             float(rng.uniform(.05, .3)), 0.0, 0.0) for d in range(20) for i in range(200)]
    out = run_mvo_backtest(spark.createDataFrame(rows, SCHEMA), "s", ("FullInvestment", "LongOnly", "UnitBeta"), GAMMA)
    assert {r["status"] for r in out.select("status").distinct().collect()} == {"optimal"}
    assert len(rounds) <= (2 if sample == 512 else 12)


def test_few_rounds_where_few_of_many_assets_are_held(spark, monkeypatch):
    # Far more assets than the sample of the first trial, and a penalty so small that a handful is held.
    rng = np.random.default_rng(5)
    rows = [(day(f"2022-03-{d + 1:02d}"), f"US{i:05d}", float(rng.normal()), float(.5 + i % 100 / 100),
             float(rng.uniform(.03, .08))) for d in range(3) for i in range(8000)]
    frame = spark.createDataFrame(rows, "date date, barrid string, x_alpha double, predicted_beta double, "
                                        "specific_risk double")
    rounds, by_date = [], optimizer._by_date
    monkeypatch.setattr(optimizer, "_by_date", lambda *a: rounds.append(1) or by_date(*a))
    rules = ("FullInvestment", "LongOnly", "NoBuyingOnMargin", "UnitBeta")
    weights = optimizer.run_mvo_backtest(frame, "x", rules, 10)
    assert len(rounds) <= 8
    found = optimizer.optimality(weights.join(frame, ["date", "barrid"]), "x_alpha", 10).collect()
    assert [r["status"] for r in found] == ["optimal"] * 3
    for r in found:
        assert r["stationarity"] < 1e-6 and r["budget"] < 1e-8 and r["beta"] < 1e-8 and r["shorts"] == 0
