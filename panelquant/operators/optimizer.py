"""Per-date mean-variance weights: maximise alpha'w - gamma/2 w'Sw for every date.

S is diagonal (squared specific risk) plus, optionally, a factor part X F X'. Two forms:

* without LongOnly and factors the solution is a handful of sums per date (`closed_form_weights`);
* otherwise the dual problem has one unknown per equality constraint and factor, and each Newton
  step needs only sums over the assets of a date. All dates advance together: in a round every task
  forms, for its rows of each date, the sums at several trial multipliers as matrix products; the partial sums
  of a date are added up and its next trials chosen in one task. So no date is ever gathered,
  however many assets it has, and a rejected step costs no round. The first trial of a date is the solution
  for a bounded sample of its rows; it is exact for dates no larger than that. With LongOnly each task
  also hands over the rows nearest to being bought or sold, a bounded number of them; the problem in which only
  those change sides is solved where the sums are added up, and its solution is one of the next trials.

Dual in words: with u the multipliers and z the asset's constraint and factor coefficients, the
weight is w = d * max(alpha - z.u, 0) (no max without LongOnly) where d = 1 / (gamma * risk^2).
Multipliers of factors are searched for in coordinates in which the factors' covariance is the identity;
rows keep their exposures, and S never exists as a matrix.

Every row with an alpha gets a row of the result. Status ``excluded`` marks rows that cannot enter
the problem (no positive risk, no beta under UnitBeta, no factor covariance of the date);
``infeasible`` and ``not_converged`` mark whole dates. All three have a NULL weight.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelquant.functions.columns import col, divide
from panelquant.operators.constraints import Constraints, parse_constraints
from panelquant.operators.perdate import join_by_date
from panelquant.session import written

TOLERANCE = 1e-10
MAX_STEPS = 300
#: Rows of a date that its first trial is found from.
SAMPLE_ROWS = 512
#: Rows of a date nearest to being sold, and nearest to being bought, that a task hands over.
NEAR_ROWS, NEAR_STEPS = 1024, 60
#: Damping of the first step and least damping: the share of the curvature of all assets that is added to
#: that of the held ones. In a round it is tried in several strengths around that of the best step before.
DAMPING_START, DAMPING_FLOOR = 1e-3, 1e-14
STRENGTHS = (1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2)
#: Besides, parts of the undamped step.
PARTS = (1.0, 0.5)


def backtest_input(df: DataFrame, signal_name: str) -> DataFrame:
    """Rows with an alpha, in the four-column schema of the backtest."""
    name = f"{signal_name}_alpha"
    return (df.where(col(name).isNotNull())
            .select("date", "barrid", col(name).alias("alpha"), "predicted_beta"))


def run_mvo_backtest(df: DataFrame, signal_name: str, constraints: Iterable[str], gamma: float,
                     factors: Sequence[str] = (),
                     factor_cov: DataFrame | None = None) -> DataFrame:
    """``date, barrid, weight, status`` for every row with an alpha."""
    rules = parse_constraints(constraints)
    name = f"{signal_name}_alpha"
    rows = (df.where(col(name).isNotNull())
            .select("date", "barrid", col(name).alias("alpha"), "predicted_beta",
                    "specific_risk", *factors))
    if not rules.long_only and not factors:
        return closed_form_weights(rows, gamma, rules)
    return solve_weights(rows, gamma, rules, factors, factor_cov)


def _with_d(rows: DataFrame, gamma: float, rules: Constraints) -> DataFrame:
    """Adds d, NULL for rows that cannot enter the problem."""
    usable = (col("specific_risk") > 0) & ~F.isnan("specific_risk") & ~F.isnan("alpha")
    if rules.unit_beta:
        usable &= col("predicted_beta").isNotNull() & ~F.isnan("predicted_beta")
    return rows.withColumn("d", F.when(
        usable, 1 / (F.lit(float(gamma)) * col("specific_risk") * col("specific_risk"))))


# --- equality constraints, diagonal S ---------------------------------------------------------

def closed_form_weights(rows: DataFrame, gamma: float, rules: Constraints) -> DataFrame:
    """Weights from per-date sums; NULL where the constraints contradict or determine nothing."""
    if rules.long_only:
        raise ValueError("LongOnly has no closed form")
    rows = _with_d(rows, gamma, rules)
    d, a, b = col("d"), col("alpha"), col("predicted_beta")
    sums = rows.where(d.isNotNull()).groupBy("date").agg(
        F.sum(d).alias("s0"), F.sum(d * b).alias("s1"), F.sum(d * b * b).alias("s2"),
        F.sum(d * a).alias("t0"), F.sum(d * a * b).alias("t1"),
        ((F.min(b) == 1) & (F.max(b) == 1)).alias("all_one"))
    s0, s1, s2, t0, t1 = (col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    zero = F.lit(0.0)

    def multipliers(budget: bool) -> tuple[Column, Column]:
        if budget and rules.unit_beta:
            # A determinant this small relative to its terms is a set of equal betas.
            det = s0 * s2 - s1 * s1
            det = F.when(det > 1e-12 * s0 * s2, det)
            # With all betas 1 the two constraints are the same one.
            return (F.when(col("all_one"), divide(t0 - 1, s0))
                    .otherwise(divide((t0 - 1) * s2 - (t1 - 1) * s1, det)),
                    F.when(col("all_one"), zero)
                    .otherwise(divide((t1 - 1) * s0 - (t0 - 1) * s1, det)))
        if budget:
            return divide(t0 - 1, s0), zero
        if rules.unit_beta:
            return zero, divide(t1 - 1, s2)
        return zero, zero

    l1, l2 = multipliers(rules.budget == "equal")
    if rules.budget == "upper":
        tight1, tight2 = multipliers(True)
        slack = t0 - l2 * s1 <= 1
        l1, l2 = F.when(slack, l1).otherwise(tight1), F.when(slack, l2).otherwise(tight2)
    solved = sums.select("date", l1.alias("l1"), l2.alias("l2"))
    weight = d * (a - col("l1") - (col("l2") * b if rules.unit_beta else zero))
    return join_by_date(rows, solved).select(
        "date", "barrid", weight.alias("weight"),
        F.when(d.isNull(), "excluded").when(weight.isNull(), "infeasible")
        .otherwise("optimal").alias("status"))


# --- dual Newton iteration --------------------------------------------------------------------

@dataclass(frozen=True)
class Sums:
    """At given multipliers: sum w*s/2 with s = alpha - z.u, sum z*w, and sum d*z*z' over the assets held."""

    value: float
    gap: np.ndarray
    curvature: np.ndarray

    @staticmethod
    def over(z: np.ndarray, alpha: np.ndarray, d: np.ndarray, u: np.ndarray, hold_all: bool) -> Sums:
        gain = alpha - z @ u
        held = d if hold_all else np.where(gain > 0, d, 0.0)
        weighted = z * held[:, None]
        return Sums(float(held @ (gain * gain)) / 2, weighted.T @ gain, weighted.T @ z)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.value + other.value, self.gap + other.gap, self.curvature + other.curvature)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.value - other.value, self.gap - other.gap, self.curvature - other.curvature)

    def moved(self, by: np.ndarray) -> Sums:
        """The same at multipliers further ``by``, the same assets being held."""
        change = self.curvature @ by
        return Sums(self.value - by @ self.gap + by @ change / 2, self.gap - change, self.curvature)

    def turned(self, root: np.ndarray) -> Sums:
        """The same for multipliers v with u = root v."""
        return Sums(self.value, root.T @ self.gap, root.T @ self.curvature @ root)


@dataclass(frozen=True)
class Search:
    """One date's search: ``trials`` to evaluate, the first being the best so far; ``points`` are the
    same in the rows' coordinates, and rows near ``center``, one of them, are handed over. A finished search has
    a status, and its only trial is the solution."""

    trials: tuple[np.ndarray, ...]
    points: tuple[np.ndarray, ...]
    free: np.ndarray
    spread: np.ndarray | None = None
    damping: float = DAMPING_START
    steps: int = 0
    edge: bool = False
    center: int = 0
    status: str | None = None

    def at(self, root: np.ndarray, trials: Iterable[np.ndarray], **changes) -> Search:
        trials = tuple(trials)
        return replace(self, trials=trials, points=tuple(root @ u for u in trials), **changes)


@dataclass(frozen=True)
class Problem:
    """The part of the dual that does not depend on the data."""

    budget: str
    unit_beta: bool
    long_only: bool
    n_factors: int
    gamma: float
    most_steps: int = MAX_STEPS

    @property
    def n_rules(self) -> int:
        return int(self.budget != "free") + int(self.unit_beta)

    @property
    def size(self) -> int:
        return self.n_rules + self.n_factors

    def feasible(self, beta_min: float, beta_max: float) -> bool:
        if not self.unit_beta:
            return True
        if self.long_only:
            if self.budget == "equal":
                return beta_min <= 1 <= beta_max
            return beta_max >= 1 if self.budget == "upper" else beta_max > 0
        if self.budget == "equal":
            return beta_min < beta_max or beta_min == 1
        return beta_min != 0 or beta_max != 0

    def on_edge(self, beta_min: float, beta_max: float) -> bool:
        """Only assets with beta 1 can be held: no combination of the others averages to 1."""
        if not (self.unit_beta and self.long_only):
            return False
        return (self.budget == "equal" and beta_min == 1) or (
            self.budget in ("equal", "upper") and beta_max == 1)

    def root(self, factor_root: np.ndarray | None) -> np.ndarray:
        """Coordinates of the search to those of the rows: factors by a root of their covariance."""
        out = np.eye(self.size)
        if factor_root is not None:
            out[self.n_rules:, self.n_rules:] = factor_root
        return out

    def start(self, edge: bool = False) -> Search:
        free = np.ones(self.size, dtype=bool)
        if self.budget == "upper":
            free[0] = False
        zero = np.zeros(self.size)
        return Search((zero,), (zero,), free, edge=edge)

    def hold_all(self, search: Search) -> bool:
        """Whether shorts are allowed; the first step always takes everything as held."""
        return not self.long_only or search.spread is None

    def advance(self, search: Search, sums: Sequence[Sums], root: np.ndarray) -> Search:
        """The search with its next trials, or finished. Unfinished multipliers are no solution."""
        target = np.concatenate([np.ones(self.n_rules), np.zeros(self.n_factors)])
        ridge = np.concatenate([np.zeros(self.n_rules), np.full(self.n_factors, 1 / self.gamma)])
        judged = []
        for u, found in zip(search.trials, sums, strict=True):
            found = found.turned(root)
            judged.append((found.value + target @ u + (ridge * u * u).sum() / 2,
                           found.gap - target - ridge * u, found.curvature + np.diag(ridge)))
        if search.spread is None:
            _, gap, curvature = judged[0]
            spread = np.maximum(np.diag(curvature), 1e-300)
            step = _step(curvature, DAMPING_FLOOR * np.diag(spread), gap, search.free)
            return search.at(root, [search.trials[0] + step], spread=spread)
        if search.steps >= self.most_steps:
            return replace(search, status="not_converged")
        # Below rounding error of the value only the gap can tell progress.
        least = min(value for value, _, _ in judged)
        blind = 1e-14 * max(abs(least), *(abs(target @ u) for u in search.trials), 1e-300)
        best = min((k for k, (value, _, _) in enumerate(judged) if value - least <= blind),
                   key=lambda k: np.abs(judged[k][1][search.free]).max(initial=0.0))
        u, (_, gap, curvature), free = search.trials[best], judged[best], search.free
        size = TOLERANCE * max(1.0, np.abs(gap + target + ridge * u).max(initial=0.0))
        if np.abs(gap[free]).max(initial=0.0) <= size:
            if free.all() or gap[0] <= size:
                return search.at(root, [u], status="optimal")
            free = np.ones(self.size, dtype=bool)
        # Few assets held make the curvature nearly singular, so steps are held back by a share of the
        # curvature of all assets; by a much larger one where no step has got on.
        damping = search.damping
        if len(search.trials) > 1:
            damping *= 1e5 if best == 0 else ([*STRENGTHS, *(STRENGTHS[0] for _ in PARTS), STRENGTHS[0]])[best - 1]
        damping = max(damping, DAMPING_FLOOR)
        spread = np.diag(search.spread)
        steps = [_step(curvature, damping * x * spread, gap, free) for x in STRENGTHS]
        whole = _step(curvature, DAMPING_FLOOR * spread, gap, free)
        return search.at(root, [u, *(u + step for step in steps), *(u + part * whole for part in PARTS)], free=free,
                         damping=damping, steps=search.steps + 1)

    def near(self, search: Search, sums: Sequence[Sums], rows: np.ndarray, following: Search,
             root: np.ndarray) -> Search:
        """``following``, what ``advance`` made of ``search``, with one more trial: the solution if of all assets
        only ``rows`` (z, alpha, d) changed sides from where they are at the centre."""
        z, alpha, d = rows[:, :self.size], rows[:, -2], rows[:, -1]
        center = search.points[search.center]
        fixed = sums[search.center] - Sums.over(z, alpha, d, center, False)
        inner, problem = search.at(root, [search.trials[search.center]], steps=0, damping=DAMPING_START), replace(
            self, most_steps=NEAR_STEPS)
        while inner.status is None:
            inner = problem.advance(inner, [fixed.moved(u - center) + Sums.over(z, alpha, d, u, False)
                                            for u in inner.points], root)
        found = inner.trials[0]
        if not np.isfinite(found).all():
            return following
        # Where the centre was the best, the next is the new trial; otherwise it is the best.
        kept = np.array_equal(following.trials[0], search.trials[search.center])
        return following.at(root, [*following.trials, found], center=len(following.trials) if kept else 0)

    def solve(self, z: np.ndarray, alpha: np.ndarray, d: np.ndarray, root: np.ndarray,
              edge: bool = False) -> Search:
        """A finished search over rows at hand."""
        search = self.start(edge)
        while search.status is None:
            hold_all = self.hold_all(search)
            search = self.advance(search, [Sums.over(z, alpha, d, u, hold_all) for u in search.points], root)
        return search


def _step(curvature: np.ndarray, damping: np.ndarray, gap: np.ndarray,
          free: np.ndarray) -> np.ndarray:
    step = np.zeros(len(gap))
    if free.any():
        pick = np.ix_(free, free)
        step[free] = np.linalg.solve((curvature + damping)[pick], gap[free])
    return step


def solve_weights(rows: DataFrame, gamma: float, rules: Constraints,
                  factors: Sequence[str] = (), factor_cov: DataFrame | None = None) -> DataFrame:
    """Dual Newton for all dates at once: a round is one aggregation over all tasks.

    Only trial multipliers per date reach the driver; the calendar bounds them.
    """
    problem = Problem(rules.budget, rules.unit_beta, rules.long_only, len(factors), float(gamma), MAX_STEPS)
    rows = _with_d(rows, gamma, rules)
    roots = None
    if factors:
        if factor_cov is None:
            raise ValueError("factors need a factor covariance table")
        roots = written(factor_roots(factor_cov, factors), "mvo-roots")
        rows = join_by_date(rows, roots.select("date", F.lit(True).alias("_known"))).withColumn(
            "d", F.when(col("_known"), col("d")))
    z = [F.lit(1.0)] if problem.budget != "free" else []
    z += [F.coalesce("predicted_beta", F.lit(0.0))] if problem.unit_beta else []
    z += [F.coalesce(name, F.lit(0.0)) for name in factors]
    narrow = rows.select("date", "barrid", "alpha", "d", F.array(*z).cast("array<double>").alias("z"))
    # Every round reads the narrow input, so it is written once; by date, so that a task sees few dates, and
    # by a hash within dates, so that a large date is dealt to several tasks.
    narrow = written(narrow.repartitionByRange("date", F.xxhash64("barrid")).sortWithinPartitions("date"), "mvo-rows")
    return _weights(problem, narrow, _solve(problem, narrow.where(col("d").isNotNull()), roots))


def factor_roots(factor_cov: DataFrame, factors: Sequence[str]) -> DataFrame:
    """``date, root``: a square root of each date's factor covariance, row by row."""
    index = {name: k for k, name in enumerate(factors)}

    def root(table: pa.Table) -> pa.Table:
        matrix = np.zeros((len(index), len(index)))
        for i, j, c in zip(*(table.column(c).to_pylist() for c in ("factor_i", "factor_j", "cov")), strict=True):
            if i in index and j in index:
                matrix[index[i], index[j]] = c
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        half = vectors * np.sqrt(np.maximum(values, 0.0))
        return pa.table({"date": table.column("date").slice(0, 1),
                         "root": pa.array([half.ravel().tolist()], pa.list_(pa.float64()))})

    # A group here is one date's factor-by-factor matrix, not its assets.
    cells = factor_cov.select("date", "factor_i", "factor_j", col("cov").cast("double"))
    date = factor_cov.schema["date"].dataType.simpleString()
    return cells.groupBy("date").applyInArrow(root, f"date {date}, root array<double>")


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The ``z`` arrays of all rows."""
    flat = pa.concat_arrays([c.flatten() for c in table.column("z").chunks] or [pa.array([], pa.float64())])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _allowed(problem: Problem, z: np.ndarray, d: np.ndarray, edge: bool) -> np.ndarray:
    """d, and 0 for the assets that an edge date cannot hold."""
    return np.where(z[:, problem.n_rules - 1] == 1, d, 0.0) if edge else d


def _by_date(problem: Problem, grouped: DataFrame, roots: DataFrame | None, function) -> dict:
    """``date: search`` from ``function(date, rows, root)`` over the groups of ``grouped``."""
    date = grouped.schema["date"].dataType.simpleString()

    def found(table: pa.Table, root: np.ndarray | None) -> pa.Table:
        search = function(table.column("date")[0].as_py(), table, problem.root(root))
        return pa.table({"date": table.column("date").slice(0, 1),
                         "search": pa.array([pickle.dumps(search)], pa.binary())})

    def with_root(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"date": own.column("date").slice(0, 0), "search": pa.array([], pa.binary())})
        flat = np.array(own.column("root")[0].as_py())
        return found(table, flat.reshape(problem.n_factors, -1))

    schema = f"date {date}, search binary"
    if roots is None:
        out = grouped.groupBy("date").applyInArrow(lambda table: found(table, None), schema)
    else:
        out = grouped.groupBy("date").cogroup(roots.groupBy("date")).applyInArrow(with_root, schema)
    return {r["date"]: pickle.loads(r["search"]) for r in out.collect()}


def _first(problem: Problem, rows: DataFrame, roots: DataFrame | None) -> dict:
    """Each date's search from the solution for a sample of its rows, chosen by a hash."""
    beta = F.get("z", F.lit(problem.n_rules - 1)) if problem.unit_beta else F.lit(0.0)
    ranges = rows.groupBy("date").agg(F.count("*").alias("n"), F.min(beta).alias("low"), F.max(beta).alias("high"))
    order = Window.partitionBy("date").orderBy(F.xxhash64("barrid"), "barrid")
    # A salt keeps a large date's rows from being ranked in one task.
    salted = Window.partitionBy("date", "salt").orderBy(F.xxhash64("barrid"), "barrid")
    # Only rows that can be among the first by their hash are ranked, twice as many as wanted.
    hashed = F.xxhash64("barrid").cast("double") / 2.0 ** 63
    likely = join_by_date(rows, ranges.select("date", "n"), "inner").where(
        (col("n") <= 4 * SAMPLE_ROWS) | (hashed < 4.0 * SAMPLE_ROWS / col("n") - 1)).drop("n")
    sample = likely.withColumn("salt", F.expr("pmod(xxhash64(barrid, 1), 64)")).withColumn(
        "k", F.row_number().over(salted)).where(col("k") <= SAMPLE_ROWS).withColumn(
        "k", F.row_number().over(order)).where(col("k") <= SAMPLE_ROWS)

    def start(date, table: pa.Table, root: np.ndarray) -> Search:
        n, low, high = (table.column(c)[0].as_py() for c in ("n", "low", "high"))
        if not problem.feasible(low, high):
            return replace(problem.start(), status="infeasible")
        edge = problem.on_edge(low, high)
        z = _matrix(table, problem.size)
        d = _allowed(problem, z, _numbers(table, "d"), edge) * (n / table.num_rows)
        betas = z[:, problem.n_rules - 1] if problem.unit_beta else np.zeros(1)
        if problem.feasible(betas.min(), betas.max()):
            found = problem.solve(z, _numbers(table, "alpha"), d, root, edge)
            if found.status == "optimal":
                return replace(found, status=None, steps=0, damping=DAMPING_START)
        return problem.start(edge)

    joined = join_by_date(sample.select("date", "alpha", "d", "z"), ranges)
    return _by_date(problem, joined, roots, start)


def _solve(problem: Problem, rows: DataFrame, roots: DataFrame | None) -> dict:
    """``date: finished search``."""
    context, size = rows.sparkSession.sparkContext, problem.size
    date = rows.schema["date"].dataType.simpleString()
    lower = np.tril_indices(size)
    searches = _first(problem, rows, roots)
    while any(s.status is None for s in searches.values()):
        shared = context.broadcast({day: s for day, s in searches.items() if s.status is None})

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The sums of this task's rows, one row per date; rows come by date, so one date is held."""
            current, held, close = None, None, None

            def nearest(found: np.ndarray) -> np.ndarray:
                """Of rows led by their gain per z, the nearest on either side."""
                sides = [side if len(side) <= NEAR_ROWS else
                         side[np.argpartition(np.abs(side[:, 0]), NEAR_ROWS)[:NEAR_ROWS]]
                         for side in (found[found[:, 0] > 0], found[found[:, 0] <= 0])]
                return np.concatenate(sides)

            def record() -> pa.RecordBatch:
                flat = [np.concatenate([[x.value], x.gap, x.curvature[lower]]) for x in held]
                return pa.RecordBatch.from_arrays(
                    [pa.array([current], kind), pa.array([np.concatenate(flat).tobytes()], pa.binary()),
                     pa.array([close[:, 1:].tobytes()], pa.binary())], ["date", "sums", "near"])

            for batch in batches:
                kind = batch.schema.field("date").type
                days = batch.column("date").dictionary_encode()
                codes = days.indices.to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:]):
                    day = days.dictionary[int(codes[a])].as_py() if a < b else None
                    if day not in shared.value:
                        continue
                    search, part = shared.value[day], pa.Table.from_batches([batch.slice(a, b - a)])
                    z = _matrix(part, size)
                    d = _allowed(problem, z, _numbers(part, "d"), search.edge)
                    alpha, hold_all = _numbers(part, "alpha"), problem.hold_all(search)
                    sums = [Sums.over(z, alpha, d, u, hold_all) for u in search.points]
                    found = np.empty((0, size + 3))
                    if not hold_all:
                        gain = (alpha - z @ search.points[search.center]) / np.maximum(np.abs(z).sum(axis=1), 1e-300)
                        found = nearest(np.column_stack([gain, z, alpha, d])[d > 0])
                    if day == current:
                        held = [x + y for x, y in zip(held, sums, strict=True)]
                        close = nearest(np.concatenate([close, found]))
                        continue
                    if held is not None:
                        yield record()
                    current, held, close = day, sums, found
            if held is not None:
                yield record()

        def advance(day, table: pa.Table, root: np.ndarray) -> Search:
            search = shared.value[day]
            flat = sum(np.frombuffer(x.as_py()) for x in table.column("sums")).reshape(len(search.trials), -1)
            sums = []
            for row in flat:
                curvature = np.zeros((size, size))
                curvature[lower] = row[1 + size:]
                sums.append(Sums(row[0], row[1:1 + size], np.tril(curvature) + np.tril(curvature, -1).T))
            following = problem.advance(search, sums, root)
            if following.status is not None or problem.hold_all(search):
                return following
            near = np.concatenate([np.frombuffer(x.as_py()) for x in table.column("near")]).reshape(-1, size + 2)
            return problem.near(search, sums, near, following, root)

        open_days = [day for day, s in searches.items() if s.status is None]
        wanted = rows.where(col("date").between(min(open_days), max(open_days))).select("date", "alpha", "d", "z")
        partials = wanted.mapInArrow(partial, f"date {date}, sums binary, near binary")
        searches.update(_by_date(problem, partials, roots, advance))
        shared.destroy()
    return searches


def _weights(problem: Problem, rows: DataFrame, searches: dict) -> DataFrame:
    date = rows.schema["date"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(
        [(day, s.points[0].tolist() if s.status == "optimal" else None, s.status, s.edge)
         for day, s in searches.items()], f"date {date}, u array<double>, status string, edge boolean")
    gain = col("alpha") - F.expr("aggregate(zip_with(z, u, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    d = col("d")
    if problem.unit_beta:
        d = F.when(col("edge") & (F.get("z", F.lit(problem.n_rules - 1)) != 1), 0.0).otherwise(d)
    weight = d * (F.greatest(gain, F.lit(0.0)) if problem.long_only else gain)
    return join_by_date(rows, table).select(
        "date", "barrid",
        F.when(col("d").isNotNull() & col("u").isNotNull(), weight).alias("weight"),
        F.when(col("d").isNull(), "excluded").otherwise(col("status")).alias("status"))


# --- checking weights --------------------------------------------------------------------------

def optimality(held: DataFrame, alpha: str, gamma: float, factors: Sequence[str] = (),
               factor_cov: DataFrame | None = None) -> DataFrame:
    """``date, assets, status, stationarity, budget, beta, shorts``: how far fully invested, long-only,
    unit-beta weights are from an optimum.

    ``held`` has weight, status and the data of every asset. The slope of the objective has to be
    the same linear function of beta for all assets held, and no larger for the others; the function is fitted
    to the assets held, and ``stationarity`` is the largest violation over the date's largest alpha. Feasible
    weights that are not optimal do not pass.
    """
    w, beta, risk = col("weight"), col("predicted_beta"), col("specific_risk")
    per_date = held.groupBy("date").agg(
        F.count("*").alias("assets"), F.max("status").alias("status"), F.sum("weight").alias("total"),
        F.sum(w * beta).alias("held_beta"), F.count_if(w < 0).alias("shorts"), F.max(F.abs(col(alpha))).alias("scale"),
        *[F.sum(w * col(x)).alias(f"_y{k}") for k, x in enumerate(factors)])
    slope = col(alpha) - F.lit(float(gamma)) * risk * risk * w
    if factors:
        wide = factor_cov.groupBy("date").agg(*[
            F.max(F.when((col("factor_i") == x) & (col("factor_j") == y), col("cov"))).alias(f"_f{i}_{j}")
            for i, x in enumerate(factors) for j, y in enumerate(factors)])
        per_date = per_date.join(wide, "date")
        for i, x in enumerate(factors):
            for j in range(len(factors)):
                slope = slope - F.lit(float(gamma)) * col(x) * col(f"_f{i}_{j}") * col(f"_y{j}")
    sloped = join_by_date(held.select("date", "barrid", "weight", "predicted_beta", "specific_risk", alpha, *factors),
                          per_date).withColumn("slope", slope)
    active = w > 1e-9
    line = sloped.where(active).groupBy("date").agg(
        F.regr_slope("slope", "predicted_beta").alias("_slope"), F.avg("slope").alias("_mean"),
        F.avg("predicted_beta").alias("_beta"))
    rest = col("slope") - col("_mean") - F.coalesce("_slope", F.lit(0.0)) * (beta - col("_beta"))
    worst = F.max(F.when(active, F.abs(rest)).otherwise(F.greatest(rest, F.lit(0.0))) / col("scale"))
    return join_by_date(sloped, line).groupBy("date").agg(
        F.max("assets").alias("assets"), F.max("status").alias("status"), worst.alias("stationarity"),
        F.max(F.abs(col("total") - 1)).alias("budget"), F.max(F.abs(col("held_beta") - 1)).alias("beta"),
        F.max("shorts").alias("shorts"))
