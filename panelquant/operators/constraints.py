"""Portfolio constraints by name."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Constraints:
    """``budget`` is "equal" (weights sum to 1), "upper" (at most 1) or "free"."""

    budget: str = "free"
    unit_beta: bool = False
    long_only: bool = False


def _full_investment(c: Constraints) -> Constraints:
    return replace(c, budget="equal")


def _no_buying_on_margin(c: Constraints) -> Constraints:
    return c if c.budget == "equal" else replace(c, budget="upper")


def _unit_beta(c: Constraints) -> Constraints:
    return replace(c, unit_beta=True)


def _long_only(c: Constraints) -> Constraints:
    return replace(c, long_only=True)


CONSTRAINTS = {
    "FullInvestment": _full_investment,
    "LongOnly": _long_only,
    "NoBuyingOnMargin": _no_buying_on_margin,
    "UnitBeta": _unit_beta,
}


def parse_constraints(names: Iterable[str]) -> Constraints:
    combined = Constraints()
    for name in names:
        if name not in CONSTRAINTS:
            raise ValueError(f"unknown constraint: {name}")
        combined = CONSTRAINTS[name](combined)
    return combined
