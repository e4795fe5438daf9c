"""Accepted values of the detectors' parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from loginlens.operators.distances import METRICS


@dataclass(frozen=True)
class Rule:
    """A number in ``(low, high]``, or one of ``choices``; ``optional`` allows None."""

    low: float = -math.inf
    high: float = math.inf
    integer: bool = False
    choices: Sequence[object] = ()
    optional: bool = False
    number: bool = True

    def check(self, name: str, value: Any) -> None:
        if value is None:
            if not self.optional:
                raise ValueError(f"{name} needs a value")
            return
        if isinstance(value, (str, bool)):
            if value not in self.choices:
                raise ValueError(f"{name} must be one of {list(self.choices)}, not {value!r}")
            return
        if not self.number or not isinstance(value, (int, float)):
            raise ValueError(f"{name} does not accept {value!r}")
        if self.integer and value != int(value):
            raise ValueError(f"{name} must be an integer")
        if not self.low < value <= self.high:
            raise ValueError(f"{name} must lie in ({self.low}, {self.high}]")


SHARE = Rule(0, 0.99999999)
SEED = Rule(integer=True, optional=True)

# The accepted ranges of each method's parameters.
RULES: dict[str, dict[str, Rule]] = {
    "IF": {
        "n_estimators": Rule(0, 100_000, integer=True),
        "max_samples": Rule(0, 1.0, choices=("auto",)),
        "contamination": SHARE,
        "max_features": Rule(0, 1.0),
        "random_state": SEED,
    },
    "kNN": {
        "contamination": SHARE,
        "n_neighbors": Rule(0, integer=True),
        "method": Rule(choices=("largest", "mean", "median"), number=False),
        "metric": Rule(choices=METRICS, number=False),
        "approximate_above": Rule(-1, integer=True),
    },
    "RF": {
        "num_trees": Rule(0, 100_000, integer=True),
        "mtry": Rule(0, integer=True),
        "min_node_size": Rule(0, integer=True),
        "sample_fraction": Rule(0, 1.0),
        "max_depth": Rule(-1, integer=True, optional=True),
        "seed": SEED,
    },
    "DAGMM": {
        "components": Rule(0, integer=True),
        "compressed": Rule(0, integer=True),
        "max_iter": Rule(0, integer=True),
        "penalty": Rule(0),
        "level": Rule(0, 1.0),
        "random_seed": Rule(integer=True),
    },
    "LSCP": {"contamination": SHARE, "region_size": Rule(1, integer=True)},
}


def check_params(method: str, values: dict[str, Any]) -> None:
    """Raise ValueError for the first value outside its range."""
    if method not in RULES:
        raise ValueError(f"method must be one of {sorted(RULES)}")
    for name, rule in RULES[method].items():
        rule.check(name, values.get(name))


# Parameters a whole set may leave out.
MAY_BE_MISSING = {"kNN": {"approximate_above"}, "DAGMM": {"penalty"}}


def check_config(method: str, config: dict[str, Any], rows: int | None = None, columns: int | None = None) -> None:
    """Check a whole parameter set: no name unknown or missing that must be there, counts within the table's size."""
    known = set(RULES[method])
    if set(config) - known or known - set(config) - MAY_BE_MISSING.get(method, set()):
        raise ValueError(f"{method} takes exactly the parameters {sorted(known)}")
    for name, value in config.items():
        RULES[method][name].check(name, value)
    if rows is not None and method == "kNN" and config["n_neighbors"] > rows:
        raise ValueError("n_neighbors is larger than the number of rows")
    if columns is not None and method == "RF" and config["mtry"] > columns:
        raise ValueError("mtry is larger than the number of features")
