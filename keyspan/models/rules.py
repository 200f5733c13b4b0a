"""Which request parameters are taken over and what stands in for the others."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any, NamedTuple


class Rule(NamedTuple):
    name: str
    target: str
    accepts: Callable[[Any], bool]
    default: Any = None


def between(low=None, high=None, open_low: bool = False, open_high: bool = False) -> Callable[[Any], bool]:
    def accepts(value) -> bool:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        above = low is None or value > low or (value == low and not open_low)
        below = high is None or value < high or (value == high and not open_high)
        return above and below

    return accepts


def not_blank(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def is_bool(value) -> bool:
    return isinstance(value, bool)


def apply_rules(rules: tuple[Rule, ...], raw: dict) -> dict:
    """Accepted values and defaults by target name. A rule without default leaves its parameter to the library.

    A value out of its range is replaced by the default, with a warning that says so.
    """
    unknown = set(raw) - {r.name for r in rules}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    chosen = {}
    for rule in rules:
        value = raw.get(rule.name)
        if value is not None and rule.accepts(value):
            chosen[rule.target] = value
            continue
        if value is not None:
            instead = "the library's default" if rule.default is None else repr(rule.default)
            warnings.warn(f"{rule.name}={value!r} is out of range, {instead} is used", stacklevel=3)
        if rule.default is not None:
            chosen[rule.target] = rule.default
    return chosen
