"""Rules of a contract written in Python, one function for each built-in rule."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from plumbline.model import SEVERITIES, ContractError, RuleSpec

__all__ = ["allowed_values", "compare", "conditional_not_null", "conditional_range", "contains", "custom_sql_check", "disallowed_values", "dtype", "ends_with", "freshness", "length", "max_rows", "min_rows", "not_null", "range", "regex", "starts_with", "unique"]


def _spec(name: str, needed: dict[str, Any], more: dict[str, Any], severity: str, id: str | None, tally: bool | None, context: dict | None) -> RuleSpec:
    if severity not in SEVERITIES:
        raise ContractError(f"{severity!r} isn't a severity")
    for k, v in needed.items():
        if v is None or v == "":
            raise ContractError(f"{name} needs {k}")
    return RuleSpec(name, needed | {k: v for k, v in more.items() if v is not None}, id, severity, tally, dict(context or {}))


def _bounded(name: str, low: Any, high: Any) -> None:
    if low is None and high is None:
        raise ContractError(f"{name} needs min or max")


def not_null(column: str, include_nan: bool = False, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("not_null", {"column": column}, {"include_nan": include_nan or None}, severity, id, tally, context)


def unique(column: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("unique", {"column": column}, {}, severity, id, tally, context)


def dtype(column: str, type: str, severity: str = "blocking", id: str | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("dtype", {"column": column, "type": type}, {}, severity, id, None, context)


def range(column: str, min: Any = None, max: Any = None, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    _bounded("range", min, max)
    return _spec("range", {"column": column}, {"min": min, "max": max}, severity, id, tally, context)


def allowed_values(column: str, values: Sequence[Any], severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("allowed_values", {"column": column, "values": list(values)}, {}, severity, id, tally, context)


def disallowed_values(column: str, values: Sequence[Any], severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("disallowed_values", {"column": column, "values": list(values)}, {}, severity, id, tally, context)


def regex(column: str, pattern: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("regex", {"column": column, "pattern": pattern}, {}, severity, id, tally, context)


def length(column: str, min: int | None = None, max: int | None = None, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    _bounded("length", min, max)
    return _spec("length", {"column": column}, {"min": min, "max": max}, severity, id, tally, context)


def contains(column: str, substring: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("contains", {"column": column, "substring": substring}, {}, severity, id, tally, context)


def starts_with(column: str, prefix: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("starts_with", {"column": column, "prefix": prefix}, {}, severity, id, tally, context)


def ends_with(column: str, suffix: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("ends_with", {"column": column, "suffix": suffix}, {}, severity, id, tally, context)


def compare(left: str, right: str, op: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("compare", {"left": left, "right": right, "op": op}, {}, severity, id, tally, context)


def conditional_not_null(column: str, when: str, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("conditional_not_null", {"column": column, "when": when}, {}, severity, id, tally, context)


def conditional_range(column: str, when: str, min: Any = None, max: Any = None, severity: str = "blocking", id: str | None = None, tally: bool | None = None, context: dict | None = None) -> RuleSpec:
    _bounded("conditional_range", min, max)
    return _spec("conditional_range", {"column": column, "when": when}, {"min": min, "max": max}, severity, id, tally, context)


def min_rows(threshold: int, severity: str = "blocking", id: str | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("min_rows", {"threshold": threshold}, {}, severity, id, None, context)


def max_rows(threshold: int, severity: str = "blocking", id: str | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("max_rows", {"threshold": threshold}, {}, severity, id, None, context)


def freshness(column: str, max_age: str, as_of: Any = None, severity: str = "blocking", id: str | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("freshness", {"column": column, "max_age": max_age}, {"as_of": as_of}, severity, id, None, context)


def custom_sql_check(sql: str, threshold: int = 0, severity: str = "blocking", id: str | None = None, context: dict | None = None) -> RuleSpec:
    return _spec("custom_sql_check", {"sql": sql}, {"threshold": threshold or None}, severity, id, None, context)
