"""Contracts from YAML or dicts, with inheritance."""

from __future__ import annotations

import os
from typing import Any

from plumbline.model import Contract, ContractError, DuplicateRuleError, RuleSpec


def from_dict(raw: Any, name: str = "inline") -> Contract:
    if not isinstance(raw, dict):
        raise ContractError("a contract is a mapping")
    rules = raw.get("rules")
    if rules is not None and not isinstance(rules, list):
        raise ContractError("rules must be a list")
    return Contract(str(raw.get("name") or name), [RuleSpec.from_dict(r) for r in rules or []], raw.get("datasource", raw.get("dataset")))


def _read(path: str) -> dict[str, Any]:
    import yaml

    if "://" in path and not path.startswith("file://"):
        from pyspark.sql import SparkSession

        text = "\n".join(r[0] for r in SparkSession.getActiveSession().read.text(path, wholetext=True).collect())
    else:
        with open(path.removeprefix("file://")) as f:
            text = f.read()
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ContractError(f"{path} isn't a contract")
    return raw


def load_contract(path: str, _active: tuple[str, ...] = ()) -> Contract:
    """A contract file; the rules of those in ``extends`` (one or a list, relative to the file) come first, each file's
    once. Only a chain that returns to itself is a cycle; two ways to one base aren't."""
    specs, raw = _collect(path, (), {})
    contract = from_dict(raw, os.path.splitext(os.path.basename(path))[0])
    contract.rules = specs
    ids = [s.id for s in specs if s.id]
    twice = {i for i in ids if ids.count(i) > 1}
    if twice:
        raise DuplicateRuleError(f"rule ids stand twice: {', '.join(sorted(twice))}")
    return contract


def _collect(path: str, active: tuple[str, ...], done: dict[str, bool]) -> tuple[list[RuleSpec], dict[str, Any]]:
    place = path if "://" in path else os.path.realpath(path)
    if place in active:
        raise ContractError(f"circular extends: {' -> '.join([*active, place])}")
    if "://" not in place and not os.path.exists(place):
        raise ContractError(f"no contract at {path}")
    raw = _read(place)
    bases = raw.get("extends") or []
    bases = [bases] if isinstance(bases, str) else bases
    rules: list[RuleSpec] = []
    for base in bases:
        at = base if os.path.isabs(base) or "://" in base else f"{place.rpartition('/')[0]}/{base}"
        inherited, _ = _collect(at, (*active, place), done)
        rules += inherited
    if place not in done:
        done[place] = True
        rules += from_dict(raw).rules
    return rules, raw


def as_contract(given: Any, rules: list[Any] | None = None) -> Contract:
    """A contract from a path, dict or ``Contract``, with further rules appended."""
    found = given if isinstance(given, Contract) else load_contract(given) if isinstance(given, str) else from_dict(given) if given is not None else Contract("inline", [])
    more = [r if isinstance(r, RuleSpec) else RuleSpec.from_dict(r) for r in rules or []]
    return Contract(found.name, [*found.rules, *more], found.datasource)
