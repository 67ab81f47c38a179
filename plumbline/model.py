"""Rule specifications, contracts and results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("blocking", "warning", "info")
#: One failure mode for each kind of finding.
FAILURE_MODES = ("null_values", "duplicate_values", "novel_category", "disallowed_value", "range_violation", "length_violation", "pattern_mismatch", "schema_drift", "comparison_failure", "conditional_null", "conditional_range_violation", "row_count_low", "row_count_high", "freshness_lag", "custom_check_failed", "config_error")

RESULT_SCHEMA = "rule_id string, name string, column string, severity string, passed boolean, failed_count long, exact boolean, failure_mode string, source string, message string"


class ContractError(ValueError):
    """A contract, rule or condition that can't be used."""


class DuplicateRuleError(ContractError):
    """Two rules of a contract have the same id."""


class ValidationFailed(Exception):
    """Raised by ``on_fail='raise'``; holds the result."""

    def __init__(self, result: ValidationResult):
        super().__init__(result.to_llm())
        self.result = result


@dataclass
class RuleSpec:
    """A rule as a contract states it."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)
    id: str | None = None
    severity: str = "blocking"
    tally: bool | None = None
    context: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> RuleSpec:
        if not isinstance(raw, dict) or not raw.get("name"):
            raise ContractError(f"a rule needs a name: {raw!r}")
        known = {"name", "params", "id", "severity", "tally", "context"}
        params = dict(raw.get("params") or {}) | {k: v for k, v in raw.items() if k not in known}
        return cls(raw["name"], params, raw.get("id"), raw.get("severity", "blocking"), raw.get("tally"), dict(raw.get("context") or {}))


@dataclass
class Contract:
    name: str
    rules: list[RuleSpec]
    datasource: Any = None

    def fingerprint(self) -> str:
        """Of the name and the rules' names and parameters; severity and tally don't matter."""
        said = json.dumps([self.name, sorted(json.dumps([r.name, r.params], sort_keys=True, default=str) for r in self.rules)])
        return hashlib.sha256(said.encode()).hexdigest()[:16]


@dataclass
class RuleResult:
    rule_id: str
    name: str
    column: str | None
    severity: str
    passed: bool
    failed_count: int
    exact: bool
    failure_mode: str | None
    source: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    context: dict[str, Any] = field(default_factory=dict)
    samples: list[dict[str, Any]] | None = None
    samples_reason: str | None = None

    def violation_rate(self, rows: int | None) -> float | None:
        return None if not rows or not self.exact else self.failed_count / rows


@dataclass
class ValidationResult:
    """All rules' results in the contract's order."""

    dataset: str
    contract: str
    rules: list[RuleResult]
    rows: int | None = None
    fingerprint: str = ""
    tally: bool = False
    filtered: bool = False
    run_at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    stats: dict[str, Any] | None = None

    @property
    def passed(self) -> bool:
        """Only blocking rules decide."""
        return not any(r.severity == "blocking" and not r.passed for r in self.rules)

    @property
    def failures(self) -> list[RuleResult]:
        return [r for r in self.rules if not r.passed]

    def counts(self) -> dict[str, int]:
        out = {"total": len(self.rules), "passed": sum(r.passed for r in self.rules), "failed": len(self.failures)}
        return out | {s: sum(r.severity == s for r in self.failures) for s in SEVERITIES}

    def quality_score(self, weights: dict[str, float] | None = None) -> float | None:
        """1 - weighted violations / (rows * weights), within 0 and 1; None without exact counts or rows."""
        weigh = {"blocking": 1.0, "warning": 0.5, "info": 0.1} | (weights or {})
        if not self.rows or not self.rules or not all(r.exact for r in self.rules):
            return None
        total = sum(weigh[r.severity] for r in self.rules)
        if not total:
            return None
        return max(0.0, min(1.0, 1 - sum(r.failed_count * weigh[r.severity] for r in self.rules) / (self.rows * total)))

    def sorted(self) -> list[RuleResult]:
        return sorted(self.rules, key=lambda r: r.rule_id)

    def to_dict(self) -> dict[str, Any]:
        return {"dataset": self.dataset, "contract": self.contract, "passed": self.passed, "rows": self.rows, "fingerprint": self.fingerprint, "run_at": self.run_at, "summary": self.counts(), "quality_score": self.quality_score(), "stats": self.stats, "rules": [asdict(r) for r in self.rules]}

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    def to_llm(self) -> str:
        n = self.counts()
        head = f"{'PASSED' if self.passed else 'FAILED'} {self.contract} on {self.dataset}: {n['passed']} of {n['total']} rules passed"
        lines = [f"- {r.rule_id} ({r.severity}): {r.failed_count}{'' if r.exact else '+'} {r.message}" for r in self.failures]
        return "\n".join([head, *lines])

    def samples_df(self, spark: SparkSession, rule_id: str | None = None) -> DataFrame | None:
        """The kept failing rows of one rule with its columns, or of all rules as (rule_id, row as JSON); None without any."""
        if rule_id is not None:
            rows = next((r.samples for r in self.rules if r.rule_id == rule_id), None)
            names = list(dict.fromkeys(k for row in rows or [] for k in row))
            return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], names, samplingRatio=1.0) if rows else None
        rows = [(r.rule_id, json.dumps(row, default=str)) for r in self.rules for row in r.samples or []]
        return spark.createDataFrame(rows, "rule_id string, row string") if rows else None

    def to_text(self) -> str:
        """A table of all rules for a terminal, with kept samples under failed ones."""
        width = max([len(r.rule_id) for r in self.rules], default=0)
        lines = [self.to_llm().split("\n")[0]]
        for r in self.rules:
            lines.append(f"{'ok  ' if r.passed else 'FAIL'} {r.rule_id:<{width}} {r.severity:<8} {r.failed_count}{'' if r.exact else '+'} {'' if r.passed else r.message}".rstrip())
            lines += [f"       {row}" for row in r.samples or []]
        return "\n".join(lines)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.rule_id, r.name, r.column, r.severity, r.passed, r.failed_count, r.exact, r.failure_mode, r.source, r.message) for r in self.rules], RESULT_SCHEMA)
