"""Fuses rules into as few Spark jobs as their kinds allow."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import RuleResult
from plumbline.operators.rules import BrokenRule, CustomSql, Dtype, MaxRows, MinRows, Rule, Unique, duplicates
from plumbline.plans.footer import Footer, prove
from plumbline.plans.sqlguard import violations

#: Aggregates in one expression list; more would outgrow generated methods.
BATCH = 64


def fused_counts(df: DataFrame, masks: dict[str, Column], aggregates: dict[str, Column] | None = None) -> DataFrame:
    """One row: the exact violations of every mask, aggregates as they are, and ``rows``; one scan."""
    exprs = [F.count_if(m).alias(name) for name, m in masks.items()]
    return df.agg(*exprs, *[a.alias(name) for name, a in (aggregates or {}).items()], F.count(F.lit(1)).alias("rows"))


def fused_any(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row: for every mask, 1 if any row violates, else 0."""
    return df.agg(*[F.coalesce(F.bool_or(m).cast("long"), F.lit(0).cast("long")).alias(name) for name, m in masks.items()])


def early_any(df: DataFrame, masks: dict[str, Column], rows: int = 64, probes: int = 2) -> tuple[dict[str, int], int | None]:
    """For every mask, 1 if any row violates, else 0; and the rows of ``df`` if they were counted on the way.

    A probe takes the first ``rows`` rows that violate any mask still open, from one file split, then four times as
    many, and so on, so it ends where violations are. Each closes a mask at least. A probe that finds fewer rows has
    seen all there are. What is open after ``probes`` probes goes through one shared scan.
    """
    out: dict[str, int] = {}
    for _ in range(probes):
        left = {name: m for name, m in masks.items() if name not in out}
        if not left:
            return out, None
        named = {f"m{i}": name for i, name in enumerate(left)}
        flags = [F.coalesce(left[name], F.lit(False)).alias(n) for n, name in named.items()]
        found = df.select(*flags).where(reduce(Column.__or__, [F.col(n) for n in named])).take(rows)
        out |= {name: 1 for n, name in named.items() if any(r[n] for r in found)}
        if len(found) < rows:
            return out | {name: 0 for name in left if name not in out}, None
    left = {name: m for name, m in masks.items() if name not in out}
    if not left:
        return out, None
    row = df.agg(*[F.coalesce(F.bool_or(m).cast("long"), F.lit(0)).alias(f"m{i}") for i, m in enumerate(left.values())], F.count(F.lit(1)).alias("rows")).first()
    return out | {name: row[f"m{i}"] for i, name in enumerate(left)}, row["rows"]


def unique_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per rule: (rule, n). Each column is counted in an aggregation of its own; one job for all."""
    each = [duplicates(df, c).select(F.lit(rule).alias("rule"), "n") for rule, c in columns.items()]
    return reduce(DataFrame.unionByName, each)


class Plan:
    """What a list of rules needs: proofs, one or few shared aggregations, one job for uniqueness, the rest singly."""

    def __init__(self, df: DataFrame, rules: list[Rule], tally: bool | None, footer: Callable[[], Footer | None] | None = None):
        self.df, self.rules, self.schema = df, rules, df.schema
        self.footer = footer
        self.tally = {r.rule_id: False if isinstance(r, Dtype) else bool(tally if tally is not None else r.tally) for r in rules}
        self.rows: int | None = None

    def explain(self) -> list[dict[str, Any]]:
        """How each rule would be answered."""
        proofs = self._proofs()
        out = []
        for r in self.rules:
            how = "metadata" if r.rule_id in proofs or isinstance(r, Dtype) else "own job" if isinstance(r, CustomSql) else "uniqueness job" if isinstance(r, Unique) else "config error" if self._broken(r) else "shared scan"
            out.append({"rule_id": r.rule_id, "tier": how, "columns": "*" if getattr(r, "needs_all_columns", False) else r.required_columns(), "tally": self.tally[r.rule_id]})
        return out

    def _broken(self, r: Rule) -> tuple[str, dict[str, Any]] | None:
        missing = [c for c in r.required_columns() if c not in self.df.columns]
        if missing:
            nested = " Data may be nested; rules need flat columns." if len(self.df.columns) == 1 else ""
            return f"missing columns: {', '.join(missing)}.{nested}", {"missing_columns": missing, "available_columns": self.df.columns[:20]}
        problem = None if isinstance(r, BrokenRule) else r.problem(self.schema)
        return (problem, {}) if problem else None

    def _proofs(self) -> dict[str, bool]:
        # the rows of a footer are exact, so they answer row counts whether or not violations are counted
        open_rules = [r for r in self.rules if (not self.tally[r.rule_id] or isinstance(r, MinRows | MaxRows)) and not isinstance(r, BrokenRule) and not self._broken(r)]
        if not self.footer or not open_rules:
            return {}
        footer = self.footer()
        if footer is None:
            return {}
        self.rows = footer.rows
        return {r.rule_id: p for r in open_rules if (p := prove(r, footer, self.schema)) is not None}

    def run(self) -> list[RuleResult]:
        found: dict[str, RuleResult] = {}
        masks, eager, aggregates, unique, whole = {}, {}, {}, {}, []
        stuck: list[tuple[Rule, str, dict]] = []
        proofs = self._proofs()
        for r in self.rules:
            if r.rule_id in proofs and isinstance(r, MinRows | MaxRows):
                n = 0 if proofs[r.rule_id] else abs(r.threshold - self.rows)
                found[r.rule_id] = self._result(r, n, proofs[r.rule_id], "metadata", True)
            elif r.rule_id in proofs:
                found[r.rule_id] = self._result(r, 0 if proofs[r.rule_id] else 1, proofs[r.rule_id], "metadata", proofs[r.rule_id])
            elif isinstance(r, BrokenRule):
                stuck.append((r, f"the rule couldn't be built: {r.error}", {}))
            elif broken := self._broken(r):
                stuck.append((r, *broken))
            elif isinstance(r, Dtype):
                whole.append(r) if not r.matches(self.schema) else found.update({r.rule_id: self._result(r, 0, True, "metadata")})
            elif isinstance(r, CustomSql):
                whole.append(r)
            elif isinstance(r, Unique):
                unique[r.rule_id] = r.column
            elif (agg := r.aggregate(self.schema)) is not None:
                aggregates[r.rule_id] = agg
            elif (mask := r.mask(self.schema)) is not None:
                (masks if self.tally[r.rule_id] else eager)[r.rule_id] = mask
            else:
                whole.append(r)
        named = {r.rule_id: f"r{i}" for i, r in enumerate(self.rules)}
        values: dict[str, int] = {}
        must_count = masks or aggregates or any(isinstance(r, Dtype) for r in whole) or stuck and self.rows is None
        if eager and not must_count:  # nothing needs all rows: stop early
            told, rows = early_any(self.df, eager)
            values = {named[i]: n for i, n in told.items()}
            self.rows = self.rows if rows is None else rows
        exprs = [F.count_if(m).alias(named[i]) for i, m in masks.items()]
        exprs += [F.coalesce(F.bool_or(m).cast("long"), F.lit(0).cast("long")).alias(named[i]) for i, m in eager.items() if named[i] not in values]
        exprs += [a.cast("long").alias(named[i]) for i, a in aggregates.items()]
        if exprs or stuck and self.rows is None or any(isinstance(r, Dtype) for r in whole):
            for at in range(0, max(1, len(exprs)), BATCH):
                row = self.df.agg(*exprs[at : at + BATCH], F.count(F.lit(1)).alias("rows")).first()
                values |= row.asDict()
                self.rows = values.pop("rows")
        if unique:
            values |= {named[r["rule"]]: r["n"] for r in unique_counts(self.df, unique).collect()}
        for r in self.rules:
            if r.rule_id in found:
                continue
            if named[r.rule_id] in values:
                n = values[named[r.rule_id]]
                exact = r.rule_id not in eager or n == 0
                if not self.tally[r.rule_id] and r.rule_id in unique:
                    n, exact = min(n, 1), n == 0
                found[r.rule_id] = self._result(r, n, n == 0, "scan", exact)
        for r, why, details in stuck:
            found[r.rule_id] = self._result(r, self.rows or 0, False, "driver", True, "config_error", why, details)
        for r in whole:
            found[r.rule_id] = self._whole(r)
        return [found[r.rule_id] for r in self.rules]

    def _whole(self, r: Rule) -> RuleResult:
        if isinstance(r, Dtype):
            kind = self.schema[r.column].dataType.simpleString()
            return self._result(r, self.rows or 0, False, "metadata", True, r.mode, f"{r.column} is {kind}, not {r.wanted}", {"expected": r.wanted, "actual": kind})
        try:
            if isinstance(r, CustomSql):
                n = violations(self.df, r.sql)
                return self._result(r, n, n <= r.threshold, "sql", True, r.mode, f"custom SQL found {n} violations (threshold {r.threshold})")
            raw = r.validate(self.df)
            n = int(raw.get("failed_count", 0 if raw.get("passed") else 1))
            return self._result(r, n, bool(raw.get("passed", n == 0)), "custom", True, raw.get("failure_mode", r.mode), raw.get("message", r.message(n)), raw.get("details") or {})
        except Exception as e:
            rows = self.rows if self.rows is not None else self.df.count()
            return self._result(r, rows, False, "driver", True, "config_error", f"the rule failed: {str(e).splitlines()[0][:300]}")

    def _result(self, r: Rule, n: int, passed: bool, source: str, exact: bool = True, mode: str | None = None, message: str | None = None, details: dict | None = None) -> RuleResult:
        said = message if message and not passed else "passed" if passed else r.message(n)
        return RuleResult(r.rule_id, r.spec.name, r.params.get("column") if isinstance(r.params.get("column"), str) else None, r.severity, passed, int(n), exact, None if passed else mode or r.mode, source, said, details or {}, r.context)
