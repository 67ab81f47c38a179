"""The public functions."""

from __future__ import annotations

import functools
import logging
import warnings
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import Contract, RuleSpec, ValidationFailed, ValidationResult
from plumbline.operators import compare as _compare
from plumbline.operators import profiler, samples
from plumbline.operators.history import HistoryStore
from plumbline.operators.rules import BUILT_IN_RULES, REGISTRY, CustomSql, Dtype, Rule, build_rules
from plumbline.plans.footer import read_footer
from plumbline.plans.fusion import Plan
from plumbline.sources.config import config, resolve, set_config
from plumbline.sources.contracts import as_contract
from plumbline.sources.datasets import SourceSpec, describe, load

__all__ = ["annotate", "compare", "config", "describe_rule", "diff", "draft", "explain", "get_annotations", "get_history", "get_profile", "get_run", "get_run_with_annotations", "has_runs", "health", "list_profiles", "list_rules", "list_runs", "scout", "scout_diff", "suggest_rules", "profile", "profile_diff", "profile_relationship", "resolve", "set_config", "validate", "validate_decorator", "compare_profiles", "rule"]

compare_profiles = profiler.compare_profiles


def _spark(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def rule(name: str, *, id: str | None = None, severity: str = "blocking", tally: bool | None = None, context: dict | None = None, **params: Any) -> RuleSpec:
    """A rule of a contract written in Python."""
    return RuleSpec(name, params, id, severity, tally, context or {})


def _selected(contract: Contract, only: Sequence[str] | None, columns: Sequence[str] | None) -> tuple[list[Rule], bool]:
    """Rules by name or id (``only`` wins), or those that touch ``columns`` and those of the dataset."""
    rules = build_rules(contract.rules)
    if only is not None:
        if columns is not None:
            logging.getLogger(__name__).warning("only is given, so columns is ignored")
        return [r for r in rules if r.spec.name in only or r.rule_id in only], True
    if columns is not None:
        return [r for r in rules if not r.required_columns() or set(r.required_columns()) & set(columns)], True
    return rules, False


def _footer(source: Any) -> Callable | None:
    if isinstance(source, str) and "://" not in source.removeprefix("file://"):
        try:
            spec = SourceSpec.from_uri(source)
        except Exception:
            return None
        if spec.format == "parquet":
            return functools.cache(lambda: read_footer(spec.path))
    return None


def validate(data: Any, contract: Any = None, *, rules: list[Any] | None = None, tally: bool | None = None, only: Sequence[str] | None = None, columns: Sequence[str] | None = None, preplan: bool = True, sample: int = 0, sample_budget: int = 50, sample_columns: Any = None, details: bool = False, stats: str | None = None, store: HistoryStore | None = None, storage_options: dict | None = None, dry_run: bool = False, spark: SparkSession | None = None) -> ValidationResult | dict[str, Any]:
    """Measure a dataset against rules. ``tally=True`` counts all violations; otherwise a rule of rows says only that some
    exist. ``sample`` failing rows of each failed rule are kept, ``sample_budget`` in all. ``store`` keeps the run."""
    spark = data.sparkSession if isinstance(data, DataFrame) else _spark(spark)
    found = as_contract(contract, rules)
    picked, filtered = _selected(found, only, columns)
    if dry_run:
        return {"contract": found.name, "valid": True, "rules": [r.rule_id for r in picked], "columns": sorted({c for r in picked for c in r.required_columns()})}
    source = data if data is not None else found.datasource
    df = load(spark, source, storage_options)
    plan = Plan(df, picked, tally, _footer(source) if preplan else None)
    results = plan.run()
    out = ValidationResult(describe(source), found.name, results, plan.rows, found.fingerprint(), bool(tally), filtered)
    by_id = {r.rule_id: r for r in picked}
    budget = sample_budget
    for r in results:
        own = by_id[r.rule_id]
        if details and not r.passed and r.failure_mode != "config_error":
            r.details |= samples.explain_failure(df, own)
        if sample:
            why = samples.UNAVAILABLE["passed"] if r.passed else samples.UNAVAILABLE["config"] if r.failure_mode == "config_error" else samples.UNAVAILABLE["budget"] if budget <= 0 else None
            got = None if why else samples.sample(df, own, min(sample, budget) if r.exact or plan.tally[r.rule_id] else 1, sample_columns)
            r.samples, r.samples_reason = got, why or (samples.UNAVAILABLE["no_rows"] if got is None else None)
            budget -= len(got or [])
    if stats == "summary":
        out.stats = {"rows": plan.rows if plan.rows is not None else df.count(), "columns": len(df.columns)}
    elif stats == "profile":
        p = profiler.profile(df, "scan", describe(source), sorted({c for r in picked for c in r.required_columns() if c in df.columns}) or None)
        out.stats = {c.name: {"nulls": c.nulls, "distinct": c.distinct, **{k: c.stats.get(k) for k in ("min", "max", "mean")}} for c in p.columns}
    if store:
        store.save(out)
    return out


def sample_failures(data: Any, contract: Any, rule_id: str, n: int = 5, columns: Any = None, order_by: Sequence[str] = (), spark: SparkSession | None = None) -> list[dict[str, Any]] | None:
    """Up to 100 failing rows of one rule."""
    df = load(data.sparkSession if isinstance(data, DataFrame) else _spark(spark), data)
    own = next(r for r in build_rules(as_contract(contract).rules) if r.rule_id == rule_id)
    return samples.sample(df, own, n, columns, order_by)


def explain(data: Any, contract: Any = None, rules: list[Any] | None = None, tally: bool | None = None, spark: SparkSession | None = None) -> list[dict[str, Any]]:
    """How each rule would be answered: by metadata, in the shared scan, or in a job of its own."""
    spark = data.sparkSession if isinstance(data, DataFrame) else _spark(spark)
    return Plan(load(spark, data), build_rules(as_contract(contract, rules).rules), tally, _footer(data)).explain()


def profile(data: Any, preset: str = "scan", *, columns: list[str] | None = None, sample: int | None = None, sample_by: str = "rows", sample_share: float | None = None, percentiles: tuple[int, ...] | None = None, store: HistoryStore | None = None, storage_options: dict | None = None, spark: SparkSession | None = None) -> profiler.DatasetProfile:
    spark = data.sparkSession if isinstance(data, DataFrame) else _spark(spark)
    read = _footer(data)
    df = load(spark, data, storage_options)
    if preset == "strategic":
        out = profiler.strategic_profile(df if columns is None else df.select(*[c for c in df.columns if c in columns]), describe(data))
    else:
        out = profiler.profile(df, preset, describe(data), columns, sample, percentiles, read() if read and profiler.PRESETS.get(preset, {}).get("metadata") else None, sample_by=sample_by, sample_share=sample_share)
    if store:
        store.save_profile(out, out.source)
    return out


def draft(data: Any, min_confidence: float = 0.5, as_yaml: bool = False, **options: Any) -> list[profiler.Suggestion] | str:
    p = data if isinstance(data, profiler.DatasetProfile) else profile(data, "interrogate", **options)
    return profiler.draft_yaml(p, min_confidence=min_confidence) if as_yaml else profiler.draft(p, min_confidence)


def compare(before: Any, after: Any, key=None, *, before_key=None, after_key=None, sample_limit: int = 5, spark: SparkSession | None = None) -> _compare.Report:
    spark = before.sparkSession if isinstance(before, DataFrame) else _spark(spark)
    return _compare.compare(load(spark, before), load(spark, after), key, before_key, after_key, sample_limit)


def profile_relationship(left: Any, right: Any, on=None, *, left_on=None, right_on=None, sample_limit: int = 5, spark: SparkSession | None = None) -> _compare.Report:
    spark = left.sparkSession if isinstance(left, DataFrame) else _spark(spark)
    return _compare.profile_relationship(load(spark, left), load(spark, right), on, left_on, right_on, sample_limit)


def _fp(contract: Any) -> str:
    return as_contract(contract).fingerprint()


def get_history(contract: Any, store: HistoryStore, limit: int | None = None, since=None, failed_only: bool = False) -> list[dict[str, Any]]:
    return [r.asDict() for r in store.runs(_fp(contract), since, failed_only, limit).collect()]


def get_run(contract: Any, store: HistoryStore, run_id: str | None = None, at=None) -> dict[str, Any] | None:
    return store.run(_fp(contract), run_id, at=at)


def has_runs(contract: Any, store: HistoryStore) -> bool:
    return store.has_runs(_fp(contract))


def diff(contract: Any, store: HistoryStore, old: str | None = None, new: str | None = None) -> dict[str, Any] | None:
    """Changes between two runs by kind, and whether something got worse."""
    found = store.diff(_fp(contract), old, new)
    if found is None:
        return None
    rows = [r.asDict() for r in found.orderBy("rule_id").collect()]
    kinds = {k: [r for r in rows if r["change"] == k] for k in ("new_failure", "resolved", "regression", "improvement", "unchanged")}
    return kinds | {"worse": bool(kinds["new_failure"] or kinds["regression"])}


def annotate(contract: Any, store: HistoryStore, note: str, run_id: str | None = None, **more: Any) -> None:
    run = store.run(_fp(contract), run_id)
    if run is None:
        raise LookupError("no such run")
    store.annotate(_fp(contract), run["run_id"], note, **more)


def get_annotations(contract: Any, store: HistoryStore, run_id: str | None = None, rule_id: str | None = None) -> list[dict[str, Any]]:
    return [r.asDict() for r in store.annotations(_fp(contract), run_id, rule_id).collect()]


def get_run_with_annotations(contract: Any, store: HistoryStore, run_id: str | None = None) -> dict[str, Any] | None:
    run = get_run(contract, store, run_id)
    return run and run | {"annotations": get_annotations(contract, store, run["run_id"])}


def list_profiles(store: HistoryStore, source: str | None = None) -> list[dict[str, Any]]:
    return [r.asDict() for r in store.profiles(source).select("profile_id", "source", "created_at").collect()]


def get_profile(store: HistoryStore, source: str, profile_id: str | None = None) -> profiler.DatasetProfile | None:
    return store.profile(source, profile_id)


def profile_diff(store: HistoryStore, source: str) -> dict[str, Any] | None:
    """Difference of a source's last two profiles."""
    two = [r["profile_id"] for r in store.profiles(source).limit(2).collect()]
    return profiler.compare_profiles(store.profile(source, two[1]), store.profile(source, two[0])) if len(two) == 2 else None


def _renamed(old: str, new: str) -> Callable:
    def run(*args: Any, **kwargs: Any) -> Any:
        warnings.warn(f"{old} is deprecated, use {new}", DeprecationWarning, stacklevel=2)
        return globals()[new](*args, **kwargs)

    run.__name__, run.__doc__ = old, f"The former name of ``{new}``."
    return run


scout, suggest_rules, scout_diff, list_runs = _renamed("scout", "profile"), _renamed("suggest_rules", "draft"), _renamed("scout_diff", "profile_diff"), _renamed("list_runs", "get_history")


def list_rules() -> list[dict[str, Any]]:
    return [describe_rule(n) for n in sorted(REGISTRY)]


def describe_rule(name: str) -> dict[str, Any]:
    kind = REGISTRY[name]
    scope = "dataset" if not kind.uses or kind is Dtype or issubclass(kind, CustomSql) else "row" if kind.mask is not Rule.mask else "column"
    return {"name": name, "built_in": name in BUILT_IN_RULES, "needs": list(kind.uses), "scope": scope, "failure_mode": kind.mode, "about": (kind.__doc__ or "").strip()}


def health(spark: SparkSession | None = None) -> dict[str, Any]:
    import pyspark

    return {"version": "0.1.0", "spark": pyspark.__version__, "rules": len(REGISTRY), "datasources": sorted(config().get("datasources") or {})}


def validate_decorator(contract: Any = None, rules: list[Any] | None = None, on_fail: str | Callable = "raise") -> Callable:
    """Validate what a function returns; on failure raise, warn, return the result instead, or call ``on_fail(result, data)``."""
    if not callable(on_fail) and on_fail not in ("raise", "warn", "return_result"):
        raise ValueError(f"{on_fail!r} isn't a way to fail")

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args: Any, **kwargs: Any) -> Any:
            data = f(*args, **kwargs)
            result = validate(data, contract, rules=rules)
            if on_fail == "return_result":
                return result
            if not result.passed:
                if on_fail == "raise":
                    raise ValidationFailed(result)
                if on_fail == "warn":
                    logging.getLogger(__name__).warning(result.to_llm())
                else:
                    return on_fail(result, data)
            return data

        return run

    return wrap
