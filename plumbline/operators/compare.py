"""Two-dataset probes: before against after, and the relationship of two keyed sets."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.literals import NUMBERS, col
from plumbline.model import ContractError

_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def _keys(key: str | Sequence[str] | None, before: str | Sequence[str] | None, after: str | Sequence[str] | None) -> tuple[list[str], list[str]]:
    as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
    left, right = as_list(before or key), as_list(after or key)
    if not left or len(left) != len(right):
        raise ContractError("both sides need the same number of key columns")
    return left, right


def _keyed(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ContractError(f"{side} has no column {', '.join(missing)}")
    rest = [c for c in df.columns if c not in keys]
    return df.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[col(c).alias(f"{side}.{c}") for c in rest])


def _differs(a: Column, b: Column, x: T.DataType, y: T.DataType) -> Column:
    """Null-safe inequality; moments by their microseconds, numbers as they are, other pairs of types as text."""
    if isinstance(x, _TIMESTAMPS) and isinstance(y, _TIMESTAMPS) and type(x) is not type(y):
        a = F.unix_micros(a) if isinstance(x, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), a)
        b = F.unix_micros(b) if isinstance(y, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), b)
    elif type(x) is not type(y) and not (isinstance(x, NUMBERS) and isinstance(y, NUMBERS)):
        a, b = a.cast("string"), b.cast("string")
    return ~a.eqNullSafe(b)


class Report(dict):
    """Facts by name, also as text."""

    def to_dict(self) -> dict[str, Any]:
        return dict(self)

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self, indent=indent, default=str)

    def to_llm(self) -> str:
        """One line a fact; samples last, a few rows each."""
        lines = [f"{k}: {v}" for k, v in self.items() if k != "samples" and v not in ({}, [], None)]
        for name, rows in self.get("samples", {}).items():
            lines += [f"{name}:", *[f"- {r}" for r in rows]] if rows else []
        return "\n".join(lines)


class Comparison:
    """The parts of a comparison as lazy DataFrames; ``facts`` has one row, the other methods rows of keys."""

    def __init__(self, before: DataFrame, after: DataFrame, key=None, before_key=None, after_key=None):
        self.left_keys, self.right_keys = _keys(key, before_key, after_key)
        self.before_columns, self.after_columns = before.columns, after.columns
        rest_before = [c for c in before.columns if c not in self.left_keys]
        rest_after = [c for c in after.columns if c not in self.right_keys]
        self.common = [c for c in rest_before if c in rest_after]
        self.added = [c for c in rest_after if c not in rest_before]
        self.removed = [c for c in rest_before if c not in rest_after]
        self.kinds = {c: (before.schema[c].dataType, after.schema[c].dataType) for c in self.common}
        self.b, self.a = _keyed(before, self.left_keys, "before"), _keyed(after, self.right_keys, "after")
        self.keys = [f"_k{i}" for i in range(len(self.left_keys))]

    def _any_null(self) -> Column:
        out = F.lit(False)
        for k in self.keys:
            out = out | F.col(k).isNull()
        return out

    def differences(self) -> dict[str, Column]:
        return {c: _differs(F.col(f"`before.{c}`"), F.col(f"`after.{c}`"), *self.kinds[c]) for c in self.common}

    def joined(self) -> DataFrame:
        """Rows that match on the keys; repeated keys multiply, null keys never match."""
        return self.b.join(self.a, self.keys)

    def _named(self, df: DataFrame, names: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)])

    def dropped_keys(self) -> DataFrame:
        """Keys of before that after lacks; a null key is one that matches nothing."""
        return self._named(self.b.select(*self.keys).distinct().join(self.a.select(*self.keys).distinct(), self.keys, "left_anti"), self.left_keys)

    def added_keys(self) -> DataFrame:
        return self._named(self.a.select(*self.keys).distinct().join(self.b.select(*self.keys).distinct(), self.keys, "left_anti"), self.right_keys)

    def duplicated_keys(self) -> DataFrame:
        """Keys that after holds more than once, with ``n``; the null key counts."""
        return self.a.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(n) for k, n in zip(self.keys, self.right_keys, strict=True)], "n")

    def changed_rows(self) -> DataFrame:
        """Matched rows in which a common column differs: keys, ``changed_columns``, and both values as text."""
        found = self.differences()
        if not found:
            return self._named(self.joined(), self.left_keys).limit(0).withColumn("changed_columns", F.array().cast("array<string>"))
        names = F.filter(F.array(*[F.when(d, F.lit(c)) for c, d in found.items()]), lambda x: x.isNotNull())
        values = [F.col(f"`{s}.{c}`").cast("string").alias(f"{s}_{c}") for c in self.common for s in ("before", "after")]
        return self.joined().select(*[F.col(k).alias(n) for k, n in zip(self.keys, self.left_keys, strict=True)], names.alias("changed_columns"), *values).where(F.size("changed_columns") > 0)

    def facts(self) -> DataFrame:
        """One row of counts. Keys are counted once per side before they meet, so the three counts of keys come from one
        outer join of grouped keys, and the counts of rows from one join."""
        # nulls are counted in the same pass as keys
        nulls_of = lambda side, names: [F.count_if(F.col(f"`{side}.{c}`").isNull()).alias(f"nulls_{side}:{c}") for c in names]
        counted = [*[f"nulls_before:{c}" for c in self.common], *[f"nulls_after:{c}" for c in [*self.common, *self.added]]]
        gb = self.b.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("nb"), *nulls_of("before", self.common))
        ga = self.a.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("na"), *nulls_of("after", [*self.common, *self.added]))
        both = gb.join(ga, self.keys, "full")
        matched = F.col("nb").isNotNull() & F.col("na").isNotNull()
        keys = both.agg(
            F.coalesce(F.sum("nb"), F.lit(0)).alias("before_rows"), F.coalesce(F.sum("na"), F.lit(0)).alias("after_rows"),
            F.count("nb").alias("unique_before"), F.count("na").alias("unique_after"), F.count_if(matched).alias("preserved"), F.count_if(F.col("na") > 1).alias("duplicated_after"),
            *[F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in counted],
        )
        found = self.differences()
        anything = F.lit(False)
        for d in found.values():
            anything = anything | d
        rows = self.joined().agg(F.count(F.lit(1)).alias("matched_rows"), F.count_if(anything).alias("changed_rows"), *[F.count_if(d).alias(f"changed:{c}") for c, d in found.items()])
        # each side is a single row
        return keys.withColumn("_", F.lit(1)).join(rows.withColumn("_", F.lit(1)), "_").drop("_").withColumn("dropped", F.col("unique_before") - F.col("preserved")).withColumn("added", F.col("unique_after") - F.col("preserved"))


def compare(before: DataFrame, after: DataFrame, key=None, before_key=None, after_key=None, sample_limit: int = 5) -> Report:
    """What changed between two datasets: counts, derived rates, columns, and samples of keys and rows."""
    c = Comparison(before, after, key, before_key, after_key)
    f = c.facts().first().asDict()
    changed = {n: f.pop(f"changed:{n}") for n in c.common}
    nulls_before = {n: f.pop(f"nulls_before:{n}") for n in c.common}
    nulls_after = {n: f.pop(f"nulls_after:{n}") for n in [*c.common, *c.added]}
    modified = [n for n in c.common if changed[n]]
    rate = lambda n, rows: n / rows if rows else 0.0
    out = Report(f)
    out["row_delta"] = f["after_rows"] - f["before_rows"]
    out["row_ratio"] = f["after_rows"] / f["before_rows"] if f["before_rows"] else float("inf") if f["after_rows"] else 1.0
    out["unchanged_rows"] = f["matched_rows"] - f["changed_rows"] if c.common else f["preserved"]
    out["columns_added"], out["columns_removed"], out["columns_modified"] = c.added, c.removed, modified
    out["modified_fraction"] = {n: rate(changed[n], f["matched_rows"]) for n in modified}
    out["nullability_delta"] = {n: {"before": rate(nulls_before[n], f["before_rows"]) if n in nulls_before else None, "after": rate(nulls_after[n], f["after_rows"])} for n in [*modified, *c.added]}
    if sample_limit:
        take = lambda df, by: [r.asDict() for r in df.orderBy(*[col(k) for k in by]).limit(sample_limit).collect()]
        out["samples"] = {"duplicated_keys": take(c.duplicated_keys(), c.right_keys), "dropped_keys": take(c.dropped_keys(), c.left_keys), "added_keys": take(c.added_keys(), c.right_keys), "changed_rows": take(c.changed_rows(), c.left_keys)}
    return out


class Relationship:
    """How the keys of two sets meet, as lazy DataFrames."""

    def __init__(self, left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None):
        self.left_keys, self.right_keys = _keys(on, left_on, right_on)
        for df, keys, side in ((left, self.left_keys, "left"), (right, self.right_keys, "right")):
            if missing := [k for k in keys if k not in df.columns]:
                raise ContractError(f"{side} has no column {', '.join(missing)}")
        self.keys = [f"_k{i}" for i in range(len(self.left_keys))]
        self.l = left.select(*[col(k).alias(n) for k, n in zip(self.left_keys, self.keys, strict=True)])
        self.r = right.select(*[col(k).alias(n) for k, n in zip(self.right_keys, self.keys, strict=True)])

    def grouped(self, side: DataFrame) -> DataFrame:
        """Each key without nulls, and its rows ``n``."""
        return side.dropna(subset=self.keys).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))

    def unmatched(self, of: str) -> DataFrame:
        one, other, names = (self.l, self.r, self.left_keys) if of == "left" else (self.r, self.l, self.right_keys)
        found = self.grouped(one).join(self.grouped(other), self.keys, "left_anti")
        return found.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)])

    def measures(self) -> DataFrame:
        """Sixteen measures in one row."""
        nulls = F.lit(False)
        for k in self.keys:
            nulls = nulls | F.col(k).isNull()
        one = lambda df: df.withColumn("_", F.lit(1))
        rate = F.coalesce(F.count_if(nulls) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
        sides = [one(s.agg(F.count(F.lit(1)).alias(f"{n}_rows"), rate.alias(f"{n}_null_rate"))) for n, s in (("left", self.l), ("right", self.r))]
        both = self.grouped(self.l).withColumnRenamed("n", "nl").join(self.grouped(self.r).withColumnRenamed("n", "nr"), self.keys, "full")
        has_l, has_r = F.col("nl").isNotNull(), F.col("nr").isNotNull()
        keys = one(both.agg(
            F.count("nl").alias("left_unique_keys"), F.count_if(F.col("nl") > 1).alias("left_duplicate_keys"), F.min("nl").alias("left_multiplicity_min"), F.max("nl").alias("left_multiplicity_max"),
            F.count("nr").alias("right_unique_keys"), F.count_if(F.col("nr") > 1).alias("right_duplicate_keys"), F.min("nr").alias("right_multiplicity_min"), F.max("nr").alias("right_multiplicity_max"),
            F.count_if(has_l & has_r).alias("left_keys_with_match"), F.count_if(has_l & ~has_r).alias("left_keys_without_match"), F.count_if(has_l & has_r).alias("right_keys_with_match"), F.count_if(~has_l & has_r).alias("right_keys_without_match"),
        ))
        return sides[0].join(sides[1], "_").join(keys, "_").drop("_")


def profile_relationship(left: DataFrame, right: DataFrame, on=None, left_on=None, right_on=None, sample_limit: int = 5) -> Report:
    r = Relationship(left, right, on, left_on, right_on)
    out = Report(r.measures().first().asDict())
    if sample_limit:
        take = lambda df, by: [x.asDict() for x in df.orderBy(*[col(k) for k in by]).limit(sample_limit).collect()]
        named = r.grouped(r.r).where("n > 1").select(*[F.col(k).alias(n) for k, n in zip(r.keys, r.right_keys, strict=True)], "n")
        out["samples"] = {"left_without_match": take(r.unmatched("left"), r.left_keys), "right_without_match": take(r.unmatched("right"), r.right_keys), "right_duplicate_keys": take(named, r.right_keys)}
    return out
