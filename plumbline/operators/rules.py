"""The built-in rules as Catalyst expressions, and the hooks for rules of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.conditions import compared, parse
from plumbline.functions.literals import FLOATS, NUMBERS, STRINGS, TIMES, UNUSABLE, col, duration, literal_for, moment, time_literal
from plumbline.model import SEVERITIES, ContractError, DuplicateRuleError, RuleSpec

REGISTRY: dict[str, type[Rule]] = {}
_BUILT_IN: set[str] = set()


def register_rule(name: str) -> Callable[[type[Rule]], type[Rule]]:
    """Class decorator that makes a rule known under ``name``; built-in names stay theirs."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name or ""):
        raise ContractError(f"{name!r} isn't a rule name")
    if name in _BUILT_IN:
        raise ContractError(f"{name} is a built-in rule")

    def add(kind: type[Rule]) -> type[Rule]:
        kind.rule_name = name
        REGISTRY[name] = kind
        return kind

    return add


class Rule:
    """A rule gives one of: ``mask`` (true where a row violates), ``aggregate`` (violations as an aggregate), or
    ``validate`` (a dict with ``passed`` and ``failed_count`` for a whole DataFrame). ``mode`` is its failure mode."""

    rule_name = ""
    mode = "custom_check_failed"
    #: For rules of one's own: whether ``validate`` looks at columns that ``required_columns`` doesn't name.
    needs_all_columns = False
    uses: tuple[str, ...] = ("column",)

    def __init__(self, spec: RuleSpec):
        self.spec, self.params = spec, spec.params
        self.severity, self.tally, self.context = spec.severity, spec.tally, spec.context
        if self.severity not in SEVERITIES:
            raise ContractError(f"{spec.severity!r} isn't a severity")
        for p in self.uses:
            if not isinstance(self.params.get(p), str) or not self.params[p]:
                raise ContractError(f"{self.rule_name} needs {p}")
        self.rule_id = spec.id or self.default_id()
        self.setup()

    def default_id(self) -> str:
        column = self.params.get("column")
        return f"COL:{column}:{self.rule_name}" if column else f"DATASET:{self.rule_name}"

    def setup(self) -> None:
        """Check parameters."""

    @property
    def column(self) -> str | None:
        return self.params.get("column")

    def required_columns(self) -> list[str]:
        return [self.params[p] for p in self.uses if p in self.params]

    def problem(self, schema: T.StructType) -> str | None:
        """Why the rule can't be evaluated on this schema, other than by missing columns."""
        return None

    def mask(self, schema: T.StructType) -> Column | None:
        return None

    def sample_mask(self, schema: T.StructType) -> Column | None:
        return self.mask(schema)

    def aggregate(self, schema: T.StructType) -> Column | None:
        return None

    def message(self, failed: int) -> str:
        return f"{failed} violations of {self.rule_name}" + (f" in {self.column}" if self.column else "")

    def _type(self, schema: T.StructType, name: str | None = None) -> T.DataType:
        return schema[name or self.column].dataType


class NotNull(Rule):
    mode = "null_values"

    def default_id(self) -> str:
        return super().default_id() + (":include_nan" if self.params.get("include_nan") else "")

    def mask(self, schema):
        c = col(self.column)
        nan = self.params.get("include_nan") and isinstance(self._type(schema), FLOATS)
        return c.isNull() | F.isnan(c) if nan else c.isNull()

    def message(self, failed):
        return f"{self.column} had {failed} NULL values"


class Unique(Rule):
    mode = "duplicate_values"

    def message(self, failed):
        return f"{self.column} had {failed} duplicate values"


class _Values(Rule):
    def setup(self):
        if not isinstance(self.params.get("values"), list | tuple):
            raise ContractError(f"{self.rule_name} needs a list of values")
        self.values = list(self.params["values"])

    def inside(self, schema) -> Column:
        """Whether the value is in the list; null for a null value."""
        kind = self._type(schema)
        usable = [v for x in self.values if x is not None and (v := literal_for(x, kind)) is not UNUSABLE]
        if not usable:
            return F.when(col(self.column).isNotNull(), F.lit(False))
        times = isinstance(kind, TIMES)
        return col(self.column).isin([time_literal(v, kind) if times else v for v in usable])


class AllowedValues(_Values):
    mode = "novel_category"

    def setup(self):
        super().setup()
        if not self.values:
            raise ContractError("allowed_values needs at least one value")

    def mask(self, schema):
        return F.coalesce(~self.inside(schema), F.lit(None not in self.values))

    def message(self, failed):
        return f"{self.column} had {failed} values that aren't allowed"


class DisallowedValues(_Values):
    mode = "disallowed_value"

    def mask(self, schema):
        return F.coalesce(self.inside(schema), F.lit(False))


def _number(value: Any) -> Any:
    if isinstance(value, str):
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
    return value


class Range(Rule):
    mode = "range_violation"

    def setup(self):
        self.low, self.high = _number(self.params.get("min")), _number(self.params.get("max"))
        if self.low is None and self.high is None:
            raise ContractError(f"{self.rule_name} needs min or max")
        for bound in (self.low, self.high):
            if isinstance(bound, bool):
                raise ContractError("a bound can't be a boolean")
            if bound is not None and not isinstance(bound, int | float) and moment(bound) is None:
                raise ContractError(f"{bound!r} isn't a number, date or time")
        if self.low is not None and self.high is not None:
            if isinstance(self.low, int | float) != isinstance(self.high, int | float):
                raise ContractError("min and max differ in kind")
            a, b = (self.low, self.high) if isinstance(self.low, int | float) else (moment(self.low), moment(self.high))
            if (a.tzinfo is None) != (b.tzinfo is None) if isinstance(a, datetime) else False:
                a, b = (x if x.tzinfo else x.replace(tzinfo=UTC) for x in (a, b))
            if a > b:
                raise ContractError("min is over max")

    def bounds(self, schema) -> list[Any]:
        return [None if b is None else literal_for(b, self._type(schema)) for b in (self.low, self.high)]

    def problem(self, schema):
        if any(b is UNUSABLE for b in self.bounds(schema)):
            return f"{self.column} of type {self._type(schema).simpleString()} can't be compared with the bounds"
        return None

    def parts(self, schema) -> tuple[Column, Column]:
        """(below min, above max); false for null."""
        kind, c = self._type(schema), col(self.column)
        low, high = self.bounds(schema)
        put = (lambda b: time_literal(b, kind)) if isinstance(kind, TIMES) else F.lit
        below = F.coalesce(c < put(low), F.lit(False)) if low is not None else F.lit(False)
        above = F.coalesce(c > put(high), F.lit(False)) if high is not None else F.lit(False)
        return below, above

    def mask(self, schema):
        below, above = self.parts(schema)
        out = col(self.column).isNull() | below | above
        return out | F.isnan(col(self.column)) if isinstance(self._type(schema), FLOATS) else out

    def message(self, failed):
        return f"{self.column} had {failed} values outside [{self.params.get('min')}, {self.params.get('max')}]"


class Length(Rule):
    mode = "length_violation"

    def setup(self):
        self.low, self.high = self.params.get("min"), self.params.get("max")
        for b in (self.low, self.high):
            if b is not None and (isinstance(b, bool) or not isinstance(b, int) or b < 0):
                raise ContractError("length bounds are integers of at least 0")
        if self.low is None and self.high is None or self.low is not None and self.high is not None and self.low > self.high:
            raise ContractError("length needs min or max, min not over max")

    def mask(self, schema):
        n = F.length(col(self.column).cast("string"))
        out = n.isNull()
        if self.low is not None:
            out |= n < self.low
        if self.high is not None:
            out |= n > self.high
        return F.coalesce(out, F.lit(True))


class _Text(Rule):
    mode = "pattern_mismatch"
    key = ""

    def setup(self):
        if not isinstance(self.params.get(self.key), str) or not self.params[self.key]:
            raise ContractError(f"{self.rule_name} needs {self.key}")

    def holds(self, c: Column) -> Column:
        raise NotImplementedError

    def mask(self, schema):
        return F.coalesce(~self.holds(col(self.column).cast("string")), F.lit(True))


class Regex(_Text):
    key = "pattern"

    def setup(self):
        super().setup()
        pattern = self.params["pattern"]
        if re.search(r"\(\?(=|!|<=|<!)", pattern):
            raise ContractError("lookaround isn't part of the patterns that all engines share")
        if re.search(r"(?<!\\)(\\\\)*\\[1-9]", pattern):
            raise ContractError("backreferences aren't part of the patterns that all engines share")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ContractError(f"pattern {pattern!r}: {e}") from None

    def holds(self, c):
        return c.rlike(self.params["pattern"])


class Contains(_Text):
    key = "substring"

    def holds(self, c):
        return c.contains(self.params["substring"])


class StartsWith(_Text):
    key = "prefix"

    def holds(self, c):
        return c.startswith(self.params["prefix"])


class EndsWith(_Text):
    key = "suffix"

    def holds(self, c):
        return c.endswith(self.params["suffix"])


_SIGNED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DTYPES: dict[str, tuple[type[T.DataType], ...]] = {
    "int8": (T.ByteType,), "int16": (T.ShortType,), "int32": (T.IntegerType,), "int64": (T.LongType,),
    "uint8": (), "uint16": (), "uint32": (), "uint64": (),
    "float32": (T.FloatType,), "float64": (T.DoubleType,), "double": (T.DoubleType,), "float": FLOATS,
    "int": _SIGNED, "integer": _SIGNED, "numeric": (*_SIGNED, *FLOATS),
    "string": STRINGS, "str": STRINGS, "text": STRINGS, "utf8": STRINGS, "utf-8": STRINGS,
    "bool": (T.BooleanType,), "boolean": (T.BooleanType,), "date": (T.DateType,), "datetime": (T.TimestampType, T.TimestampNTZType), "time": (),
}


class Dtype(Rule):
    mode = "schema_drift"

    def setup(self):
        self.wanted = str(self.params.get("type", "")).strip().lower()
        if self.wanted not in _DTYPES:
            raise ContractError(f"{self.params.get('type')!r} isn't a type")
        if self.params.get("mode", "strict") != "strict":
            raise ContractError("dtype knows the mode strict only")

    def matches(self, schema) -> bool:
        return isinstance(self._type(schema), _DTYPES[self.wanted]) if _DTYPES[self.wanted] else False


class Compare(Rule):
    mode = "comparison_failure"
    uses = ("left", "right")

    def setup(self):
        if self.params.get("op") not in ("==", "!=", ">", ">=", "<", "<="):
            raise ContractError(f"{self.params.get('op')!r} isn't a comparison")

    def problem(self, schema):
        kinds = [self._type(schema, self.params[s]) for s in ("left", "right")]
        for family in (NUMBERS, STRINGS, TIMES, (T.BooleanType,)):
            if all(isinstance(k, family) for k in kinds):
                return None
        return f"{kinds[0].simpleString()} can't be compared with {kinds[1].simpleString()}"

    def mask(self, schema):
        left, right = col(self.params["left"]), col(self.params["right"])
        return left.isNull() | right.isNull() | ~F.coalesce(compared(left, self.params["op"], right), F.lit(False))


class _Conditional(Rule):
    def setup(self):
        self.when = parse(self.params.get("when", ""))

    def required_columns(self):
        return [self.column, self.when.column]


class ConditionalNotNull(_Conditional):
    mode = "conditional_null"

    def mask(self, schema):
        return self.when.to_column(schema) & col(self.column).isNull()


class ConditionalRange(_Conditional, Range):
    mode = "conditional_range_violation"

    def setup(self):
        _Conditional.setup(self)
        Range.setup(self)

    def mask(self, schema):
        below, above = self.parts(schema)
        return self.when.to_column(schema) & (col(self.column).isNull() | below | above)


class _Rows(Rule):
    uses = ()

    def setup(self):
        n = self.params.get("threshold", self.params.get("value"))
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ContractError(f"{self.rule_name} needs a threshold of at least 0")
        self.threshold = n


class MinRows(_Rows):
    mode = "row_count_low"

    def aggregate(self, schema):
        return F.greatest(F.lit(0).cast("long"), F.lit(self.threshold) - F.count(F.lit(1)))


class MaxRows(_Rows):
    mode = "row_count_high"

    def aggregate(self, schema):
        return F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - F.lit(self.threshold))


class Freshness(Rule):
    """Fails once if the newest moment is older than ``max_age`` before ``as_of`` (now by default), or if there is none."""

    mode = "freshness_lag"

    def setup(self):
        self.age = duration(self.params.get("max_age", ""))
        self.as_of = self.params.get("as_of")
        if self.as_of is not None and moment(self.as_of) is None:
            raise ContractError(f"{self.as_of!r} isn't a moment")

    def problem(self, schema):
        if not isinstance(self._type(schema), (*TIMES, *STRINGS)):
            return f"{self.column} of type {self._type(schema).simpleString()} holds no moments"
        return None

    def aggregate(self, schema):
        now = moment(self.as_of) if self.as_of is not None else datetime.now(UTC)
        limit = (now if now.tzinfo else now.replace(tzinfo=UTC)) - self.age
        c = col(self.column)
        kind = self._type(schema)
        if isinstance(kind, STRINGS):
            c, kind = F.try_to_timestamp(c).cast("timestamp_ntz"), T.TimestampNTZType()
        elif isinstance(kind, T.DateType):
            c, kind = c.cast("timestamp_ntz"), T.TimestampNTZType()
        bound = time_literal(limit if isinstance(kind, T.TimestampType) else limit.replace(tzinfo=None), kind)
        return F.when(F.coalesce(F.max(c) >= bound, F.lit(False)), F.lit(0).cast("long")).otherwise(F.lit(1).cast("long"))


class CustomSql(Rule):
    """Violations are the rows that the query gives, or the value of a lone COUNT(*); up to ``threshold`` pass."""

    uses = ()

    def setup(self):
        self.sql = self.params.get("sql", self.params.get("query"))
        self.threshold = self.params.get("threshold", 0)
        if not isinstance(self.sql, str) or not self.sql.strip():
            raise ContractError("custom_sql_check needs sql")
        if isinstance(self.threshold, bool) or not isinstance(self.threshold, int) or self.threshold < 0:
            raise ContractError("custom_sql_check needs a threshold of at least 0")


BUILT_IN_RULES = {"not_null": NotNull, "unique": Unique, "allowed_values": AllowedValues, "disallowed_values": DisallowedValues, "range": Range, "length": Length, "regex": Regex, "contains": Contains, "starts_with": StartsWith, "ends_with": EndsWith, "dtype": Dtype, "compare": Compare, "conditional_not_null": ConditionalNotNull, "conditional_range": ConditionalRange, "min_rows": MinRows, "max_rows": MaxRows, "freshness": Freshness, "custom_sql_check": CustomSql}
for _name, _kind in BUILT_IN_RULES.items():
    register_rule(_name)(_kind)
_BUILT_IN.update(BUILT_IN_RULES)


class BrokenRule(Rule):
    """Stands for a rule of one's own whose constructor failed; the run goes on and it fails."""

    uses = ()

    def __init__(self, spec: RuleSpec, error: Exception):
        super().__init__(RuleSpec(spec.name, {}, spec.id, spec.severity, spec.tally, spec.context))
        self.params, self.error = spec.params, error
        self.rule_id = spec.id or self.default_id()

    def default_id(self) -> str:
        column = self.params.get("column")
        return f"COL:{column}:{self.spec.name}" if column else f"DATASET:{self.spec.name}"


def build_rules(specs: list[RuleSpec]) -> list[Rule]:
    rules: list[Rule] = []
    for spec in specs:
        kind = REGISTRY.get(spec.name)
        if kind is None:
            raise ContractError(f"no rule is named {spec.name!r}; known: {', '.join(sorted(REGISTRY))}")
        try:
            rules.append(kind(spec))
        except Exception as e:
            if spec.name in _BUILT_IN:
                raise
            rules.append(BrokenRule(spec, e))
    seen: set[str] = set()
    for r in rules:
        if r.rule_id in seen:
            raise DuplicateRuleError(f"two rules have the id {r.rule_id}; give one an id of its own")
        seen.add(r.rule_id)
    return rules


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """One row, ``n``: rows beyond the first of each value that isn't null. Counts are made before the shuffle."""
    counted = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n"))
