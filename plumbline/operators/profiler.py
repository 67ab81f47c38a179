"""Column profiles, contract drafts and profile differences."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.literals import FLOATS, NUMBERS, STRINGS, TIMES, col
from plumbline.functions.patterns import PATTERNS, SHARE
from plumbline.model import ContractError, RuleSpec
from plumbline.operators.percentiles import exact_percentiles

#: What each preset looks at. ``metadata`` presets read no rows if footers answer.
PRESETS: dict[str, dict[str, Any]] = {
    "scout": {"metadata": True, "statistics": False, "top": 0, "distinct": 0, "samples": 0, "patterns": False, "percentiles": ()},
    "scan": {"metadata": False, "statistics": True, "top": 5, "distinct": 20, "samples": 5, "patterns": False, "percentiles": ()},
    "interrogate": {"metadata": False, "statistics": True, "top": 10, "distinct": 50, "samples": 10, "patterns": True, "percentiles": (25, 50, 75, 99)},
}
PRESETS |= {"lite": PRESETS["scout"], "standard": PRESETS["scan"], "deep": PRESETS["interrogate"], "llm": PRESETS["scan"]}


def normal_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType | T.FloatType | T.DoubleType):
        return "float"
    for name, kinds in (("int", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)), ("bool", (T.BooleanType,)), ("string", STRINGS), ("date", (T.DateType,)), ("datetime", (T.TimestampType, T.TimestampNTZType)), ("interval", (T.DayTimeIntervalType, T.YearMonthIntervalType)), ("binary", (T.BinaryType,))):
        if isinstance(kind, kinds):
            return name
    return "unknown"


def finite(name: str, kind: T.DataType) -> Column:
    c = col(name)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if isinstance(kind, FLOATS) else c


def countable(kind: T.DataType) -> bool:
    return not isinstance(kind, T.MapType | T.VariantType)


def column_aggregates(name: str, kind: T.DataType, statistics: bool = True) -> dict[str, Column]:
    """The aggregates of one column, named by measure, but for the number of distinct values and percentiles."""
    c = col(name)
    out: dict[str, Column] = {"nulls": F.count_if(c.isNull())}
    if statistics and isinstance(kind, NUMBERS):
        x = finite(name, kind)
        out |= {"min": F.min(x), "max": F.max(x), "mean": F.avg(x.cast("double")), "std": F.stddev_samp(x.cast("double"))}
    elif statistics and isinstance(kind, STRINGS):
        out |= {"min_len": F.min(F.length(c)), "max_len": F.max(F.length(c)), "avg_len": F.avg(F.length(c)), "empty": F.count_if(c == "")}
    elif statistics and isinstance(kind, TIMES):
        out |= {"min": F.min(c), "max": F.max(c)}
    return out


def percentiles_of(df: DataFrame, columns: list[str], percentiles: tuple[int, ...] = ()) -> dict[str, dict[str, float | None]]:
    """The median and ``percentiles`` (of 100) of each numeric column, exactly, infinite values and NaN left out."""
    names = {"median": 0.5} | {f"p{p}": p / 100 for p in percentiles}
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NUMBERS)]
    found = exact_percentiles(df, {c: (finite(c, df.schema[c].dataType), list(names.values())) for c in numeric})
    return {c: dict(zip(names, v, strict=True)) for c, v in found.items()}


def profile_aggregates(df: DataFrame, columns: list[str], statistics: bool = True) -> DataFrame:
    """One row with ``rows`` and each column's measures as ``measure__column``; one scan."""
    exprs = [a.alias(f"{k}__{c}") for c in columns for k, a in column_aggregates(c, df.schema[c].dataType, statistics).items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *exprs)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct): the values that aren't null, of each column by an aggregation of its own in one job. A row isn't
    expanded for every column, and the shuffle carries each value once for each task."""
    each = [df.where(col(c).isNotNull()).select(col(c).alias("v")).distinct().agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(c).alias("column"), "distinct") for c in columns]
    return reduce(DataFrame.unionByName, each)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n) of values that aren't null, for all columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_per_column(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent values of each column; ties by value. Each column takes an ordered limit of its own, which
    keeps ``n`` rows a task, so no column's values are gathered."""
    counted = [df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n).select(F.lit(c).alias("column"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, counted)


def pattern_shares(df: DataFrame, column: str, sample: int | None = 100) -> DataFrame:
    """One row: the share of up to ``sample`` (None: all) non-blank values with each shape."""
    some = df.select(col(column).cast("string").alias("v")).where("v is not null and trim(v) != ''")
    some = some if sample is None else some.limit(sample)
    return some.agg(*[F.coalesce(F.count_if(F.col("v").rlike(p)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias(n) for n, p in PATTERNS.items()])


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    native_type: str
    rows: int
    nulls: int | None = None
    distinct: int | None = None
    stats: dict[str, Any] = field(default_factory=dict)
    top_values: list[dict[str, Any]] = field(default_factory=list)
    values: list[Any] | None = None
    samples: list[Any] = field(default_factory=list)
    constant: Any = None
    patterns: list[str] = field(default_factory=list)
    semantic_type: str | None = None
    estimated: bool = False
    few: bool = False

    @property
    def null_rate(self) -> float | None:
        return None if self.nulls is None else self.nulls / self.rows if self.rows else 0.0

    @property
    def uniqueness_ratio(self) -> float | None:
        filled = None if self.nulls is None else self.rows - self.nulls
        return None if self.distinct is None or filled is None else self.distinct / filled if filled else 0.0


@dataclass
class DatasetProfile:
    source: str
    preset: str
    rows: int
    columns: list[ColumnProfile]
    sampled: bool = False

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def to_dict(self) -> dict[str, Any]:
        return {"source": self.source, "preset": self.preset, "rows": self.rows, "sampled": self.sampled, "columns": [asdict(c) | {"null_rate": c.null_rate, "uniqueness_ratio": c.uniqueness_ratio} for c in self.columns]}

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> DatasetProfile:
        known = set(ColumnProfile.__dataclass_fields__)
        return cls(raw["source"], raw["preset"], raw["rows"], [ColumnProfile(**{k: v for k, v in c.items() if k in known}) for c in raw["columns"]], raw.get("sampled", False))

    def to_json(self, indent: int | None = None) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    def to_llm(self) -> str:
        show = lambda x: "?" if x is None else f"{x:.2%}"
        more = lambda c: "".join([f", {k} {v}" for k, v in c.stats.items() if v is not None], )
        top = lambda c: "; often " + ", ".join(f"{t['value']} ({t['count']})" for t in c.top_values) if c.top_values else ""
        looks = lambda c: "; looks like " + ", ".join(c.patterns) if c.patterns else ""
        return "\n".join([f"{self.source}: {self.rows} rows, {len(self.columns)} columns", *[f"- {c.name} ({c.dtype}{', ' + c.semantic_type if c.semantic_type else ''}): {show(c.null_rate)} null, {'?' if c.distinct is None else c.distinct} distinct{more(c)}{top(c)}{looks(c)}" for c in self.columns]])

    def to_markdown(self) -> str:
        cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
        said = lambda c: [c.name, c.dtype, c.nulls, c.distinct, c.semantic_type, ", ".join(f"{k} {v}" for k, v in c.stats.items() if v is not None), ", ".join(f"{t['value']} ({t['count']})" for t in c.top_values), ", ".join(c.patterns)]
        rows = ["| " + " | ".join(map(cell, said(c))) + " |" for c in self.columns]
        return "\n".join([f"# {self.source}", "", f"{self.rows} rows", "", "| column | type | nulls | distinct | meaning | measures | frequent values | shapes |", "|-|-|-|-|-|-|-|-|", *rows])


def semantic_type(p: ColumnProfile) -> str | None:
    """What a column is for: an identifier if nearly all values differ and none is null, whatever the type; a category if
    it is text of few values; a measure if it is a number of more; a timestamp; booleans are categories."""
    if p.rows and p.nulls == 0 and (p.uniqueness_ratio or 0) >= 0.99:
        return "identifier"
    if p.dtype == "bool" or p.few and p.dtype == "string":
        return "category"
    if p.dtype in ("int", "float"):
        return None if p.few else "measure"
    return "timestamp" if p.dtype in ("date", "datetime") else None


def keep_invariants(p: DatasetProfile) -> list[str]:
    """No column has more nulls or distinct values than rows. An estimate that says so is cut to the rows; where the column's
    count is exact, nothing is changed and a warning given."""
    said = []
    for c in p.columns:
        for what in ("nulls", "distinct"):
            n = getattr(c, what)
            if p.rows and n is not None and n > p.rows:
                if c.estimated:
                    setattr(c, what, p.rows)
                else:
                    said.append(f"{c.name}: {n} {what} of {'about ' if p.sampled else ''}{p.rows} rows")
    return said


def drawn(df: DataFrame, rows: int | None = None, share: float | None = None, how: str = "rows", seed: int = 7) -> tuple[DataFrame, bool]:
    """A sample of ``df`` and whether it is one. ``rows``: exactly so many, drawn alike from all, whose sort keeps so many rows
    a task; or ``share`` of the rows (``how="rows"``: each by chance), of the file splits (``blocks``: whole splits by chance,
    so that the others aren't kept; correlated rows stand together), or the first ones (``head``)."""
    if how == "head":
        return (df, False) if rows is None else (df.limit(rows), True)
    if how == "blocks":
        part = F.xxhash64(F.spark_partition_id(), F.lit(seed))
        some = df.where(F.pmod(part, F.lit(1 << 20)) < int((1 << 20) * (1.0 if share is None else share)))
        return (some, True) if some.limit(1).count() else (df, False)  # of few splits none may be drawn
    if share is not None:
        return df.sample(share, seed), True
    if rows is None:
        return df, False
    return df.orderBy(F.rand(seed)).limit(rows), True


def profile(df: DataFrame, preset: str = "scan", source: str = "data", columns: list[str] | None = None, sample: int | None = None, percentiles: tuple[int, ...] | None = None, footer=None, seed: int = 7, sample_by: str = "rows", sample_share: float | None = None) -> DatasetProfile:
    """Profile a dataset. Jobs don't grow with the columns: one for all aggregates, a few for percentiles, one for distinct
    counts, one for frequent values, one for first values. With a sample (see ``drawn``), rates are estimates."""
    if preset not in PRESETS:
        raise ContractError(f"no preset is named {preset!r}; known: {', '.join(PRESETS)}")
    how = PRESETS[preset]
    shares = how["percentiles"] if percentiles is None else percentiles
    names = [c for c in df.columns if columns is None or c in columns]
    kinds = {c: df.schema[c].dataType for c in names}
    if how["metadata"] and footer is not None:
        made = []
        for c in names:
            nulls = [g[c][0] if c in g else None for g in footer.groups]
            made.append(ColumnProfile(c, normal_type(kinds[c]), kinds[c].simpleString(), footer.rows, None if None in nulls else sum(nulls)))
        return DatasetProfile(source, preset, footer.rows, made)
    df, sampled = drawn(df, sample, sample_share, sample_by, seed)
    row: dict[str, Any] = {}
    for at in range(0, max(1, len(names)), 12):
        row |= profile_aggregates(df, names[at : at + 12], how["statistics"]).first().asDict()
    sampled = sampled and not (sample and row["rows"] < sample)  # fewer rows than asked for are all of them
    out = [ColumnProfile(c, normal_type(kinds[c]), kinds[c].simpleString(), row["rows"], row[f"nulls__{c}"], stats={k.rpartition("__" + c)[0]: v for k, v in row.items() if k.endswith(f"__{c}") and not k.startswith("nulls__")}, estimated=sampled) for c in names]
    if how["statistics"]:
        for at in range(0, len(names), 12):
            for c, found in percentiles_of(df, names[at : at + 12], shares).items():
                next(p for p in out if p.name == c).stats |= found
    usable = [c for c in names if countable(kinds[c])]
    if usable and not how["metadata"]:
        found = {r["column"]: r["distinct"] for r in distinct_counts(df, usable).collect()}
        for p in out:
            p.distinct = found.get(p.name)
    simple = [p.name for p in out if p.dtype not in ("unknown", "binary", "interval")]
    if how["top"] and simple:
        for r in top_per_column(df, simple, how["top"]).collect():
            next(p for p in out if p.name == r["column"]).top_values.append({"value": r["value"], "count": r["n"]})
        few = [p for p in out if p.name in simple and p.distinct is not None and p.distinct <= how["distinct"]]
        if few:
            listed: dict[str, list] = {p.name: [] for p in few}
            for r in value_counts(df, list(listed)).orderBy("column", "value").collect():
                listed[r["column"]].append(r["value"])
            for p in few:
                p.values = listed[p.name]
                p.constant = p.values[0] if p.distinct == 1 else None
    if how["samples"] and simple:
        head = df.select(*[col(c).cast("string").alias(c) for c in simple]).limit(how["samples"] * 4).collect()
        for p in out:
            p.samples = [r[p.name] for r in head if p.name in simple and r[p.name] is not None][: how["samples"]]
    texts = [p for p in out if p.dtype == "string"]
    if how["patterns"] and texts:
        seen = reduce(DataFrame.unionByName, [pattern_shares(df, p.name).withColumn("_column", F.lit(p.name)) for p in texts])
        for r in seen.collect():
            next(p for p in texts if p.name == r["_column"]).patterns = [n for n in PATTERNS if r[n] >= SHARE]
    for p in out:
        p.few = bool(p.distinct) and p.distinct <= how["distinct"]
        p.semantic_type = None if how["metadata"] else semantic_type(p)
    made = DatasetProfile(source, preset, row["rows"], out, sampled)
    for warning in keep_invariants(made):
        logging.getLogger(__name__).warning(warning)
    return made


def classified(df: DataFrame, columns: list[str], low: int = 20, medium: int = 10_000) -> dict[str, tuple[int, str]]:
    """About how many different values each column has, by sketches in one scan, and by that how to profile it: ``low``
    columns by counting values, ``medium`` ones on a sample, ``high`` ones by aggregates alone."""
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(c) for c in columns]).first()
    return {c: (row[c], "low" if row[c] < low else "medium" if row[c] <= medium else "high") for c in columns}


def strategic_profile(df: DataFrame, source: str = "data", top: int = 5, share: float = 0.05, seed: int = 7) -> DatasetProfile:
    """A profile in four jobs at most, for wide tables: nulls exactly and distinct values by sketches in one scan, values of
    columns with few exactly, measures and frequent values of the others on about ``share`` of the file splits."""
    kinds = {c: df.schema[c].dataType for c in df.columns}
    found = classified(df, [c for c in df.columns if countable(kinds[c])])
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(c).isNull()).alias(f"nulls__{c}") for c in df.columns]).first()
    some, sampled = drawn(df, share=share, how="blocks", seed=seed)
    measured = profile_aggregates(some, df.columns).first().asDict()
    out = []
    for c, kind in kinds.items():
        stats = {k.rpartition("__" + c)[0]: v for k, v in measured.items() if k.endswith(f"__{c}") and not k.startswith("nulls__")}
        out.append(ColumnProfile(c, normal_type(kind), kind.simpleString(), row["rows"], row[f"nulls__{c}"], found.get(c, (None,))[0], stats, estimated=True))
    by_name = {p.name: p for p in out}
    simple = {c: how for c, (_, how) in found.items() if by_name[c].dtype not in ("unknown", "binary", "interval")}
    few, some_of = ([c for c, how in simple.items() if how == wanted] for wanted in ("low", "medium"))
    if few:
        for r in value_counts(df, few).orderBy("column", F.desc("n"), "value").collect():
            p = by_name[r["column"]]
            p.values = [*(p.values or []), r["value"]]
            if len(p.top_values) < top:
                p.top_values.append({"value": r["value"], "count": r["n"]})
    if some_of:
        for r in top_per_column(some, some_of, top).collect():
            by_name[r["column"]].top_values.append({"value": r["value"], "count": r["n"]})
    for p in out:
        if p.values is not None:
            p.distinct, p.constant = len(p.values), p.values[0] if len(p.values) == 1 else None
        p.few = bool(p.distinct) and p.distinct <= 20
    made = DatasetProfile(source, "strategic", row["rows"], out, sampled)
    keep_invariants(made)
    for p in out:
        p.semantic_type = semantic_type(p)
    return made


@dataclass
class Suggestion:
    rule: RuleSpec
    confidence: float
    reason: str


def _spec(name: str, column: str | None, **params: Any) -> RuleSpec:
    return RuleSpec(name, ({"column": column} if column else {}) | params)


def _types(c: ColumnProfile) -> str:
    exact = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "string", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    return exact.get(c.native_type, c.dtype)


def draft(p: DatasetProfile, min_confidence: float = 0.5) -> list[Suggestion]:
    """Rules that the profiled data keep, or nearly: nulls, uniqueness, type, values, range of each column, and rows."""
    out = []
    for c in p.columns:
        rate, unique, kind = c.null_rate, c.uniqueness_ratio, _types(c)
        if rate is not None and rate < 0.01:
            out.append(Suggestion(_spec("not_null", c.name), 0.8 if rate else 1.0, f"{rate:.1%} nulls" if rate else "no nulls"))
        if unique is not None and (unique == 1.0 and c.distinct > 1 or 0.99 < unique < 1.0):
            out.append(Suggestion(_spec("unique", c.name), 1.0 if unique == 1.0 else 0.7, f"{unique:.1%} of the values differ"))
        if kind != "unknown":
            out.append(Suggestion(_spec("dtype", c.name, type=kind), 1.0, "the present type"))
        spelled = {"string": str, "int": int, "float": float, "bool": lambda v: v == "true"}.get(c.dtype)
        if c.few and c.values and spelled:  # values are kept as text
            out.append(Suggestion(_spec("allowed_values", c.name, values=[*map(spelled, c.values), *([None] if c.nulls else [])]), 0.9, f"{len(c.values)} values"))
        low, high = c.stats.get("min"), c.stats.get("max")
        if c.dtype in ("int", "float") and low is not None and high is not None:
            as_number = float if c.dtype == "float" else int
            out.append(Suggestion(_spec("range", c.name, min=as_number(low), max=as_number(high)), 0.7, "the present bounds"))
    if p.rows:
        out.append(Suggestion(_spec("min_rows", None, threshold=max(1, int(p.rows * 0.8))), 0.6, "80 % of the present rows"))
    return [s for s in out if s.confidence >= min_confidence]


def draft_yaml(p: DatasetProfile, name: str | None = None, min_confidence: float = 0.5) -> str:
    """A contract file of the drafted rules, with 90 % of the rows, the shapes of text that the profile found, and an age of
    the newest moment, which is a guess."""
    import yaml

    rules = [s.rule for s in draft(p, min_confidence) if s.rule.name != "min_rows"]
    for c in p.columns:
        rules += [_spec("regex", c.name, pattern=PATTERNS[shape]) for shape in c.patterns[:1] if c.nulls == 0]
        if c.dtype == "datetime" and c.stats.get("max") is not None:
            rules.append(RuleSpec("freshness", {"column": c.name, "max_age": "7d"}, severity="warning"))
    if int(p.rows * 0.9):
        rules.insert(0, _spec("min_rows", None, threshold=int(p.rows * 0.9)))
    listed = [{"name": r.name, "params": r.params} | ({} if r.severity == "blocking" else {"severity": r.severity}) for r in rules]
    return yaml.safe_dump({"name": name or "draft", "datasource": p.source, "rules": listed}, sort_keys=False, allow_unicode=True)


def compare_profiles(a: DatasetProfile, b: DatasetProfile) -> dict[str, Any]:
    """Differences of two profiles: columns, types, null rates (over 0.1 points changed, over 1 significant), distinct
    values (over 10 %)."""
    left, right = ({c.name: c for c in p.columns} for p in (a, b))
    changes = []
    for n in [n for n in left if n in right]:
        x, y, found = left[n], right[n], {}
        if x.dtype != y.dtype:
            found["dtype"] = (x.dtype, y.dtype)
        if x.null_rate is not None and y.null_rate is not None and abs(y.null_rate - x.null_rate) > 0.001:
            found["null_rate"] = (x.null_rate, y.null_rate)
            found["significant"] = abs(y.null_rate - x.null_rate) > 0.01
        if x.distinct is not None and y.distinct is not None and abs(y.distinct - x.distinct) > 0.1 * max(1, x.distinct):
            found["distinct"] = (x.distinct, y.distinct)
        if found:
            changes.append({"column": n, **found})
    return {"rows": (a.rows, b.rows), "row_delta": b.rows - a.rows, "columns_added": [n for n in right if n not in left], "columns_removed": [n for n in left if n not in right], "changes": changes}
