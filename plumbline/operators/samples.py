"""Failing rows and what is said about failures."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.literals import STRINGS, col
from plumbline.operators.rules import AllowedValues, Compare, ConditionalNotNull, ConditionalRange, DisallowedValues, Length, NotNull, Range, Rule, Unique, _Text
from plumbline.sources.datasets import shared_folder

UNAVAILABLE = {"passed": "the rule passed", "no_rows": "the rule isn't about rows", "config": "the rule can't be evaluated", "budget": "the sample budget was used up"}


def projection(df: DataFrame, columns: str | Sequence[str] | None, rule: Rule | None = None) -> list[str]:
    """Columns of a sample: all (None), those of the rule (``relevant``), or those named, in a list or with commas."""
    if columns is None:
        return df.columns
    if columns == "relevant":
        wanted = rule.required_columns() if rule else df.columns
    else:
        wanted = [c.strip() for c in columns.split(",")] if isinstance(columns, str) else list(columns)
    return [c for c in wanted if c in df.columns]


def failing_rows(df: DataFrame, rule: Rule, columns: str | Sequence[str] | None = None) -> DataFrame | None:
    """All rows that violate a rule of rows, lazily; for ``unique``, every row of a repeated value with its count."""
    if isinstance(rule, Unique):
        return duplicate_rows(df, rule.column).select(*[col(c) for c in projection(df, columns, rule)], "_duplicate_count")
    mask = rule.sample_mask(df.schema)
    return None if mask is None else df.where(mask).select(*[col(c) for c in projection(df, columns, rule)])


def duplicate_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value, not null, occurs more than once, with ``_duplicate_count``. The counts are made before the
    shuffle and joined back, so a value that fills much of the table isn't gathered in one task."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_duplicate_count")).where("_duplicate_count > 1")
    return df.join(counts, col(column) == F.col("_value")).drop("_value")


def sample(df: DataFrame, rule: Rule, n: int = 5, columns: str | Sequence[str] | None = None, order_by: Sequence[str] = ()) -> list[dict[str, Any]] | None:
    """At most ``n`` (up to 100) failing rows; of ``unique``, those of the most frequent values first."""
    found = failing_rows(df, rule, columns)
    if found is None:
        return None
    keys = [F.desc("_duplicate_count"), col(rule.column)] if isinstance(rule, Unique) and rule.column in found.columns else [F.desc("_duplicate_count")] if isinstance(rule, Unique) else []
    keys += [col(c) for c in order_by if c in found.columns]
    out = found.orderBy(*keys) if keys else found
    return [r.asDict(recursive=True) for r in out.limit(max(0, min(n, 100))).collect()]


def indexed(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``row_index``, from 0, of rows in a stated order (a global number needs one; it is for samples)."""
    return df.withColumn("row_index", F.row_number().over(Window.orderBy(*[col(c) for c in order_by])) - 1)


def positioned(df: DataFrame) -> DataFrame:
    """``row_index``: the row's place in its Parquet file."""
    return df.select("*", F.col("_metadata.row_index").alias("row_index"))


def sample_many(df: DataFrame, rules: Sequence[Rule], n: int = 5) -> DataFrame:
    """Failing rows of many rules of rows in one scan: each row with the ids of the rules that it violates, exploded to
    ``_rule_id``, at most ``n`` a rule, the first of the scan. Where ``n`` is more than Spark cuts before a shuffle, the rows
    are counted first, by a scan of its own, and cut without a rule's rows meeting in one task."""
    masks = [(r.rule_id, m) for r in rules if not isinstance(r, Unique) and (m := r.sample_mask(df.schema)) is not None]
    ids = F.filter(F.array(*[F.when(m, F.lit(i)) for i, m in masks]), lambda x: x.isNotNull())
    each = df.withColumn("_rules", ids).where(F.size("_rules") > 0).withColumn("_rule_id", F.explode("_rules")).drop("_rules")
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return _first_of_many(each, n)
    placed = each.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("_n", F.row_number().over(Window.partitionBy("_rule_id").orderBy("_at"))).where(F.col("_n") <= n).drop("_n", "_at")


#: Places of a block, as a power of two: of a rule, no more rows than that are ranked.
BLOCK_BITS = 16


def _first_of_many(each: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each ``_rule_id``. If a rule has more, the rows are kept in the shared folder, as their places
    must not change between the passes; the block where a rule's first row too many stands is found by counts, its place by
    ranks, and the rows before it by a filter."""
    if each.groupBy("_rule_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n).isEmpty():
        return each
    context = each.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(each.sparkSession))
    placed = each.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    rule, at, block = F.col("_rule_id"), F.col("_at"), F.shiftright("_at", BLOCK_BITS)
    of_rule = lambda values: F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in values.items()], F.lit(None))
    counts = placed.groupBy("_rule_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_rule_id").orderBy("block")) - F.col("n")
    last = counts.withColumn("before", before).where((F.col("before") <= n) & (F.col("before") + F.col("n") > n)).collect()
    ranked = placed.where(block == of_rule({r["_rule_id"]: r["block"] for r in last})).select("_rule_id", "_at", F.row_number().over(Window.partitionBy("_rule_id").orderBy("_at")).alias("n"))
    ends = ranked.where(F.col("n") == of_rule({r["_rule_id"]: n - r["before"] + 1 for r in last})).collect()
    return placed.where(F.coalesce(at < of_rule({r["_rule_id"]: r["_at"] for r in ends}), F.lit(True))).drop("_at")


def top_values(df: DataFrame, column: str, mask=None, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values that aren't null among the rows of ``mask``; ties by value."""
    rows = df.where(col(column).isNotNull() if mask is None else mask & col(column).isNotNull())
    return rows.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def positions(df: DataFrame, mask, n: int = 5) -> list[Any]:
    """Where the first rows of a mask stand in their files: row numbers, with the file's name if there are several; empty if
    the data aren't read from files that tell."""
    try:
        placed = df.where(mask).select("_metadata.file_name", "_metadata.row_index")
    except Exception:
        return []
    rows = placed.orderBy("file_name", "row_index").limit(n).collect()
    several = len(df.inputFiles()) > 1
    return [f"{r[0]}:{r[1]}" if several else r[1] for r in rows]


#: Positions are looked for where there are so many violations at most.
MOST_FOR_POSITIONS = 1000


def explain_failure(df: DataFrame, rule: Rule, n: int = 5) -> dict[str, Any]:
    """Details of a failed rule: frequent values, counts of the kinds of violation, first mismatches."""
    schema = df.schema
    if isinstance(rule, AllowedValues | DisallowedValues):
        key = "unexpected_values" if isinstance(rule, AllowedValues) else "found_values"
        return {key: [{"value": r["value"], "count": r["n"]} for r in top_values(df, rule.column, rule.mask(schema)).collect()]}
    if isinstance(rule, Unique):
        groups = df.groupBy(col(rule.column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        top = groups.orderBy(F.desc("n"), "value").limit(10).collect()
        return {"duplicate_value_count": groups.count(), "top_duplicates": [{"value": r["value"], "count": r["n"]} for r in top]}
    if isinstance(rule, ConditionalRange | ConditionalNotNull):
        holds, null = rule.when.to_column(schema), col(rule.column).isNull()
        more = {"below_min": F.count_if(holds & rule.parts(schema)[0]), "above_max": F.count_if(holds & rule.parts(schema)[1])} if isinstance(rule, Range) else {}
        out = df.agg(F.count_if(holds).alias("rows_matching_condition"), F.count_if(holds & null).alias("null_count"), *[c.alias(k) for k, c in more.items()]).first().asDict()
        bad = sum(v for k, v in out.items() if k != "rows_matching_condition")
        return out | ({"sample_positions": found} if 0 < bad <= MOST_FOR_POSITIONS and (found := positions(df, rule.mask(schema), n)) else {})
    if isinstance(rule, Range):
        below, above = rule.parts(schema)
        c = col(rule.column)
        return df.agg(F.min(c).alias("actual_min"), F.max(c).alias("actual_max"), F.count_if(below).alias("below_min"), F.count_if(above).alias("above_max"), F.count_if(c.isNull()).alias("null_count")).first().asDict()
    if isinstance(rule, NotNull):
        r = df.agg(F.count_if(rule.mask(schema)).alias("null_count"), F.count(F.lit(1)).alias("rows")).first()
        out = {"null_count": r["null_count"], "null_rate": round(r["null_count"] / r["rows"], 4) if r["rows"] else 0.0, "total_rows": r["rows"]}
        return out | ({"sample_positions": found} if 0 < r["null_count"] <= MOST_FOR_POSITIONS and (found := positions(df, rule.mask(schema), n)) else {})
    if isinstance(rule, Compare):
        left, right = (col(rule.params[s]) for s in ("left", "right"))
        r = df.agg(F.count_if(rule.mask(schema)).alias("failed"), F.count_if(left.isNull()).alias("left_null_count"), F.count_if(right.isNull()).alias("right_null_count"), F.count(F.lit(1)).alias("rows")).first()
        return {"failure_rate": round(r["failed"] / r["rows"], 4) if r["rows"] else 0.0, "left_null_count": r["left_null_count"], "right_null_count": r["right_null_count"]}
    if isinstance(rule, Length | _Text) and isinstance(schema[rule.column].dataType, STRINGS):
        return {"sample_mismatches": [r[0] for r in df.where(rule.mask(schema)).select(col(rule.column)).limit(n).collect()]}
    return {}
