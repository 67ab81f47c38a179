"""Queries of the engine's operators over the driver's tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import RuleSpec
from plumbline.operators import history, profiler, samples
from plumbline.operators.compare import Comparison, Relationship
from plumbline.operators.compare import compare as compare_facts
from plumbline.operators.rules import REGISTRY, Rule, build_rules, duplicates, register_rule
from plumbline.plans.fusion import Plan, fused_counts, unique_counts
from plumbline.plans.sqlguard import result as custom_sql
from plumbline.sources.datasets import load, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIRTY = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS qty,
CASE WHEN l_discount = 0.1 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS disc,
CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus, l_shipdate, l_tax FROM lineitem)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with nulls and NaN."""
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_quantity")).alias("qty"), F.when(F.col("l_discount") == 0.1, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("disc"), F.when(F.col("l_orderkey") % 17 == 0, None).otherwise(F.col("l_returnflag")).alias("flag"), "l_linestatus", "l_shipdate", "l_tax")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _rule_query(name: str, source: str, spec: RuleSpec, violated: str | None = None, aggregate: str | None = None) -> None:
    """One rule as a query of its exact violations."""
    of = DIRTY if source == "dirty" else source

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = dirty(spark, sf_dir) if source == "dirty" else table(spark, sf_dir, source)
        rule = build_rules([spec])[0]
        agg = rule.aggregate(df.schema)
        return df.agg(agg.cast("long").alias("violations")) if agg is not None else fused_counts(df, {"violations": rule.mask(df.schema)}).select("violations")

    what = aggregate or f"COALESCE(SUM(CASE WHEN {violated} THEN 1 ELSE 0 END), 0)"
    query(name, f"SELECT CAST({what} AS BIGINT) AS violations FROM {of} t")(run)


def _spec(name: str, **params) -> RuleSpec:
    return RuleSpec(name, params)


_rule_query("r01_not_null", "dirty", _spec("not_null", column="qty"), "qty IS NULL")
_rule_query("r01_not_null_nan", "dirty", _spec("not_null", column="disc", include_nan=True), "disc IS NULL OR isnan(disc)")
_rule_query("r03_allowed", "dirty", _spec("allowed_values", column="flag", values=["A", "R"]), "flag IS NULL OR flag NOT IN ('A', 'R')")
_rule_query("r03_allowed_null_ok", "dirty", _spec("allowed_values", column="flag", values=["A", "R", None]), "flag NOT IN ('A', 'R')")
_rule_query("r04_disallowed", "dirty", _spec("disallowed_values", column="flag", values=["N"]), "flag = 'N'")
_rule_query("r05_range", "dirty", _spec("range", column="qty", min=5, max=40), "qty IS NULL OR qty < 5 OR qty > 40")
_rule_query("r05_range_min_only_nan", "dirty", _spec("range", column="disc", min=0.02), "disc IS NULL OR isnan(disc) OR disc < 0.02")
_rule_query("r05_range_ts", "dirty", _spec("range", column="l_shipdate", min="1996-01-01"), "l_shipdate IS NULL OR l_shipdate < TIMESTAMP '1996-01-01'")
_rule_query("r06_length", "customer", _spec("length", column="c_mktsegment", min=8, max=9), "c_mktsegment IS NULL OR length(c_mktsegment) < 8 OR length(c_mktsegment) > 9")
_rule_query("r07_regex", "part", _spec("regex", column="p_brand", pattern="#[1-3]"), "p_brand IS NULL OR NOT regexp_matches(p_brand, '#[1-3]')")
_rule_query("r08_contains", "documents", _spec("contains", column="text", substring="%"), "text IS NULL OR NOT contains(text, '%')")
_rule_query("r09_starts", "documents", _spec("starts_with", column="source", prefix="src1"), "source IS NULL OR NOT starts_with(source, 'src1')")
_rule_query("r10_ends", "documents", _spec("ends_with", column="text", suffix="."), "text IS NULL OR NOT ends_with(text, '.')")
_rule_query("r12_compare", "dirty", _spec("compare", left="qty", right="l_linenumber", op=">"), "qty IS NULL OR l_linenumber IS NULL OR NOT (qty > l_linenumber)")
_rule_query("r13_cond_not_null", "dirty", _spec("conditional_not_null", column="qty", when="l_linestatus == 'O'"), "l_linestatus = 'O' AND qty IS NULL")
_rule_query("r14_cond_range", "dirty", _spec("conditional_range", column="qty", when="flag == 'R'", min=10), "flag = 'R' AND (qty IS NULL OR qty < 10)")
_rule_query("r15_min_rows", "orders", _spec("min_rows", threshold=1_000_000), aggregate="GREATEST(0, 1000000 - COUNT(*))")
_rule_query("r16_max_rows", "orders", _spec("max_rows", threshold=1_000), aggregate="GREATEST(0, COUNT(*) - 1000)")
_rule_query("r17_freshness", "orders", _spec("freshness", column="o_orderdate", max_age="30d", as_of="1998-01-01"), aggregate="CASE WHEN MAX(o_orderdate) >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY THEN 0 ELSE 1 END")
_rule_query("p05_when_null", "dirty", _spec("conditional_not_null", column="qty", when="flag == null"), "flag IS NULL AND qty IS NULL")


@query("r02_unique", f"SELECT CAST(COUNT(flag) - COUNT(DISTINCT flag) AS BIGINT) AS n FROM {DIRTY} t")
def r02(spark, sf_dir):
    return duplicates(dirty(spark, sf_dir), "flag")


@query("r02_unique_many", "SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'key' AS rule, COUNT(l_orderkey) - COUNT(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'price', COUNT(l_extendedprice) - COUNT(DISTINCT l_extendedprice) FROM lineitem) t")
def r02_many(spark, sf_dir):
    return unique_counts(table(spark, sf_dir, "lineitem"), {"key": "l_orderkey", "price": "l_extendedprice"})


@query("r11_dtype", "SELECT 'COL:o_orderkey:dtype' AS rule_id, bool_and(typeof(o_orderkey) = 'BIGINT') AS passed, COUNT(*) FILTER (typeof(o_orderkey) <> 'BIGINT') AS failed_count FROM orders UNION ALL SELECT 'COL:o_totalprice:dtype', bool_and(typeof(o_totalprice) = 'VARCHAR'), COUNT(*) FILTER (typeof(o_totalprice) <> 'VARCHAR') FROM orders")
def r11(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    found = Plan(df, build_rules([_spec("dtype", column="o_orderkey", type="int64"), _spec("dtype", column="o_totalprice", type="string")]), True).run()
    return spark.createDataFrame([(r.rule_id, r.passed, r.failed_count) for r in found], "rule_id string, passed boolean, failed_count long")


def _path(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def _results(spark: SparkSession, found) -> DataFrame:
    return found.to_df(spark).select("rule_id", "passed", "failed_count", "exact")


_ROW_RULES = "SELECT 'DATASET:min_rows' AS rule_id, c >= 1000000 AS passed, GREATEST(0, 1000000 - c) AS failed_count, TRUE AS exact FROM (SELECT COUNT(*) AS c FROM orders) t UNION ALL SELECT 'DATASET:max_rows', c <= 1000, GREATEST(0, c - 1000), TRUE FROM (SELECT COUNT(*) AS c FROM orders) t"


@query("r15_r16_rows_by_path", _ROW_RULES)
def rows_by_path(spark, sf_dir):
    """Of a path, where footers may answer."""
    from plumbline.api import validate

    return _results(spark, validate(_path(spark, sf_dir, "orders"), rules=[_spec("min_rows", threshold=1_000_000), _spec("max_rows", threshold=1_000)], spark=spark))


@query("s24_rules_by_path", "SELECT 'COL:o_orderkey:not_null' AS rule_id, COUNT(*) FILTER (o_orderkey IS NULL) = 0 AS passed FROM orders UNION ALL SELECT 'COL:o_orderkey:range', COUNT(*) FILTER (o_orderkey < 1) = 0 FROM orders UNION ALL SELECT 'COL:o_custkey:range', COUNT(*) FILTER (o_custkey > 50) = 0 FROM orders UNION ALL SELECT 'COL:o_orderdate:range', COUNT(*) FILTER (o_orderdate < TIMESTAMP '1900-01-01') = 0 FROM orders")
def rules_by_path(spark, sf_dir):
    from plumbline.api import validate

    rules = [_spec("not_null", column="o_orderkey"), _spec("range", column="o_orderkey", min=1), _spec("range", column="o_custkey", max=50), _spec("range", column="o_orderdate", min="1900-01-01")]
    return validate(_path(spark, sf_dir, "orders"), rules=rules, spark=spark).to_df(spark).select("rule_id", "passed")


@query("r18_custom_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000")
def r18(spark, sf_dir):
    return custom_sql(table(spark, sf_dir, "orders"), "SELECT o_orderkey, o_totalprice FROM data WHERE o_orderstatus = 'F' AND o_totalprice > 50000")


@query("u04_custom_with", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 UNION ALL SELECT 'all', COUNT(*) FROM orders")
def u04(spark, sf_dir):
    return custom_sql(table(spark, sf_dir, "orders"), "WITH big AS (SELECT * FROM {table} WHERE o_totalprice > 50000) SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY 1 UNION ALL SELECT 'all', COUNT(*) FROM {table}")


@query("r18_custom_distinct", "SELECT CAST(COUNT(*) AS BIGINT) AS violations FROM (SELECT DISTINCT o_orderstatus FROM orders) t")
def r18_distinct(spark, sf_dir):
    found = Plan(table(spark, sf_dir, "orders"), build_rules([_spec("custom_sql_check", sql="SELECT DISTINCT o_orderstatus FROM {table}")]), True).run()
    return spark.createDataFrame([(found[0].failed_count,)], "violations long")


CONTRACT = [
    _spec("not_null", column="qty"), _spec("not_null", column="disc", include_nan=True), _spec("allowed_values", column="flag", values=["A", "R"]), _spec("range", column="qty", min=5, max=40),
    _spec("range", column="disc", min=0.02), _spec("length", column="l_linestatus", max=1), _spec("regex", column="flag", pattern="^[AN]$"), _spec("starts_with", column="l_linestatus", prefix="O"),
    _spec("compare", left="qty", right="l_linenumber", op=">"), _spec("conditional_not_null", column="qty", when="l_linestatus == 'O'"), _spec("conditional_range", column="qty", when="flag == 'R'", min=10), _spec("disallowed_values", column="l_linestatus", values=["F"]),
]
_CONTRACT_SQL = {
    "COL:qty:not_null": "qty IS NULL", "COL:disc:not_null:include_nan": "disc IS NULL OR isnan(disc)", "COL:flag:allowed_values": "flag IS NULL OR flag NOT IN ('A', 'R')", "COL:qty:range": "qty IS NULL OR qty < 5 OR qty > 40",
    "COL:disc:range": "disc IS NULL OR isnan(disc) OR disc < 0.02", "COL:l_linestatus:length": "length(l_linestatus) > 1", "COL:flag:regex": "flag IS NULL OR NOT regexp_matches(flag, '^[AN]$')", "COL:l_linestatus:starts_with": "NOT starts_with(l_linestatus, 'O')",
    "DATASET:compare": "qty IS NULL OR NOT (qty > l_linenumber)", "COL:qty:conditional_not_null": "l_linestatus = 'O' AND qty IS NULL", "COL:qty:conditional_range": "flag = 'R' AND (qty IS NULL OR qty < 10)", "COL:l_linestatus:disallowed_values": "l_linestatus = 'F'",
}
_sums = ", ".join(f"COALESCE(SUM(CASE WHEN {v} THEN 1 ELSE 0 END), 0) AS r{i}" for i, v in enumerate(_CONTRACT_SQL.values()))
_long = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, CAST(r{i} AS BIGINT) AS failed_count FROM s" for i, k in enumerate(_CONTRACT_SQL))


def _masks(df: DataFrame) -> dict:
    return {r.rule_id: r.mask(df.schema) for r in build_rules(CONTRACT)}


def _long_form(df: DataFrame, ids: list[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(f"`{i}`").alias(value)) for i in ids])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


@query("a01_contract_exact", f"WITH s AS (SELECT {_sums} FROM {DIRTY} t) {_long}")
def a01(spark, sf_dir):
    df = dirty(spark, sf_dir)
    masks = _masks(df)
    return _long_form(fused_counts(df, masks), list(masks), "failed_count")


@query("a03_contract_failfast", f"WITH s AS (SELECT {_sums} FROM {DIRTY} t), x AS ({_long}) SELECT rule_id, LEAST(failed_count, 1) AS failed_count FROM x")
def a03(spark, sf_dir):
    found = Plan(dirty(spark, sf_dir), build_rules(CONTRACT), False).run()
    return spark.createDataFrame([(r.rule_id, r.failed_count) for r in found], "rule_id string, failed_count long")


@query("p04_only_filter", f"WITH s AS (SELECT {_sums} FROM {DIRTY} t), x AS ({_long}) SELECT rule_id, failed_count, failed_count = 0 AS passed FROM x WHERE rule_id LIKE '%:range'")
def p04(spark, sf_dir):
    from plumbline.api import validate

    found = validate(dirty(spark, sf_dir), {"name": "c", "rules": [{"name": s.name, "params": s.params} for s in CONTRACT]}, tally=True, only=["range"])
    return found.to_df(spark).select("rule_id", "failed_count", "passed")


@query("a20_quality_score", f"WITH s AS (SELECT {_sums}, COUNT(*) AS n FROM {DIRTY} t), x AS ({_long}) SELECT round(1 - SUM(failed_count) / (MAX(n) * 12.0), 9) AS score FROM x, (SELECT n FROM s) c")
def a20(spark, sf_dir):
    from plumbline.api import validate

    found = validate(dirty(spark, sf_dir), rules=CONTRACT, tally=True)
    return spark.createDataFrame([(round(found.quality_score(), 9),)], "score double")


@query("a21_violation_rate", f"WITH s AS (SELECT {_sums}, COUNT(*) AS n FROM {DIRTY} t), x AS ({_long}) SELECT rule_id, round(failed_count / n, 9) AS rate FROM x, (SELECT n FROM s) c")
def a21(spark, sf_dir):
    from plumbline.api import validate

    found = validate(dirty(spark, sf_dir), rules=CONTRACT, tally=True)
    return spark.createDataFrame([(r.rule_id, round(r.violation_rate(found.rows), 9)) for r in found.rules], "rule_id string, rate double")


class _TaxAboveDiscount(Rule):
    """A rule of one's own that counts in an aggregate."""

    uses = ("tax", "discount")

    def aggregate(self, schema):
        return F.count_if(F.col(self.params["tax"]) > F.col(self.params["discount"]))


class _LateLines(Rule):
    """A rule of one's own that looks at the whole DataFrame."""

    uses = ("column",)
    needs_all_columns = True

    def validate(self, df):
        n = df.where(F.col(self.column) > F.lit("1998-06-01").cast("timestamp_ntz")).groupBy("l_suppkey").count().where("count > 1").count()
        return {"passed": n == 0, "failed_count": n, "message": f"{n} suppliers with late lines"}


@query("a22_custom_hooks", "SELECT 'DATASET:tax_above_discount' AS rule_id, COUNT(*) FILTER (l_tax > l_discount) = 0 AS passed, COUNT(*) FILTER (l_tax > l_discount) AS failed_count, TRUE AS exact FROM lineitem UNION ALL SELECT 'COL:l_shipdate:late_lines', COUNT(*) = 0, COUNT(*), TRUE FROM (SELECT l_suppkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01' GROUP BY 1 HAVING COUNT(*) > 1) t")
def a22(spark, sf_dir):
    """Through the registry and the plan, as a user's rules go."""
    from plumbline.api import validate

    added = {"tax_above_discount": _TaxAboveDiscount, "late_lines": _LateLines}
    for name, kind in added.items():
        register_rule(name)(kind)
    try:
        return _results(spark, validate(table(spark, sf_dir, "lineitem"), rules=[_spec("tax_above_discount", tax="l_tax", discount="l_discount"), _spec("late_lines", column="l_shipdate")], tally=True))
    finally:
        for name in added:
            REGISTRY.pop(name)


@query("w03_dup_samples", "SELECT doc_id, CAST(c AS BIGINT) AS _duplicate_count FROM (SELECT doc_id, COUNT(text) OVER (PARTITION BY text) AS c, text FROM documents) t WHERE c > 1 AND text IS NOT NULL")
def w03(spark, sf_dir):
    return samples.duplicate_rows(table(spark, sf_dir, "documents"), "text").select("doc_id", "_duplicate_count")


@query("w01_row_index", "SELECT c_custkey, CAST(ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS row_index FROM customer WHERE c_acctbal < 0")
def w01(spark, sf_dir):
    rule = build_rules([_spec("range", column="c_acctbal", min=0)])[0]
    return samples.indexed(samples.failing_rows(table(spark, sf_dir, "customer"), rule, "c_custkey"), ["c_custkey"])


@query("w02_row_position", "SELECT c_custkey, CAST(file_row_number AS BIGINT) AS row_index FROM (SELECT c_custkey, ROW_NUMBER() OVER () - 1 AS file_row_number FROM customer) t")
def w02(spark, sf_dir):
    return samples.positioned(table(spark, sf_dir, "customer")).select("c_custkey", "row_index")


@query("x01_top_unexpected", f"SELECT flag AS value, COUNT(*) AS n FROM {DIRTY} t WHERE flag NOT IN ('A') GROUP BY flag ORDER BY n DESC, value LIMIT 10")
def x01(spark, sf_dir):
    df = dirty(spark, sf_dir)
    rule = build_rules([_spec("allowed_values", column="flag", values=["A"])])[0]
    return samples.top_values(df, "flag", rule.mask(df.schema))


def _details(df: DataFrame, spec: RuleSpec) -> dict:
    return samples.explain_failure(df, build_rules([spec])[0])


@query("x02_found_disallowed", f"SELECT flag AS value, COUNT(*) AS count FROM {DIRTY} t WHERE flag IN ('N', 'R') GROUP BY flag")
def x02(spark, sf_dir):
    found = _details(dirty(spark, sf_dir), _spec("disallowed_values", column="flag", values=["N", "R"]))["found_values"]
    return spark.createDataFrame([(x["value"], x["count"]) for x in found], "value string, count long")


@query("x03_duplicate_values", "WITH g AS (SELECT o_custkey AS value, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 1) SELECT value, n, (SELECT COUNT(*) FROM g) AS duplicate_value_count FROM (SELECT * FROM g ORDER BY n DESC, value LIMIT 10) t")
def x03(spark, sf_dir):
    found = _details(table(spark, sf_dir, "orders"), _spec("unique", column="o_custkey"))
    return spark.createDataFrame([(x["value"], x["count"], found["duplicate_value_count"]) for x in found["top_duplicates"]], "value long, n long, duplicate_value_count long")


@query("x04_null_details", f"SELECT COUNT(*) FILTER (qty IS NULL) AS null_count, TRUE AS rate_to_four_places, COUNT(*) AS total_rows FROM {DIRTY} t")
def x04(spark, sf_dir):
    found = _details(dirty(spark, sf_dir), _spec("not_null", column="qty"))
    near = abs(found["null_rate"] - found["null_count"] / max(1, found["total_rows"])) <= 0.000051
    return spark.createDataFrame([(found["null_count"], near, found["total_rows"])], "null_count long, rate_to_four_places boolean, total_rows long")


@query("x04_positions", "SELECT CAST(i AS BIGINT) AS position FROM (SELECT ROW_NUMBER() OVER () - 1 AS i, c_acctbal FROM customer) t WHERE c_acctbal < -900 ORDER BY i LIMIT 5")
def x04_positions(spark, sf_dir):
    found = samples.positions(table(spark, sf_dir, "customer"), F.col("c_acctbal") < -900)
    return spark.createDataFrame([(x,) for x in found], "position long")


@query("x06_compare_details", f"SELECT round(COUNT(*) FILTER (qty IS NULL OR NOT (qty > l_linenumber)) / COUNT(*), 4) AS failure_rate, COUNT(*) FILTER (qty IS NULL) AS left_null_count, COUNT(*) FILTER (l_linenumber IS NULL) AS right_null_count FROM {DIRTY} t")
def x06(spark, sf_dir):
    found = _details(dirty(spark, sf_dir), _spec("compare", left="qty", right="l_linenumber", op=">"))
    return spark.createDataFrame([tuple(found.values())], "failure_rate double, left_null_count long, right_null_count long")


@query("x07_conditional_details", f"SELECT COUNT(*) FILTER (flag = 'R') AS rows_matching_condition, COUNT(*) FILTER (flag = 'R' AND qty IS NULL) AS null_count, COUNT(*) FILTER (flag = 'R' AND qty < 10) AS below_min, COUNT(*) FILTER (flag = 'R' AND qty > 40) AS above_max FROM {DIRTY} t")
def x07(spark, sf_dir):
    found = _details(dirty(spark, sf_dir), _spec("conditional_range", column="qty", when="flag == 'R'", min=10, max=40))
    return spark.createDataFrame([tuple(found[k] for k in ("rows_matching_condition", "null_count", "below_min", "above_max"))], "rows_matching_condition long, null_count long, below_min long, above_max long")


@query("x08_mismatches", "SELECT LEAST(5, COUNT(*)) AS n, COUNT(*) > 0 AS any_short FROM customer WHERE length(c_mktsegment) > 8")
def x08(spark, sf_dir):
    found = _details(table(spark, sf_dir, "customer"), _spec("length", column="c_mktsegment", max=8))["sample_mismatches"]
    return spark.createDataFrame([(len(found), any(len(x) > 8 for x in found))], "n long, any_short boolean")


@query("x05_range_details", f"SELECT MIN(qty) AS actual_min, MAX(qty) AS actual_max, COUNT(*) FILTER (qty < 5) AS below_min, COUNT(*) FILTER (qty > 40) AS above_max, COUNT(*) FILTER (qty IS NULL) AS null_count FROM {DIRTY} t")
def x05(spark, sf_dir):
    df = dirty(spark, sf_dir)
    found = samples.explain_failure(df, build_rules([_spec("range", column="qty", min=5, max=40)])[0])
    return spark.createDataFrame([tuple(found.values())], "actual_min double, actual_max double, below_min long, above_max long, null_count long")


@query("m05_failing_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal < 0")
def m05(spark, sf_dir):
    rule = build_rules([_spec("range", column="c_acctbal", min=0)])[0]
    return samples.failing_rows(table(spark, sf_dir, "customer"), rule, ["c_custkey", "c_acctbal"])


@query("u02_samples_by_rule", "SELECT _rule_id, COUNT(*) AS n FROM (SELECT 'COL:qty:not_null' AS _rule_id FROM " + DIRTY + " t WHERE qty IS NULL UNION ALL SELECT 'COL:flag:disallowed_values' FROM " + DIRTY + " t WHERE flag = 'N') x GROUP BY _rule_id")
def u02(spark, sf_dir):
    rules = build_rules([_spec("not_null", column="qty"), _spec("disallowed_values", column="flag", values=["N"])])
    return samples.sample_many(dirty(spark, sf_dir), rules, 1 << 30).groupBy("_rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("a09_nulls_distinct", f"SELECT COUNT(*) AS rows, COUNT(*) - COUNT(qty) AS nulls__qty, COUNT(*) - COUNT(flag) AS nulls__flag FROM {DIRTY} t")
def a09(spark, sf_dir):
    return profiler.profile_aggregates(dirty(spark, sf_dir), ["qty", "flag"], False)


@query("a09_distinct", f"SELECT 'qty' AS \"column\", COUNT(DISTINCT qty) AS \"distinct\" FROM {DIRTY} t UNION ALL SELECT 'flag', COUNT(DISTINCT flag) FROM {DIRTY} t")
def a09_distinct(spark, sf_dir):
    return profiler.distinct_counts(dirty(spark, sf_dir), ["qty", "flag"])


@query("a10_numeric", f"SELECT MIN(x) AS min, MAX(x) AS max, round(AVG(x), 6) AS mean, round(STDDEV_SAMP(x), 6) AS std FROM (SELECT CASE WHEN isfinite(disc) THEN disc END AS x FROM {DIRTY} t) s")
def a10(spark, sf_dir):
    df = dirty(spark, sf_dir)
    a = profiler.column_aggregates("disc", df.schema["disc"].dataType)
    return df.agg(a["min"].alias("min"), a["max"].alias("max"), F.round(a["mean"], 6).alias("mean"), F.round(a["std"], 6).alias("std"))


@query("a11_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def a11(spark, sf_dir):
    found = profiler.percentiles_of(table(spark, sf_dir, "orders"), ["o_totalprice"], (25, 99))["o_totalprice"]
    return spark.createDataFrame([tuple(round(found[k], 4) for k in ("median", "p25", "p99"))], "median double, p25 double, p99 double")


@query("a11_percentiles_of_nulls", f"SELECT quantile_cont(CASE WHEN isfinite(disc) THEN disc END, 0.5) AS disc, quantile_cont(qty, 0.5) AS qty, quantile_cont(qty, 0.75) AS qty75 FROM {DIRTY} t")
def a11_nulls(spark, sf_dir):
    found = profiler.percentiles_of(dirty(spark, sf_dir), ["disc", "qty", "flag"], (75,))
    return spark.createDataFrame([(found["disc"]["median"], found["qty"]["median"], found["qty"]["p75"])], "disc double, qty double, qty75 double")


@query("a12_string", "SELECT CAST(MIN(length(c_name)) AS INTEGER) AS min_len, CAST(MAX(length(c_name)) AS INTEGER) AS max_len, round(AVG(length(c_name)), 6) AS avg_len, COUNT(*) FILTER (c_name = '') AS empty FROM customer")
def a12(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    a = profiler.column_aggregates("c_name", df.schema["c_name"].dataType)
    return df.agg(a["min_len"].alias("min_len"), a["max_len"].alias("max_len"), F.round(a["avg_len"], 6).alias("avg_len"), a["empty"].alias("empty"))


@query("a13_temporal", "SELECT MIN(ts) AS min, MAX(ts) AS max FROM events")
def a13(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    a = profiler.column_aggregates("ts", df.schema["ts"].dataType)
    return df.agg(a["min"].alias("min"), a["max"].alias("max"))


@query("t01_top_values", "SELECT * FROM (SELECT 'event_type' AS \"column\", event_type AS value, COUNT(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, value LIMIT 3) a UNION ALL SELECT * FROM (SELECT 'user_id', CAST(user_id AS VARCHAR), COUNT(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, 2 LIMIT 3) b")
def t01(spark, sf_dir):
    return profiler.top_per_column(table(spark, sf_dir, "events"), ["event_type", "user_id"], 3)


@query("t02_distinct_values", "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, COUNT(*) AS n FROM customer GROUP BY 2")
def t02(spark, sf_dir):
    return profiler.value_counts(table(spark, sf_dir, "customer"), ["c_mktsegment"])


_SHAPES = {
    "url": "(starts_with(v, 'http://') OR starts_with(v, 'https://')) AND length(v) > position('://' IN v) + 2 AND v = regexp_replace(v, '[ \\t\\n\\r]', '', 'g')",
    "iso_date": "length(v) = 10 AND substr(v, 5, 1) = '-' AND substr(v, 8, 1) = '-' AND translate(v, '0123456789', '') = '--'",
    "slug": "v <> '' AND translate(v, 'abcdefghijklmnopqrstuvwxyz0123456789-', '') = '' AND NOT starts_with(v, '-') AND NOT ends_with(v, '-') AND NOT contains(v, '--')",
    "zip_us": "length(v) IN (5, 10) AND translate(v, '0123456789', '') IN ('', '-') AND (length(v) = 5 AND NOT contains(v, '-') OR substr(v, 6, 1) = '-')",
    "ipv4": "translate(v, '0123456789', '') = '...' AND " + " AND ".join(f"length(split_part(v, '.', {i})) BETWEEN 1 AND 3" for i in (1, 2, 3, 4)),
}
_SHAPED = "(SELECT url AS v FROM pages UNION ALL SELECT source FROM documents UNION ALL SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders UNION ALL SELECT CAST(p_partkey + 10000 AS VARCHAR) FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) || '.1.20.' || CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT c_name FROM customer)"


@query("f06_patterns", "SELECT " + ", ".join(f"round(COUNT(*) FILTER ({c}) / COUNT(*), 6) AS {n}" for n, c in _SHAPES.items()) + f" FROM {_SHAPED} t WHERE v IS NOT NULL AND trim(v) <> ''")
def f06(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    part = t("part")
    mixed = [t("pages").select(F.col("url").alias("v")), t("documents").select("source"), t("orders").select(F.col("o_orderdate").cast("date").cast("string")), part.select((F.col("p_partkey") + 10000).cast("string")), part.select(F.concat(F.col("p_size").cast("string"), F.lit(".1.20."), F.col("p_partkey").cast("string"))), t("customer").select("c_name")]
    found = profiler.pattern_shares(reduce(DataFrame.union, mixed), "v", None)
    return found.select(*[F.round(n, 6).alias(n) for n in _SHAPES])


def _meaning(columns: dict[str, str], of: str) -> str:
    """The meaning of columns from their counts, by SQL; ``columns`` tells text, number or time."""
    each = [f"SELECT '{c}' AS \"column\", CASE WHEN COUNT({c}) = COUNT(*) AND COUNT(DISTINCT {c}) >= 0.99 * COUNT({c}) THEN 'identifier' WHEN '{k}' = 'text' THEN CASE WHEN COUNT(DISTINCT {c}) BETWEEN 1 AND 20 THEN 'category' END WHEN '{k}' = 'number' THEN CASE WHEN COUNT(DISTINCT {c}) > 20 THEN 'measure' END ELSE 'timestamp' END AS meaning FROM {of}" for c, k in columns.items()]
    return " UNION ALL ".join(each)


_CUSTOMER = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}
_LINES = {"l_orderkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_returnflag": "text", "l_shipdate": "time"}


@query("f07_semantic", _meaning(_CUSTOMER, "customer") + " UNION ALL " + _meaning(_LINES, "lineitem"))
def f07(spark, sf_dir):
    found = [*profiler.profile(table(spark, sf_dir, "customer")).columns, *profiler.profile(table(spark, sf_dir, "lineitem").select(*_LINES)).columns]
    return spark.createDataFrame([(c.name, c.semantic_type) for c in found], "`column` string, meaning string")


@query("f03_metadata_profile", "SELECT 'o_orderkey' AS \"column\", COUNT(*) AS rows, COUNT(*) - COUNT(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_orderstatus', COUNT(*), COUNT(*) - COUNT(o_orderstatus) FROM orders")
def f03(spark, sf_dir):
    from plumbline.api import profile

    p = profile(_path(spark, sf_dir, "orders"), "scout", columns=["o_orderkey", "o_orderstatus"], spark=spark)
    return spark.createDataFrame([(c.name, c.rows, c.nulls) for c in p.columns], "`column` string, rows long, nulls long")


@query("f04_strategic", "SELECT 'o_orderstatus' AS \"column\", COUNT(DISTINCT o_orderstatus) AS \"distinct\", MODE(o_orderstatus) AS often FROM orders UNION ALL SELECT 'o_orderpriority', COUNT(DISTINCT o_orderpriority), (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) FROM orders")
def f04(spark, sf_dir):
    p = profiler.strategic_profile(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(c, p[c].distinct, p[c].top_values[0]["value"]) for c in ("o_orderstatus", "o_orderpriority")], "`column` string, `distinct` long, often string")


@query("f05_constants", "SELECT 'l_linestatus' AS \"column\", CASE WHEN COUNT(DISTINCT l_linestatus) = 1 THEN MIN(l_linestatus) END AS constant FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'l_returnflag', CASE WHEN COUNT(DISTINCT l_returnflag) = 1 THEN MIN(l_returnflag) END FROM lineitem WHERE l_linestatus = 'O'")
def f05(spark, sf_dir):
    p = profiler.profile(table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_linestatus", "l_returnflag"))
    return spark.createDataFrame([(c.name, c.constant) for c in p.columns], "`column` string, constant string")


@query("f10_draft", "WITH f AS (SELECT COUNT(*) AS n, COUNT(c_mktsegment) AS s, COUNT(DISTINCT c_mktsegment) AS d, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer) SELECT 'not_null' AS name, CAST(1.0 AS DOUBLE) AS confidence, NULL AS said FROM f WHERE s = n UNION ALL SELECT 'allowed_values', CAST(0.9 AS DOUBLE), CAST(d AS VARCHAR) FROM f WHERE d <= 20 UNION ALL SELECT 'min_rows', CAST(0.6 AS DOUBLE), CAST(CAST(floor(n * 0.8) AS BIGINT) AS VARCHAR) FROM f UNION ALL SELECT 'dtype', CAST(1.0 AS DOUBLE), 'string' FROM f")
def f10(spark, sf_dir):
    found = profiler.draft(profiler.profile(table(spark, sf_dir, "customer").select("c_mktsegment"), "interrogate"))
    said = lambda p: str(len(p["values"])) if "values" in p else str(p["threshold"]) if "threshold" in p else p.get("type")
    return spark.createDataFrame([(s.rule.name, s.confidence, said(s.rule.params)) for s in found], "name string, confidence double, said string")


@query("m01_row_sample", "SELECT LEAST(500, COUNT(*)) AS rows, LEAST(500, COUNT(*)) AS keys FROM orders")
def m01(spark, sf_dir):
    some, _ = profiler.drawn(table(spark, sf_dir, "orders"), 500)
    return some.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"))


@query("s05_csv", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def s05(spark, sf_dir):
    """CSV, staged once as Parquet, and lines of JSON, both read back."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table(spark, sf_dir, "region").write.option("header", True).csv(f"{folder}/region.csv")
    table(spark, sf_dir, "nation").write.json(f"{folder}/nation.jsonl")
    regions = load(spark, f"{folder}/region.csv", {"csv_mode": "parquet"})
    nations = load(spark, f"{folder}/nation.jsonl")
    return regions.select("r_regionkey", "r_name").union(nations.select(F.col("n_nationkey").cast("int"), "n_name"))


@query("s17_query_source", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def s17(spark, sf_dir):
    from plumbline.sources.datasets import Query

    view = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    try:
        return load(spark, Query(f"SELECT o_orderstatus, COUNT(*) AS n FROM {view} GROUP BY 1"))
    finally:
        spark.catalog.dropTempView(view)


@query("s18_in_memory", "SELECT r_regionkey, r_name FROM region")
def s18(spark, sf_dir):
    return load(spark, [r.asDict() for r in table(spark, sf_dir, "region").collect()]).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


_AFTER = "(SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders)"
_BEFORE = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    after = before.select(F.when(k % 10 == 0, k + 10_000_000).otherwise(k).alias("o_orderkey"), "o_custkey", F.when(k % 7 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return before, after


_FACTS = f"""WITH b AS {_BEFORE}, a AS {_AFTER}, j AS (SELECT b.o_orderstatus AS s1, a.o_orderstatus AS s2, b.o_totalprice AS p1, a.o_totalprice AS p2 FROM b JOIN a USING (o_orderkey)),
k AS (SELECT (SELECT COUNT(*) FROM b) AS before_rows, (SELECT COUNT(*) FROM a) AS after_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM b)) AS unique_before, (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM a)) AS unique_after,
(SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM b) x JOIN (SELECT DISTINCT o_orderkey FROM a) y USING (o_orderkey)) AS preserved, (SELECT COUNT(*) FROM (SELECT o_orderkey FROM a GROUP BY 1 HAVING COUNT(*) > 1)) AS duplicated_after)
SELECT *, unique_before - preserved AS dropped, unique_after - preserved AS added, (SELECT COUNT(*) FROM j) AS matched_rows, (SELECT COUNT(*) FROM j WHERE s1 IS DISTINCT FROM s2 OR p1 IS DISTINCT FROM p2) AS changed_rows FROM k"""


@query("b01_compare_facts", _FACTS)
def b01(spark, sf_dir):
    return Comparison(*_two(spark, sf_dir), "o_orderkey").facts().select("before_rows", "after_rows", "unique_before", "unique_after", "preserved", "duplicated_after", "dropped", "added", "matched_rows", "changed_rows")


@query("b01_changed_columns", f"WITH b AS {_BEFORE}, a AS {_AFTER} SELECT c AS \"column\", COUNT(*) AS n FROM (SELECT unnest([CASE WHEN b.o_orderstatus IS DISTINCT FROM a.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_totalprice IS DISTINCT FROM a.o_totalprice THEN 'o_totalprice' END]) AS c FROM b JOIN a USING (o_orderkey)) t WHERE c IS NOT NULL GROUP BY c")
def b01_columns(spark, sf_dir):
    return Comparison(*_two(spark, sf_dir), "o_orderkey").changed_rows().select(F.explode("changed_columns").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query("b01_dropped_added_keys", f"WITH b AS {_BEFORE}, a AS {_AFTER} SELECT 'dropped' AS what, o_orderkey FROM (SELECT DISTINCT o_orderkey FROM b) x ANTI JOIN a USING (o_orderkey) UNION ALL SELECT 'added', o_orderkey FROM (SELECT DISTINCT o_orderkey FROM a) y ANTI JOIN b USING (o_orderkey)")
def b01_keys(spark, sf_dir):
    c = Comparison(*_two(spark, sf_dir), "o_orderkey")
    return c.dropped_keys().select(F.lit("dropped").alias("what"), "o_orderkey").unionByName(c.added_keys().select(F.lit("added").alias("what"), "o_orderkey"))


def _relationship_sql(left: str, lk: str, right: str, rk: str) -> str:
    return f"""WITH l AS (SELECT {lk} AS k FROM {left}), r AS (SELECT {rk} AS k FROM {right}), gl AS (SELECT k, COUNT(*) AS n FROM l WHERE k IS NOT NULL GROUP BY k), gr AS (SELECT k, COUNT(*) AS n FROM r WHERE k IS NOT NULL GROUP BY k)
SELECT (SELECT COUNT(*) FROM l) AS left_rows, (SELECT COUNT(*) FROM r) AS right_rows, (SELECT COUNT(*) FROM gl) AS left_unique_keys, (SELECT COUNT(*) FROM gr) AS right_unique_keys, (SELECT COUNT(*) FROM gl WHERE n > 1) AS left_duplicate_keys, (SELECT COUNT(*) FROM gr WHERE n > 1) AS right_duplicate_keys,
(SELECT MIN(n) FROM gl) AS left_multiplicity_min, (SELECT MAX(n) FROM gl) AS left_multiplicity_max, (SELECT MIN(n) FROM gr) AS right_multiplicity_min, (SELECT MAX(n) FROM gr) AS right_multiplicity_max,
(SELECT COUNT(*) FROM gl SEMI JOIN gr USING (k)) AS left_keys_with_match, (SELECT COUNT(*) FROM gl ANTI JOIN gr USING (k)) AS left_keys_without_match, (SELECT COUNT(*) FROM gr ANTI JOIN gl USING (k)) AS right_keys_without_match"""


_MEASURES = ["left_rows", "right_rows", "left_unique_keys", "right_unique_keys", "left_duplicate_keys", "right_duplicate_keys", "left_multiplicity_min", "left_multiplicity_max", "right_multiplicity_min", "right_multiplicity_max", "left_keys_with_match", "left_keys_without_match", "right_keys_without_match"]


@query("b04_relationship", _relationship_sql("documents", "doc_id", "labels", "doc_id"))
def b04(spark, sf_dir):
    return Relationship(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").measures().select(*_MEASURES)


@query("j04_asymmetric", _relationship_sql("lineitem", "l_orderkey", "orders", "o_orderkey"))
def j04(spark, sf_dir):
    return Relationship(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), left_on="l_orderkey", right_on="o_orderkey").measures().select(*_MEASURES)


@query("b04_unmatched", "SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def b04_unmatched(spark, sf_dir):
    return Relationship(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").unmatched("left")


@query("a16_multiplicity", "SELECT l_orderkey AS _k0, COUNT(*) AS n FROM lineitem GROUP BY 1")
def a16(spark, sf_dir):
    r = Relationship(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), left_on="l_orderkey", right_on="o_orderkey")
    return r.grouped(r.l)


@query("h03_run_diff", "WITH o AS (SELECT o_orderstatus AS s, COUNT(*) FILTER (o_totalprice > 100000) AS x, COUNT(*) FILTER (o_totalprice > 400000) AS y FROM orders GROUP BY 1) SELECT s AS rule_id, CASE WHEN x = 0 AND y > 0 THEN 'new_failure' WHEN x > 0 AND y = 0 THEN 'resolved' WHEN x > 0 AND y > x THEN 'regression' WHEN x > 0 AND y < x THEN 'improvement' ELSE 'unchanged' END AS change, x AS old_failed, y AS new_failed FROM o")
def h03(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    run = lambda limit: orders.groupBy(F.col("o_orderstatus").alias("rule_id")).agg(F.count_if(F.col("o_totalprice") > limit).alias("failed_count")).select("rule_id", (F.col("failed_count") == 0).alias("passed"), "failed_count", F.lit(True).alias("exact"))
    return history.run_diff(run(100_000), run(400_000))


@query("h01_history", "SELECT l_linestatus AS status, COUNT(*) FILTER (l_quantity > 40) AS failed_count, COUNT(*) FILTER (l_quantity > 40) = 0 AS passed FROM lineitem GROUP BY 1")
def h01(spark, sf_dir):
    """Runs that are saved, found again by order and by time, annotated, and cut to the newest."""
    from plumbline.api import validate
    from plumbline.operators.history import HistoryStore

    store, rules = HistoryStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"), [_spec("range", column="l_quantity", max=40)]
    df, out = table(spark, sf_dir, "lineitem"), []
    states = sorted(r[0] for r in df.select("l_linestatus").distinct().collect())
    for state in (states[0], *states):  # the first run is the one that retention takes away
        found = validate(df.where(F.col("l_linestatus") == state), rules=rules, tally=True, store=store)
        store.annotate(found.fingerprint, store.run(found.fingerprint)["run_id"], state, kind="status")
    if store.delete_old(found.fingerprint, len(states)) != 1:
        raise ValueError("retention keeps the newest runs")
    run = store.run(found.fingerprint)
    while run:
        note = store.annotations(found.fingerprint, run["run_id"]).first()["note"]
        same = store.run(found.fingerprint, at=run["run_at"])
        out.append((note, same["rules"][0]["failed_count"], run["rules"][0]["passed"]))
        run = store.run(found.fingerprint, before=run["run_id"])
    return spark.createDataFrame(out, "status string, failed_count long, passed boolean")


@query("f12_profile_diff", """WITH b AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (l_orderkey % 17 = 0) AS f, COUNT(*) FILTER (l_quantity > 45) AS q, COUNT(DISTINCT l_orderkey) AS k FROM lineitem), a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (l_orderkey % 17 = 0) AS f, COUNT(*) FILTER (l_quantity > 45) AS q, COUNT(DISTINCT l_orderkey) AS k FROM lineitem WHERE l_linenumber = 1),
r AS (SELECT 'flag' AS "column", 'null_rate' AS what, round(b.f / b.n, 9) AS before, round(a.f / a.n, 9) AS after FROM a, b UNION ALL SELECT 'qty', 'null_rate', round(b.q / b.n, 9), round(a.q / a.n, 9) FROM a, b)
SELECT * FROM r WHERE abs(after - before) > 0.001 UNION ALL SELECT 'l_orderkey', 'distinct', b.k, a.k FROM a, b WHERE abs(a.k - b.k) > 0.1 * b.k""")
def f12(spark, sf_dir):
    df = dirty(spark, sf_dir).select("l_orderkey", "l_linenumber", "qty", "flag")
    two = [profiler.profile(x.select("l_orderkey", "qty", "flag")) for x in (df, df.where("l_linenumber = 1"))]
    told = profiler.compare_profiles(*two)["changes"]
    rows = [(c["column"], what, round(float(c[what][0]), 9), round(float(c[what][1]), 9)) for c in told for what in ("null_rate", "distinct") if what in c and (c["column"], what) != ("qty", "distinct")]
    return spark.createDataFrame(rows, "`column` string, what string, before double, after double")


@query("a18_null_deltas", f"WITH b AS {_BEFORE}, a AS {_AFTER} SELECT 'o_orderstatus' AS \"column\", (SELECT round(COUNT(*) FILTER (o_orderstatus IS NULL) / COUNT(*), 9) FROM b) AS before, (SELECT round(COUNT(*) FILTER (o_orderstatus IS NULL) / COUNT(*), 9) FROM a) AS after UNION ALL SELECT 'o_totalprice', (SELECT round(COUNT(*) FILTER (o_totalprice IS NULL) / COUNT(*), 9) FROM b), (SELECT round(COUNT(*) FILTER (o_totalprice IS NULL) / COUNT(*), 9) FROM a)")
def a18(spark, sf_dir):
    found = compare_facts(*_two(spark, sf_dir), "o_orderkey", sample_limit=0)["nullability_delta"]
    return spark.createDataFrame([(c, round(x["before"], 9), round(x["after"], 9)) for c, x in found.items()], "`column` string, before double, after double")


@query("b03_changed_samples", f"WITH b AS {_BEFORE}, a AS {_AFTER} SELECT b.o_orderkey, CAST(b.o_totalprice AS VARCHAR) = CAST(a.o_totalprice AS VARCHAR) AS same_price FROM b JOIN a USING (o_orderkey) WHERE b.o_orderstatus IS DISTINCT FROM a.o_orderstatus OR b.o_totalprice IS DISTINCT FROM a.o_totalprice ORDER BY b.o_orderkey LIMIT 5")
def b03(spark, sf_dir):
    found = compare_facts(*_two(spark, sf_dir), "o_orderkey", sample_limit=5)["samples"]["changed_rows"]
    return spark.createDataFrame([(r["o_orderkey"], r["before_o_totalprice"] == r["after_o_totalprice"]) for r in found], "o_orderkey long, same_price boolean")


@query("a19_stats_profile", "SELECT 'c_acctbal' AS \"column\", COUNT(*) - COUNT(c_acctbal) AS nulls, COUNT(DISTINCT c_acctbal) AS \"distinct\", MIN(c_acctbal) AS min, MAX(c_acctbal) AS max, round(AVG(c_acctbal), 6) AS mean FROM customer")
def a19(spark, sf_dir):
    from plumbline.api import validate

    found = validate(table(spark, sf_dir, "customer"), rules=[_spec("range", column="c_acctbal", min=0)], stats="profile").stats
    return spark.createDataFrame([(c, x["nulls"], x["distinct"], x["min"], x["max"], round(x["mean"], 6)) for c, x in found.items()], "`column` string, nulls long, `distinct` long, min double, max double, mean double")


@query("k10_samples_frame", "SELECT LEAST(5, COUNT(*) FILTER (c_acctbal < 0)) AS n, COUNT(*) FILTER (c_acctbal < 0) > 0 AS negative FROM customer")
def k10(spark, sf_dir):
    from plumbline.api import validate

    found = validate(table(spark, sf_dir, "customer"), rules=[_spec("range", column="c_acctbal", min=0)], tally=True, sample=5)
    return found.samples_df(spark, "COL:c_acctbal:range").agg(F.count(F.lit(1)).alias("n"), (F.max("c_acctbal") < 0).alias("negative"))


@query("entry_results")
def entry_results(spark, sf_dir):
    """The flagship: a contract's results as rows."""
    from plumbline.api import validate

    return validate(table(spark, sf_dir, "lineitem"), rules=[_spec("not_null", column="l_quantity"), _spec("range", column="l_quantity", min=5, max=40), _spec("allowed_values", column="l_returnflag", values=["A", "R"])], tally=True).to_df(spark)


SQL["entry_results"] = """SELECT * FROM (SELECT 'COL:l_quantity:not_null' AS rule_id, 'not_null' AS name, 'l_quantity' AS "column", 'blocking' AS severity, c = 0 AS passed, c AS failed_count, TRUE AS exact, CASE WHEN c > 0 THEN 'null_values' END AS failure_mode, 'scan' AS source, CASE WHEN c > 0 THEN 'l_quantity had ' || c || ' NULL values' ELSE 'passed' END AS message FROM (SELECT COUNT(*) FILTER (l_quantity IS NULL) AS c FROM lineitem) t
UNION ALL SELECT 'COL:l_quantity:range', 'range', 'l_quantity', 'blocking', c = 0, c, TRUE, CASE WHEN c > 0 THEN 'range_violation' END, 'scan', CASE WHEN c > 0 THEN 'l_quantity had ' || c || ' values outside [5, 40]' ELSE 'passed' END FROM (SELECT COUNT(*) FILTER (l_quantity < 5 OR l_quantity > 40) AS c FROM lineitem) t
UNION ALL SELECT 'COL:l_returnflag:allowed_values', 'allowed_values', 'l_returnflag', 'blocking', c = 0, c, TRUE, CASE WHEN c > 0 THEN 'novel_category' END, 'scan', CASE WHEN c > 0 THEN 'l_returnflag had ' || c || ' values that aren''t allowed' ELSE 'passed' END FROM (SELECT COUNT(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS c FROM lineitem) t) x"""
