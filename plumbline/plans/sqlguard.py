"""Custom SQL is parsed by Spark itself; only a single query over the bound view may run."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import ContractError

_NODES = re.compile(r"(?:UnresolvedRelation \[([^\]]*)\]|'UnresolvedTableValuedFunction \[([^\]]*)\])")
_UNSAFE_CALLS = re.compile(r"\b(reflect|java_method|read_files|input_file_name|try_reflect)\s*\(", re.I)
_LONE_COUNT = re.compile(r"\s*select\s+count\s*\(\s*(\*|1)\s*\)(\s+(as\s+)?\w+)?\s+from\s", re.I)
_REGROUPS = re.compile(r"\b(group\s+by|having|limit|offset|union|intersect|except|distinct|with)\b", re.I)


def checked(spark: SparkSession, sql: str, view: str) -> str:
    """The statement if it is one query whose relations are ``view`` or its own CTEs; else a ``ContractError``."""
    text = sql.strip().rstrip(";").strip()
    if _UNSAFE_CALLS.search(text):
        raise ContractError("the query calls a function that reaches outside the data")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ContractError(f"the query can't be parsed as one statement: {str(e).splitlines()[0][:200]}") from None
    kind = plan.getClass().getSimpleName()
    if kind.startswith(("Insert", "Create", "Drop", "Alter", "Update", "Delete", "Merge", "Set", "Show", "Describe", "Use", "Cache", "Refresh", "Add", "Truncate", "Analyze", "Explain", "Unresolved") ) and kind not in ("UnresolvedWith", "UnresolvedHaving", "UnresolvedOrdinal"):
        raise ContractError(f"only queries may run, not {kind}")
    said = plan.toString()
    allowed = {view.lower(), "data"} | {n.lower() for n in re.findall(r"(?:\bwith\s+|,\s*)`?(\w+)`?(?:\s*\([^)]*\))?\s+as\s*\(", text, re.I)}
    for relation, function in _NODES.findall(said):
        if function and function.lower() not in ("range", "explode", "values"):
            raise ContractError(f"table function {function} isn't allowed")
        if relation and relation.split(",")[0].strip().lower() not in allowed or "," in relation and "." in relation.split(",")[0]:
            raise ContractError(f"relation {relation} isn't the data")
        if relation and re.match(r"\w+, [^,\s]*[/.]", relation):
            raise ContractError("paths can't be read as relations")
    return text


def violations(df: DataFrame, sql: str) -> int:
    """Rows that the query gives over ``df`` (named by ``{table}`` or ``data``); of a lone COUNT(*), its value."""
    text = checked(df.sparkSession, sql.replace("{table}", "data"), "data")
    out = result(df, text)
    if _LONE_COUNT.match(text) and not _REGROUPS.search(text):
        return int(out.first()[0])
    return out.count()


def result(df: DataFrame, sql: str) -> DataFrame:
    """What the query gives. ``df`` is a view with a name of its own while the query is analysed; ``data`` is a common
    table expression over it, so a view ``data`` of the session stays as it is, and validations may run side by side."""
    spark, view = df.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    text = checked(spark, sql.replace("{table}", "data"), "data")
    own = f"data AS (SELECT * FROM {view})"
    more = re.match(r"with\b", text, re.I)
    text = f"WITH {own}, {text[more.end() :].lstrip()}" if more else f"WITH {own} {text}"
    df.createOrReplaceTempView(view)
    try:
        return spark.sql(text)
    finally:
        spark.catalog.dropTempView(view)
