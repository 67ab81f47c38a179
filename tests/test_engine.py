"""Semantics of rules, contracts, sources, samples, profiles, probes, history and hooks."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.functions.conditions import parse
from plumbline.functions.literals import duration
from plumbline.model import ContractError, DuplicateRuleError, ValidationFailed
from plumbline.operators import samples
from plumbline.operators.rules import REGISTRY, build_rules
from plumbline.plans.footer import prove, read_footer
from plumbline.plans.sqlguard import checked
from plumbline.sources.config import named_source, set_config
from plumbline.sources.contracts import load_contract
from plumbline.sources.datasets import SourceSpec, jdbc_options, store_settings

NAN = float("nan")


def count(df, name, **params):
    r = pl.validate(df, rules=[pl.rule(name, **params)], tally=True).rules[0]
    first = pl.validate(df, rules=[pl.rule(name, **params)], tally=False).rules[0]
    assert first.passed == r.passed and (not r.passed) == bool(first.failed_count)
    return r.failed_count


@pytest.fixture(scope="module")
def users(spark):
    emails = [None] * 5 + ["valid@test.com"] * 15 + ["not-an-email", "also-bad"] + ["user@domain.com"] * 81
    ages = [25] * 5 + [200, 175, 160, 155] + [30] * 94
    status = ["active"] * 10 + ["invalid"] * 6 + ["active", "inactive", "pending"] * 29
    balance = [100.5] * 50 + [-50.25, -100.0, -0.01] + [200.0] * 50
    rows = [(i if i < 100 else i - 100, emails[i], ages[i], status[i], balance[i], datetime(2024, 1, 15, 12)) for i in range(103)]
    return spark.createDataFrame(rows, "user_id long, email string, age long, status string, balance double, updated_at timestamp_ntz")


@pytest.mark.parametrize(
    ("name", "params", "wanted"),
    [
        ("unique", {"column": "user_id"}, 3), ("not_null", {"column": "email"}, 5), ("regex", {"column": "email", "pattern": ".*@.*"}, 7), ("range", {"column": "age", "min": 0, "max": 150}, 4),
        ("range", {"column": "age", "min": "0", "max": "150"}, 4), ("allowed_values", {"column": "status", "values": ["active", "inactive", "pending"]}, 6), ("range", {"column": "balance", "min": 0}, 3),
        ("min_rows", {"threshold": 200}, 97), ("max_rows", {"threshold": 50}, 53), ("freshness", {"column": "updated_at", "max_age": "1d", "as_of": "2024-01-16T11:00:00"}, 0), ("freshness", {"column": "updated_at", "max_age": "1h30m", "as_of": "2024-01-16T11:00:00"}, 1),
        ("dtype", {"column": "age", "type": "int64"}, 0), ("dtype", {"column": "age", "type": "int32"}, 103), ("dtype", {"column": "age", "type": "uint64"}, 103), ("dtype", {"column": "updated_at", "type": "datetime"}, 0),
    ],
)
def test_known_violations(users, name, params, wanted):
    assert count(users, name, **params) == wanted


def test_edge_values(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (NAN,), (NAN,), (float("inf"),), (None,)], "x double")
    assert count(df, "not_null", column="x") == 1 and count(df, "not_null", column="x", include_nan=True) == 3
    assert count(df, "range", column="x", min=0) == 3 and count(df, "range", column="x", max=5) == 4
    assert count(df, "unique", column="x") == 2
    text = spark.createDataFrame([("aΩ😀",), ("",), (None,), ("pre_1",), ("preX1",), ("50%",)], "s string")
    assert count(text, "length", column="s", min=3, max=3) == 4
    assert count(text, "starts_with", column="s", prefix="pre_") == 5 and count(text, "contains", column="s", substring="%") == 5 and count(text, "ends_with", column="s", suffix="1") == 4
    assert count(spark.createDataFrame([], "x int"), "not_null", column="x") == 0
    assert count(spark.createDataFrame([], "x timestamp"), "freshness", column="x", max_age="1d") == 1


def test_null_policies(spark):
    s = spark.createDataFrame([(x,) for x in ("active", "inactive", None, "active", None, "bad", None, "worse")], "s string")
    assert count(s, "allowed_values", column="s", values=["active", "inactive"]) == 5 and count(s, "allowed_values", column="s", values=["active", "inactive", None]) == 2
    assert count(s, "disallowed_values", column="s", values=["bad", 7]) == 1 and count(s, "disallowed_values", column="s", values=[]) == 0
    d = spark.createDataFrame([("2023-03-01",), ("2023-06-15",), ("2024-02-01",), (None,)], "t string").select(F.col("t").cast("date"))
    assert count(d, "range", column="t", min="2023-01-01", max="2023-12-31") == 2


def test_cross_column_rules(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-15", "shipped", "2024-01-10", "premium", 15), ("2024-02-01", "2024-01-15", "pending", None, "basic", 5), ("2024-03-15", "2024-03-20", "shipped", None, "premium", 5), ("2024-04-01", "2024-03-01", "shipped", "2024-04-05", "basic", 10), ("2024-05-01", "2024-05-10", "pending", None, "premium", 25)],
        "start_date string, end_date string, status string, shipping_date string, tier string, discount int",
    )
    assert count(df, "compare", left="end_date", right="start_date", op=">=") == 2
    assert count(df, "conditional_not_null", column="shipping_date", when="status == 'shipped'") == 1
    assert count(df, "conditional_range", column="discount", when="tier == 'premium'", min=10, max=50) == 1
    odd = pl.validate(df, rules=[pl.rule("compare", left="discount", right="tier", op=">"), pl.rule("not_null", column="gone"), pl.rule("range", column="tier", min=1)], tally=True)
    assert [r.failure_mode for r in odd.rules] == ["config_error"] * 3 and {r.failed_count for r in odd.rules} == {5}
    assert odd.rules[1].details["missing_columns"] == ["gone"]


@pytest.mark.parametrize("text", ["a = 1", "a == 1 AND b == 2", "a == 'x' OR b == 'y'", "", "a ==", "a == b"])
def test_conditions_refuse(text):
    with pytest.raises(ContractError):
        parse(text)


def test_conditions_and_durations():
    assert (parse("a >= -1.5").value, parse("b == 'x y'").value, parse("c != null").value, parse("d == TRUE").value) == (-1.5, "x y", None, True)
    assert [duration(x).total_seconds() for x in ("1h30m", "7 days", "2w", "45s")] == [5400, 604800, 1209600, 45]
    with pytest.raises(ContractError):
        duration("soon")


@pytest.mark.parametrize(("name", "params"), [("range", {"column": "a"}), ("range", {"column": "a", "min": 2, "max": 1}), ("range", {"column": "a", "min": True}), ("length", {"column": "a", "min": -1}), ("regex", {"column": "a", "pattern": "(?=x)"}), ("regex", {"column": "a", "pattern": r"(a)\1"}), ("regex", {"column": "a", "pattern": "("}), ("allowed_values", {"column": "a", "values": []}), ("dtype", {"column": "a", "type": "decimal"}), ("compare", {"left": "a", "right": "b", "op": "~"}), ("contains", {"column": "a", "substring": ""}), ("nothing", {})])
def test_bad_parameters(name, params):
    with pytest.raises(ContractError):
        build_rules([pl.rule(name, **params)])


def test_ids_selection_severity_and_score(users):
    rules = [pl.rule("not_null", column="email", severity="warning"), pl.rule("unique", column="user_id", severity="info"), pl.rule("min_rows", threshold=1)]
    r = pl.validate(users, rules=rules, tally=True)
    assert r.passed and [x.rule_id for x in r.rules] == ["COL:email:not_null", "COL:user_id:unique", "DATASET:min_rows"]
    assert r.counts() == {"total": 3, "passed": 1, "failed": 2, "blocking": 0, "warning": 1, "info": 1}
    assert abs(r.quality_score() - (1 - (5 * 0.5 + 3 * 0.1) / (103 * 1.6))) < 1e-12
    assert len(pl.validate(users, rules=rules, only=[]).rules) == 0
    assert [x.name for x in pl.validate(users, rules=rules, columns=["email"]).rules] == ["not_null", "min_rows"]
    with pytest.raises(DuplicateRuleError):
        build_rules([pl.rule("compare", left="a", right="b", op="=="), pl.rule("compare", left="a", right="c", op="==")])
    assert pl.validate(users, rules=rules, dry_run=True)["columns"] == ["email", "user_id"]
    assert json.loads(r.to_json())["passed"] and r.to_df(users.sparkSession).count() == 3


def test_contract_inheritance(tmp_path):
    put = lambda n, s: (tmp_path / n).write_text(s)
    put("root.yml", "name: root\nrules: [{name: min_rows, params: {threshold: 1}}]")
    put("left.yml", "extends: root.yml\nrules: [{name: not_null, params: {column: a}}]")
    put("right.yml", "extends: [root.yml]\nrules: [{name: not_null, params: {column: b}}]")
    put("top.yml", "name: top\ndatasource: x.parquet\nextends: [left.yml, right.yml]\nrules: [{name: unique, params: {column: a}, severity: warning, tally: true}]")
    c = load_contract(str(tmp_path / "top.yml"))
    assert [(r.name, r.params.get("column")) for r in c.rules] == [("min_rows", None), ("not_null", "a"), ("not_null", "b"), ("unique", "a")] and c.datasource == "x.parquet"
    put("loop.yml", "extends: loop.yml\nrules: []")
    with pytest.raises(ContractError):
        load_contract(str(tmp_path / "loop.yml"))
    assert c.fingerprint() == load_contract(str(tmp_path / "top.yml")).fingerprint()


def test_footer_proofs_agree_with_scans(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"i": list(range(-5, 5)), "f": [1.0, NAN, 3.0] + [2.0] * 7, "n": [None, 1] * 5, "s": ["x" * 100] * 10}), path, row_group_size=4)
    df, footer = spark.read.parquet(path), read_footer(path)
    cases = [pl.rule("range", column="i", min=-3, max=9), pl.rule("range", column="i", min=-5, max=4, id="whole"), pl.rule("range", column="f", max=9), pl.rule("not_null", column="n"), pl.rule("not_null", column="i"), pl.rule("min_rows", threshold=11), pl.rule("max_rows", threshold=10), pl.rule("allowed_values", column="i", values=[1]), pl.rule("range", column="f", max=2), pl.rule("allowed_values", column="s", values=["x" * 100])]
    proofs = []
    for spec in cases:
        proof = prove(build_rules([spec])[0], footer, df.schema)
        proofs.append(proof)
        assert proof is None or proof == pl.validate(df, rules=[spec], tally=True).passed
    assert proofs == [False, True, None, False, True, False, True, False, False, None]
    r = pl.validate(path, rules=cases[:2], spark=spark)
    assert [x.source for x in r.rules] == ["metadata"] * 2 and pl.validate(path, rules=cases[:2], tally=True, spark=spark).rules[0].failed_count == 2
    assert [e["tier"] for e in pl.explain(path, rules=[*cases[:1], pl.rule("unique", column="i")], spark=spark)] == ["metadata", "uniqueness job"]


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT * FROM other", "SELECT * FROM parquet.`/etc`", "SELECT 1; SELECT 2", "INSERT INTO data VALUES (1)", "SELECT reflect('java.lang.System', 'exit', 1) FROM data", "not sql at all"])
def test_custom_sql_refuses(spark, sql):
    with pytest.raises(ContractError):
        checked(spark, sql, "data")


def test_custom_sql_counts(users):
    sql = lambda q, **p: count(users, "custom_sql_check", sql=q, **p)
    assert sql("SELECT * FROM {table} WHERE age > 150") == 4 and sql("SELECT COUNT(*) FROM data WHERE age > 150") == 4
    assert sql("SELECT status FROM {table} GROUP BY status HAVING COUNT(*) > 1") == 4 and sql("WITH x AS (SELECT age FROM {table} WHERE age > 150) SELECT * FROM x WHERE age > 170") == 2
    assert pl.validate(users, rules=[pl.rule("custom_sql_check", sql="SELECT * FROM {table} WHERE age > 150", threshold=4)]).passed


def test_samples(spark, users):
    df = spark.createDataFrame([(100, "a")] * 2 + [(200, "b")] * 4 + [(300, "c")] * 2 + [(1, None)], "user_id long, s string")
    got = pl.validate(df, rules=[pl.rule("unique", column="user_id"), pl.rule("not_null", column="s")], tally=True, sample=5, details=True)
    assert got.rules[0].samples[0] == {"user_id": 200, "s": "b", "_duplicate_count": 4} and got.rules[1].samples == [{"user_id": 1, "s": None}]
    assert got.rules[0].details["duplicate_value_count"] == 3
    assert {r["_rule_id"] for r in samples.sample_many(df, build_rules([pl.rule("not_null", column="s"), pl.rule("range", column="user_id", min=50)]), 3).collect()} == {"COL:s:not_null", "COL:user_id:range"}


def test_many_samples_are_cut_without_gathering_a_rule(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("id", "if(id % 2 = 0, null, id) AS x", "id AS n")
    rules = build_rules([pl.rule("not_null", column="x"), pl.rule("range", column="id", min=20_000)])
    wanted = {"COL:x:not_null": range(0, 200_000, 2), "COL:id:range": range(20_000)}
    for n in (1001, 19_999, 20_000, 70_000, 1 << 30):
        got = {}
        for r in samples.sample_many(df, rules, n).select("id", "_rule_id", F.spark_partition_id()).collect():
            got.setdefault(r[1], []).append((r[0], r[2]))
        assert {k: sorted(x for x, _ in v) for k, v in got.items()} == {k: list(v[:n]) for k, v in wanted.items()}
        # the first 70,000 rows of x stand in three of the four parts of the table
        assert len({part for _, part in got["COL:x:not_null"]}) == {70_000: 3, 1 << 30: 4}.get(n, 1)
    mixed = samples.sample_many(df.repartition(3), rules, 30_000).groupBy("_rule_id").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("rows"))
    assert {tuple(r) for r in mixed.collect()} == {("COL:x:not_null", 30_000, 30_000), ("COL:id:range", 20_000, 20_000)}


def test_custom_rules(spark, users):
    @pl.register_rule("even")
    class Even(pl.Rule):
        def mask(self, schema):
            return F.col(self.column) % 2 != 0

    @pl.register_rule("whole")
    class Whole(pl.Rule):
        uses = ()

        def validate(self, df):
            return {"passed": df.count() > 1000, "failed_count": 7, "message": "too few"}

    @pl.register_rule("broken")
    class Broken(pl.Rule):
        uses = ()

        def setup(self):
            raise RuntimeError("no")

    try:
        r = pl.validate(users, rules=[pl.rule("even", column="user_id"), pl.rule("whole"), pl.rule("broken")], tally=True)
        assert [x.failed_count for x in r.rules] == [51, 7, 103]
    finally:
        for n in ("even", "whole", "broken"):
            REGISTRY.pop(n)
    with pytest.raises(ContractError):
        pl.register_rule("unique")


def test_decorator(spark, users):
    rules = [pl.rule("range", column="age", max=150)]
    with pytest.raises(ValidationFailed):
        pl.validate_decorator(rules=rules)(lambda: users)()
    assert pl.validate_decorator(rules=rules, on_fail="return_result")(lambda: users)().passed is False
    assert pl.validate_decorator(rules=rules, on_fail=lambda r, d: "called")(lambda: users)() == "called"
    with pytest.raises(ValueError):
        pl.validate_decorator(on_fail="sometimes")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x"\n2,\n')
    (tmp_path / "a.tsv").write_text("id\tname\n1\tx\n")
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3}]')
    assert pl.load(spark, str(tmp_path / "a.csv")).where("name is null").count() == 1
    assert pl.load(spark, str(tmp_path / "a.tsv")).columns == ["id", "name"]
    assert pl.load(spark, str(tmp_path / "a.jsonl")).count() == 2 and pl.load(spark, str(tmp_path / "a.json")).count() == 3
    for data, n in (([{"a": 1}, {"b": 2.5, "a": None}], 2), ({"a": [1, 2, 3]}, 3), ({"a": 1}, 1), ([], 0), ([{"a": None}], 1)):
        assert pl.load(spark, data).count() == n
    import pandas as pd

    assert pl.load(spark, pd.DataFrame({"a": [1, 2]})).count() == 2
    assert pl.load(spark, pl.Query("SELECT 1 AS a -- ;\n")).count() == 1
    with pytest.raises(ContractError):
        pl.Query("SELECT 1; DROP TABLE x")
    spec = SourceSpec.from_uri("postgres://me:p%40s@host/db/public.users")
    assert jdbc_options(spec) == {"url": "jdbc:postgresql://host:5432/db", "driver": "org.postgresql.Driver", "user": "me", "password": "p@s"} and spec.table == "public.users"
    assert store_settings("s3", {"aws_access_key_id": "k", "endpoint_url": "http://m"})["fs.s3a.path.style.access"] == "true"
    assert "fs.azure.account.key.acc.dfs.core.windows.net" in store_settings("abfss", {"account_name": "acc", "account_key": "x"})
    os.environ["PL_ROOT"] = "/data"
    set_config(settings={"datasources": {"a": {"base": "${PL_ROOT}", "tables": {"t": "t.parquet"}}, "b": {"tables": {"u": "s3://x/u.parquet"}}, "c": {"tables": {"u": "/u"}}}})
    try:
        assert named_source("a.t")[0] == "/data/t.parquet" and named_source("t")[0] == "/data/t.parquet" and named_source("zzz") is None
        with pytest.raises(ContractError):
            named_source("u")
    finally:
        set_config()


def test_profile_draft_and_diff(spark, users):
    p = pl.profile(users, "interrogate")
    assert (p["email"].nulls, p["email"].distinct, p["age"].stats["max"]) == (5, 4, 200) and p["updated_at"].constant is not None
    assert p["status"].semantic_type == "category" and p["age"].stats["p25"] == 30 and p.to_markdown() and p.to_llm()
    names = {(s.rule.name, s.rule.params.get("column")) for s in pl.draft(p)}
    assert ("not_null", "age") in names and ("not_null", "email") not in names and ("dtype", "age") in names
    again = pl.validate(users, rules=[s.rule for s in pl.draft(p) if s.rule.name != "freshness"], tally=True)
    assert all(r.passed for r in again.rules)
    d = pl.compare_profiles(p, pl.profile(users.where("email is not null").drop("balance"), "interrogate"))
    assert d["columns_removed"] == ["balance"] and d["row_delta"] == -5 and any(c["column"] == "email" and c["significant"] for c in d["changes"])
    assert pl.profile(users, "scout").rows == 103 and pl.profile(users, sample=20).sampled


def test_compare_probe(spark):
    make = lambda rows, s="id long, v long": spark.createDataFrame(rows, s)
    c = pl.compare(make([(1, 100), (2, 200), (3, 300)]), make([(1, 100), (2, 250), (3, 300)]), "id")
    assert (c["changed_rows"], c["unchanged_rows"], c["modified_fraction"]["v"]) == (1, 2, 1 / 3) and c["samples"]["changed_rows"][0]["id"] == 2
    c = pl.compare(make([(i, 1) for i in (1, 2, 3)]), make([(i, 1) for i in (1, 2, 2, 2, 3)]), "id")
    assert (c["row_delta"], c["row_ratio"], c["unique_after"], c["duplicated_after"]) == (2, 5 / 3, 3, 1)
    c = pl.compare(make([(1, 100), (2, None)]), make([(1, None), (2, 200)]), "id")
    assert c["changed_rows"] == 2
    assert pl.compare(make([(1, 1)]), make([(1, 1.0)], "id long, v double"), "id")["changed_rows"] == 0
    c = pl.compare(make([(None, 1), (1, 1)]), make([(None, 1), (1, 1)]), "id")
    assert (c["preserved"], c["dropped"], c["added"]) == (1, 1, 1)
    c = pl.compare(make([(i, 1) for i in range(100)]), make([(i, 2) for i in range(50, 150)], "key long, v long"), before_key="id", after_key="key")
    assert (c["preserved"], c["dropped"], c["added"], c["changed_rows"]) == (50, 50, 50, 50)
    assert pl.compare(make([]), make([(1, 1)]), "id")["row_ratio"] == float("inf")
    with pytest.raises(ContractError):
        pl.compare(make([]), make([]), "nope")


def test_relationship_probe(spark):
    make = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} long")
    r = pl.profile_relationship(make([1, 2, 1, 1, 3], "a"), make([1, 2, 3, 4], "b"), left_on="a", right_on="b")
    assert (r["left_unique_keys"], r["left_multiplicity_max"], r["right_unique_keys"], r["right_multiplicity_max"], r["left_keys_with_match"], r["right_keys_without_match"]) == (3, 3, 4, 1, 3, 1)
    r = pl.profile_relationship(make([1, 2, None, 3], "a"), make([1, None, None, 4], "a"), "a")
    assert (r["left_null_rate"], r["right_null_rate"], r["left_unique_keys"], r["right_unique_keys"]) == (0.25, 0.5, 3, 2)


def test_history(spark, users, tmp_path):
    store = pl.HistoryStore(spark, str(tmp_path / "state"))
    contract = {"name": "c", "rules": [{"name": "range", "params": {"column": "age", "max": 150}}, {"name": "not_null", "params": {"column": "email"}}]}
    assert pl.diff(contract, store) is None and not pl.has_runs(contract, store)
    pl.validate(users, contract, tally=True, store=store)
    pl.validate(users.where("age < 170 or email is null").limit(1000), contract, tally=True, store=store)
    pl.validate(users, contract, only=["range"], store=store)
    assert len(pl.get_history(contract, store)) == 2
    d = pl.diff(contract, store)
    assert [x["rule_id"] for x in d["improvement"]] == ["COL:age:range"] and not d["worse"]
    pl.annotate(contract, store, "looked at", rule_id="COL:age:range", actor="me")
    assert pl.get_run_with_annotations(contract, store)["annotations"][0]["note"] == "looked at"
    assert store.delete_old(pl.validate(users, contract).fingerprint, 1) == 1 and len(pl.get_history(contract, store)) == 1
    pl.profile(users, store=store)
    pl.profile(users.limit(50), store=store)
    assert len(pl.list_profiles(store)) == 2 and pl.profile_diff(store, "DataFrame")["row_delta"] == -53


def test_streaming_and_command_line(spark, users, tmp_path, capsys):
    from plumbline.cli import main
    from plumbline.streaming import batch_validator, observed

    users.write.parquet(str(tmp_path / "u.parquet"))
    seen = []
    rules = {"name": "c", "rules": [{"name": "range", "params": {"column": "age", "max": 150}}]}
    stream = spark.readStream.schema(users.schema).parquet(str(tmp_path / "u.parquet"))
    stream.writeStream.foreachBatch(batch_validator(rules, lambda r, i: seen.append(r.rules[0].failed_count), tally=True)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert sum(seen) == 4
    from pyspark.sql import Observation

    assert observed(users, rules, Observation("m")).count() == 103
    (tmp_path / "c.yml").write_text(json.dumps(rules | {"datasource": str(tmp_path / "u.parquet")}))
    assert main(["validate", str(tmp_path / "c.yml"), "--tally"]) == 1 and "COL:age:range" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "gone.yml")]) == 2 and main(["nonsense"]) == 2
    assert main(["profile", str(tmp_path / "u.parquet"), "--draft"]) == 0 and main(["init", str(tmp_path)]) == 0


def test_row_counts_by_footers_are_exact(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.range(10).write.parquet(path)
    rules = [pl.rules.min_rows(100), pl.rules.max_rows(4)]
    for tally in (None, True):
        by_path, by_frame = (pl.validate(x, rules=rules, tally=tally, spark=spark).rules for x in (path, spark.read.parquet(path)))
        assert [(r.failed_count, r.exact, r.passed) for r in by_path] == [(r.failed_count, r.exact, r.passed) for r in by_frame] == [(90, True, False), (6, True, False)]
    assert [r.source for r in by_path] == ["metadata"] * 2


def test_custom_sql_leaves_views_alone(spark, users):
    spark.range(7).createOrReplaceTempView("data")
    try:
        for sql, n in (("SELECT * FROM data WHERE age > 150", 4), ("WITH data2 AS (SELECT * FROM {table}) SELECT * FROM data2 WHERE age > 150", 4), ("SELECT COUNT(*) FROM {table} WHERE age > 150", 4)):
            assert pl.validate(users, rules=[pl.rules.custom_sql_check(sql)]).rules[0].failed_count == n
        assert spark.table("data").count() == 7 and not [t for t in spark.catalog.listTables() if t.name.startswith("plumbline_")]
    finally:
        spark.catalog.dropTempView("data")


def test_fail_fast_stops_early(spark):
    from plumbline.plans.fusion import early_any

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(0, 100_000, 1, 50).mapInArrow(count, "id long")
    masks = {"low": F.col("id") >= 0, "odd": F.col("id") % 2 == 1}
    assert early_any(df, masks) == ({"low": 1, "odd": 1}, None) and read.value < 20_000
    found, _ = early_any(df, masks | {"last": F.col("id") == 99_999, "never": F.col("id") < 0, "null": F.lit(None).cast("boolean")})
    assert found == {"low": 1, "odd": 1, "last": 1, "never": 0, "null": 0}
    rare = early_any(df, {"last": F.col("id") == 99_999, "never": F.col("id") < 0})
    assert rare[0] == {"last": 1, "never": 0} and early_any(df.limit(0), masks)[0] == {"low": 0, "odd": 0}


def test_exact_percentiles_in_brackets(spark, monkeypatch):
    import numpy as np

    from plumbline.operators import percentiles

    df = spark.range(6000).select((F.rand(1) * 1e6).alias("a"), (F.col("id") % 2).alias("b"), F.when(F.col("id") % 7 == 0, None).otherwise((F.rand(2) * 30).cast("int")).alias("c"), F.when(F.col("id") < 5990, 5.0).otherwise(F.col("id").cast("double")).alias("d"), F.lit(None).cast("double").alias("e")).cache()
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    for at_once in (200_000, 40):
        monkeypatch.setattr(percentiles, "SORTED_AT_ONCE", at_once)
        got = percentiles.exact_percentiles(df, {x: (F.col(x), shares) for x in "abcde"})
        for x in "abcd":
            values = [float(r[0]) for r in df.select(x).dropna().collect()]
            assert np.allclose(got[x], np.quantile(values, shares), rtol=1e-12)
        assert got["e"] == [None] * 5
    assert percentiles.exact_percentiles(df, {}) == {}


@pytest.mark.parametrize(("name", "yes", "no"), [("email", "a.b+c@d-e.org", "a@b"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"), ("phone_us", "+1 (555) 123-4567", "555-12-4567"), ("phone_intl", "+4930123456", "+0930123456"), ("url", "https://a.b/c?d", "ftp://a.b"), ("ipv4", "999.1.2.3", "1.2.3"), ("ipv6", "1:2:3:4:5:6:7:abcd", "::1"), ("iso_date", "2024-01-31", "2024-1-31"), ("iso_datetime", "2024-01-31T01:02:03Z", "2024-01-31"), ("hex_color", "#aBc123", "#abc"), ("credit_card", "4111 1111-11111111", "411"), ("ssn", "123-45-6789", "123456789"), ("zip_us", "12345-6789", "1234"), ("slug", "a-b2", "a--b"), ("json", "{1:\n2}", "x{}")])
def test_shapes(spark, name, yes, no):
    from plumbline.operators.profiler import pattern_shares

    row = pattern_shares(spark.createDataFrame([(yes,), (no,), (" ",), (None,)], "v string"), "v").first()
    assert row[name] == 0.5


def test_results_as_text_and_frames(spark, users):
    r = pl.validate(users, rules=[pl.rules.range("age", max=150), pl.rules.not_null("email")], tally=True, sample=3, details=True)
    assert r.samples_df(spark, "COL:age:range").count() == 3 and r.samples_df(spark).count() == 6 and "FAIL COL:age:range" in r.to_text()
    c = pl.compare(users.limit(0), users.select("user_id", "age"), "user_id")
    assert json.loads(c.to_json())["after_rows"] == 103 and "after_rows: 103" in c.to_llm() and c.to_dict()["added"] == 100
    assert "left_rows: 103" in pl.profile_relationship(users, users, "user_id").to_llm()
    with pytest.warns(DeprecationWarning):
        assert pl.scout(users, "scout").rows == 103
    with pytest.raises(ContractError):
        pl.rules.range("age")


def test_positions_of_violations(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(i, None if i % 3 == 0 else i) for i in range(20)], "i long, v long").coalesce(1).write.parquet(path)
    details = pl.validate(path, rules=[pl.rules.not_null("v")], tally=True, details=True, preplan=False, spark=spark).rules[0].details
    assert details["sample_positions"] == [0, 3, 6, 9, 12]
    in_memory = pl.validate(spark.createDataFrame([(None,)], "v long"), rules=[pl.rules.not_null("v")], tally=True, details=True).rules[0].details
    assert "sample_positions" not in in_memory and in_memory["null_count"] == 1


def test_own_rules_prove_by_footers(spark, tmp_path):
    from plumbline.operators.rules import REGISTRY

    class Above(pl.Rule):
        def mask(self, schema):
            return F.col(self.column) < self.params["least"]

        def to_preplan_predicates(self):
            return [(self.column, ">=", self.params["least"]), (self.column, "not_null", None)]

    pl.register_rule("above")(Above)
    try:
        path = str(tmp_path / "a.parquet")
        spark.range(5, 50).coalesce(1).write.parquet(path)
        found = [pl.validate(path, rules=[pl.rule("above", column="id", least=n)], spark=spark).rules[0] for n in (5, 6)]
        assert [(r.passed, r.source, r.failed_count) for r in found] == [(True, "metadata", 0), (False, "metadata", 1)]
    finally:
        REGISTRY.pop("above")


def test_samples_and_strategies_of_profiles(spark, users):
    from plumbline.operators.profiler import ColumnProfile, DatasetProfile, classified, drawn, keep_invariants

    df = spark.range(0, 10_000, 1, 20)
    assert drawn(df, 300)[0].distinct().count() == 300 and drawn(df, 300, how="head")[0].count() == 300
    assert 400 < drawn(df, share=0.05)[0].count() < 600 and drawn(df, share=0.3, how="blocks")[0].count() % 500 == 0
    assert drawn(df)[1] is False and pl.profile(users, sample=500).sampled is False
    assert {c: how for c, (_, how) in classified(users, ["status", "user_id"]).items()} == {"status": "low", "user_id": "medium"}
    p = pl.profile(users, "strategic")
    assert (p["status"].semantic_type, p["email"].nulls, p["status"].distinct) == ("category", 5, 4) and p["status"].top_values[0]["count"] > 20
    odd = DatasetProfile("x", "scan", 10, [ColumnProfile("a", "int", "int", 10, 0, 12, estimated=True), ColumnProfile("b", "int", "int", 10, 11, 3)])
    assert keep_invariants(odd) == ["b: 11 nulls of 10 rows"] and odd["a"].distinct == 10


def test_sources_of_text_and_stores(spark, tmp_path):
    from plumbline.sources.datasets import store_settings

    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    for mode in ("auto", "strict", "parquet"):
        assert pl.load(spark, str(tmp_path / "t.csv"), {"csv_mode": mode}).selectExpr("sum(a)").first()[0] == 3
    with pytest.raises(ContractError):
        pl.load(spark, str(tmp_path / "t.csv"), {"csv_mode": "no"})
    assert store_settings("abfss", {"connection_string": "AccountName=me;AccountKey=k=="}) == {"fs.azure.account.key.me.dfs.core.windows.net": "k=="}
    pl.load(spark, pl.SourceSpec.from_uri(str(tmp_path / "t.csv")))


def test_history_in_a_database(spark, users, tmp_path):
    from plumbline.operators.history import JdbcHistoryStore

    store = JdbcHistoryStore(spark, f"jdbc:derby:{tmp_path}/db;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    contract = {"name": "c", "rules": [{"name": "range", "params": {"column": "age", "max": 150}}]}
    assert not pl.has_runs(contract, store)
    for part in (users, users.where("age < 170"), users):
        pl.validate(part, contract, tally=True, store=store)
    runs = pl.get_history(contract, store)
    assert len(runs) == 3 and pl.get_run(contract, store, at=runs[1]["run_at"])["rules"][0]["failed_count"] == 2
    assert [x["rule_id"] for x in pl.diff(contract, store)["regression"]] == ["COL:age:range"]
    assert store.delete_old(runs[0]["contract_fp"], 2) == 1 and len(pl.get_history(contract, store)) == 2
    pl.annotate(contract, store, "seen")
    assert pl.get_annotations(contract, store)[0]["note"] == "seen"
