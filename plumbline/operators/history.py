"""Run history: three append-only tables, differences of runs, annotations, profiles."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import ValidationResult
from plumbline.operators.profiler import DatasetProfile

RUNS = "run_id string, contract_fp string, contract string, dataset string, run_at timestamp, passed boolean, rows long, tally boolean, total int, failed int"
RULES = "run_id string, contract_fp string, rule_id string, name string, column string, severity string, passed boolean, failed_count long, exact boolean, failure_mode string, message string"
ANNOTATIONS = "run_id string, contract_fp string, rule_id string, actor string, kind string, note string, created_at timestamp, payload string"
PROFILES = "profile_id string, contract_fp string, source string, created_at timestamp, profile string"
_SCHEMAS = {"runs": RUNS, "rule_results": RULES, "annotations": ANNOTATIONS, "profiles": PROFILES}


def run_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rule_id, change, old and new counts): new_failure, resolved (also a failing rule that is gone), regression,
    improvement, unchanged; counts are compared only where both are exact."""
    side = lambda df, p: df.select("rule_id", F.col("passed").alias(f"{p}_passed"), F.col("failed_count").alias(f"{p}_failed"), F.col("exact").alias(f"{p}_exact"))
    j = side(old, "old").join(side(new, "new"), "rule_id", "full")
    was, now = F.coalesce("old_passed", F.lit(True)), F.coalesce("new_passed", F.lit(True))
    both = F.coalesce(F.col("old_exact") & F.col("new_exact"), F.lit(False))
    change = F.when(was & ~now, "new_failure").when(~was & now, "resolved").when(~was & ~now & both & (F.col("new_failed") > F.col("old_failed")), "regression").when(~was & ~now & both & (F.col("new_failed") < F.col("old_failed")), "improvement").otherwise("unchanged")
    return j.select("rule_id", change.alias("change"), F.coalesce("old_failed", F.lit(0)).alias("old_failed"), F.coalesce("new_failed", F.lit(0)).alias("new_failed"))


class HistoryStore:
    """Runs, rule results, annotations and profiles as Parquet tables under ``root`` (any store that Spark writes),
    partitioned by contract, so that reads prune to one contract."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, _SCHEMAS[table]).coalesce(1)
        df.write.mode("append").partitionBy("contract_fp").parquet(f"{self.root}/{table}")

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(path)

    def save(self, result: ValidationResult) -> str | None:
        """Append a run; runs of some rules only aren't kept."""
        if result.filtered:
            return None
        run_id = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:6]}"
        n = result.counts()
        self._append("rule_results", [(run_id, result.fingerprint, r.rule_id, r.name, r.column, r.severity, r.passed, r.failed_count, r.exact, r.failure_mode, r.message) for r in result.rules] or [])
        self._append("runs", [(run_id, result.fingerprint, result.contract, result.dataset, datetime.fromisoformat(result.run_at), result.passed, result.rows, result.tally, n["total"], n["failed"])])
        return run_id

    def runs(self, contract_fp: str | None = None, since: str | datetime | timedelta | None = None, failed_only: bool = False, limit: int | None = None) -> DataFrame:
        """Runs, the newest first."""
        out = self.table("runs")
        if contract_fp:
            out = out.where(F.col("contract_fp") == contract_fp)
        if since is not None:
            at = datetime.now(UTC) - since if isinstance(since, timedelta) else datetime.fromisoformat(since) if isinstance(since, str) else since
            out = out.where(F.col("run_at") >= F.lit(at if at.tzinfo else at.replace(tzinfo=UTC)))
        out = out.where("not passed") if failed_only else out
        out = out.orderBy(F.desc("run_at"), F.desc("run_id"))
        return out.limit(limit) if limit else out

    def run(self, contract_fp: str, run_id: str | None = None, before: str | None = None, at: str | datetime | None = None) -> dict[str, Any] | None:
        """A run with its rules: the latest, one by id, the last before another, or the last up to a time."""
        out = self.runs(contract_fp)
        if at is not None:
            moment = datetime.fromisoformat(at) if isinstance(at, str) else at
            out = out.where(F.col("run_at") <= F.lit(moment if moment.tzinfo else moment.replace(tzinfo=UTC)))
        out = out.where(F.col("run_id") == run_id) if run_id else out.where(F.col("run_id") < before) if before else out
        row = out.limit(1).collect()
        if not row:
            return None
        found = row[0].asDict()
        found["rules"] = [r.asDict() for r in self.rules(contract_fp, found["run_id"]).orderBy("rule_id").collect()]
        return found

    def rules(self, contract_fp: str, run_id: str) -> DataFrame:
        return self.table("rule_results").where((F.col("contract_fp") == contract_fp) & (F.col("run_id") == run_id))

    def has_runs(self, contract_fp: str) -> bool:
        return bool(self.runs(contract_fp).limit(1).count())

    def diff(self, contract_fp: str, old: str | None = None, new: str | None = None) -> DataFrame | None:
        """Difference of two runs, the last two by default; None if there aren't two."""
        two = [r["run_id"] for r in self.runs(contract_fp, limit=2).collect()]
        new = new or (two[0] if two else None)
        old = old or (next((r["run_id"] for r in self.runs(contract_fp).where(F.col("run_id") < new).limit(1).collect()), None) if new else None)
        return run_diff(self.rules(contract_fp, old), self.rules(contract_fp, new)) if old and new else None

    def annotate(self, contract_fp: str, run_id: str, note: str, rule_id: str | None = None, actor: str = "user", kind: str = "note", payload: dict | None = None) -> None:
        self._append("annotations", [(run_id, contract_fp, rule_id, actor, kind, note, datetime.now(UTC), json.dumps(payload) if payload else None)])

    def annotations(self, contract_fp: str, run_id: str | None = None, rule_id: str | None = None) -> DataFrame:
        out = self.table("annotations").where(F.col("contract_fp") == contract_fp)
        out = out.where(F.col("run_id") == run_id) if run_id else out
        return (out.where(F.col("rule_id") == rule_id) if rule_id else out).orderBy("created_at")

    def delete_old(self, contract_fp: str, keep: int) -> int:
        """Keep a contract's newest ``keep`` runs; its partitions are rewritten, annotations stay. Runs go before their
        rules, so a crash between the two leaves rules that no run leads to, and no run without rules."""
        known = [r["run_id"] for r in self.runs(contract_fp).select("run_id").collect()]
        gone = known[keep:]
        if not gone:
            return 0
        conf = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            for name in ("runs", "rule_results"):
                left = self.table(name).where((F.col("contract_fp") == contract_fp) & ~F.col("run_id").isin(gone))
                # what is read can't be overwritten at once, so it is written beside first
                beside = f"{self.root}/_{name}-{uuid.uuid4().hex}"
                left.coalesce(1).write.parquet(beside)
                kept = self.spark.read.schema(_SCHEMAS[name]).parquet(beside)
                kept.coalesce(1).write.mode("overwrite").partitionBy("contract_fp").parquet(f"{self.root}/{name}")
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", conf)
        return len(gone)

    def save_profile(self, p: DatasetProfile, key: str) -> str:
        profile_id = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:6]}"
        self._append("profiles", [(profile_id, key, p.source, datetime.now(UTC), p.to_json())])
        return profile_id

    def profiles(self, key: str | None = None) -> DataFrame:
        out = self.table("profiles")
        return (out.where(F.col("contract_fp") == key) if key else out).orderBy(F.desc("created_at"))

    def profile(self, key: str, profile_id: str | None = None) -> DatasetProfile | None:
        rows = self.profiles(key)
        found = (rows.where(F.col("profile_id") == profile_id) if profile_id else rows).limit(1).collect()
        return DatasetProfile.from_dict(json.loads(found[0]["profile"])) if found else None


class JdbcHistoryStore(HistoryStore):
    """The same tables in a database (PostgreSQL, SQL Server), through Spark's JDBC writer; needs the driver on the class
    path. A table that isn't there yet is empty. Keys without a value are empty texts there."""

    #: Columns that are compared or sorted by; the others are the database's texts without a bound.
    KEYS = ("run_id", "contract_fp", "rule_id", "profile_id", "name", "severity", "kind", "actor")

    def __init__(self, spark: SparkSession, url: str, prefix: str = "plumbline_", **options: str):
        super().__init__(spark, "jdbc")
        self.url, self.prefix, self.options = url, prefix, options

    def _append(self, table: str, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, _SCHEMAS[table]).coalesce(1)
        df = df.fillna("", [c for c in df.columns if c in self.KEYS])
        kinds = ", ".join(f"{c} VARCHAR(250)" for c in df.columns if c in self.KEYS)
        df.write.format("jdbc").options(url=self.url, dbtable=self.prefix + table, createTableColumnTypes=kinds, **self.options).mode("append").save()

    def _connection(self):
        jvm = self.spark.sparkContext._jvm
        settings = jvm.java.util.Properties()
        for k, v in self.options.items():
            settings.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, settings)

    def table(self, name: str) -> DataFrame:
        connection = self._connection()
        try:
            for spelled in (self.prefix + name, (self.prefix + name).upper()):
                found = connection.getMetaData().getTables(None, None, spelled, None)
                if found.next():
                    break
            else:
                return self.spark.createDataFrame([], _SCHEMAS[name])
        finally:
            connection.close()
        df = self.spark.read.format("jdbc").options(url=self.url, dbtable=self.prefix + name, **self.options).load()
        wanted = self.spark.createDataFrame([], _SCHEMAS[name]).schema
        value = lambda f: F.nullif(F.col(f.name), F.lit("")) if f.name in self.KEYS else F.col(f.name)
        return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in wanted])

    def delete_old(self, contract_fp: str, keep: int) -> int:
        """Keep a contract's newest ``keep`` runs, in one transaction; annotations stay."""
        gone = [r["run_id"] for r in self.runs(contract_fp).select("run_id").collect()][keep:]
        if not gone:
            return 0
        connection = self._connection()
        try:
            connection.setAutoCommit(False)
            for name in ("runs", "rule_results"):
                statement = connection.prepareStatement(f'DELETE FROM {self.prefix}{name} WHERE "contract_fp" = ? AND "run_id" = ?' if "derby" in self.url or "postgresql" in self.url else f"DELETE FROM {self.prefix}{name} WHERE contract_fp = ? AND run_id = ?")
                for run_id in gone:
                    statement.setString(1, contract_fp)
                    statement.setString(2, run_id)
                    statement.addBatch()
                statement.executeBatch()
            connection.commit()
        finally:
            connection.close()
        return len(gone)
