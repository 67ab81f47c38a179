"""Sources to lazy DataFrames: files, stores, databases, SQL, catalog tables and values in memory."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.model import ContractError

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}
#: Scheme, JDBC name, driver class and default port of the databases.
DATABASES = {"postgres": ("postgresql", "org.postgresql.Driver", 5432), "postgresql": ("postgresql", "org.postgresql.Driver", 5432), "mssql": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433), "sqlserver": ("sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433), "clickhouse": ("clickhouse", "com.clickhouse.jdbc.ClickHouseDriver", 8123)}


@dataclass(frozen=True)
class Query:
    """One read-only SELECT or WITH as a source; on ``database`` if that URI is given, else in Spark."""

    sql: str
    database: str | None = None

    def __post_init__(self):
        bare = re.sub(r"/\*.*?\*/|--[^\n]*", " ", self.sql, flags=re.S).strip().rstrip(";").strip()
        if not re.match(r"(select|with)\b", bare, re.I) or ";" in bare:
            raise ContractError("a query source is one SELECT or WITH statement")


@dataclass(frozen=True)
class SourceSpec:
    """What a URI says: scheme, path, format, and the options that the reader needs."""

    uri: str
    scheme: str
    path: str
    format: str
    options: dict[str, Any] = field(default_factory=dict)
    table: str | None = None

    @classmethod
    def from_uri(cls, uri: str, storage_options: dict[str, Any] | None = None) -> SourceSpec:
        parsed = urlparse(uri)
        scheme = parsed.scheme.lower() if "://" in uri else "file"
        options = dict(storage_options or {})
        if scheme in DATABASES:
            parts = [unquote(p) for p in parsed.path.split("/") if p]
            if len(parts) < 2:
                raise ContractError(f"a database source is {scheme}://user@host/database/schema.table")
            return cls(uri, scheme, parts[0], "jdbc", options, ".".join(parts[1:]))
        path = uri if "://" in uri else os.path.expanduser(uri)
        suffix = os.path.splitext(path.rstrip("/*"))[1].lower()
        kind = FORMATS.get(suffix, "parquet" if suffix == "" and ("*" in path or os.path.isdir(path.removeprefix("file://"))) else "unknown")
        if suffix == ".tsv":
            options.setdefault("sep", "\t")
        return cls(uri, scheme, path, options.pop("format", kind), options)


def store_settings(scheme: str, options: dict[str, Any]) -> dict[str, str]:
    """Hadoop settings of S3-like stores and of Azure from storage options, or from the usual environment variables."""
    if scheme not in ("s3", "s3a"):
        said = options.get("connection_string") or os.environ.get("AZURE_STORAGE_CONNECTION_STRING") or ""
        parts = dict(p.split("=", 1) for p in said.split(";") if "=" in p)
        known = {"AccountName": "account_name", "AccountKey": "account_key", "SharedAccessSignature": "sas_token"}
        options = {known[k]: v for k, v in parts.items() if k in known} | options
    get = lambda *names: next((str(options[n]) for n in names if options.get(n)), None) or next((os.environ[n.upper()] for n in names if os.environ.get(n.upper())), None)
    out: dict[str, str | None] = {}
    if scheme in ("s3", "s3a"):
        out = {"fs.s3a.access.key": get("aws_access_key_id"), "fs.s3a.secret.key": get("aws_secret_access_key"), "fs.s3a.session.token": get("aws_session_token"), "fs.s3a.endpoint": get("endpoint_url", "aws_endpoint_url"), "fs.s3a.endpoint.region": get("region", "aws_region", "aws_default_region")}
        if out["fs.s3a.endpoint"]:
            out["fs.s3a.path.style.access"] = "true"
        if out["fs.s3a.session.token"]:
            out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    elif scheme in ("abfs", "abfss", "az", "azure", "wasbs"):
        name = get("account_name", "azure_storage_account_name")
        host = f"{name}.dfs.core.windows.net"
        if name and get("account_key", "azure_storage_account_key"):
            out[f"fs.azure.account.key.{host}"] = get("account_key", "azure_storage_account_key")
        elif name and get("sas_token", "azure_storage_sas_token"):
            out |= {f"fs.azure.account.auth.type.{host}": "SAS", f"fs.azure.sas.fixed.token.{host}": get("sas_token", "azure_storage_sas_token")}
        elif name and get("client_secret", "azure_client_secret"):
            out |= {f"fs.azure.account.auth.type.{host}": "OAuth", f"fs.azure.account.oauth.provider.type.{host}": "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider", f"fs.azure.account.oauth2.client.id.{host}": get("client_id", "azure_client_id"), f"fs.azure.account.oauth2.client.secret.{host}": get("client_secret", "azure_client_secret"), f"fs.azure.account.oauth2.client.endpoint.{host}": f"https://login.microsoftonline.com/{get('tenant_id', 'azure_tenant_id')}/oauth2/token"}
    return {k: v for k, v in out.items() if v}


def jdbc_options(spec: SourceSpec) -> dict[str, str]:
    name, driver, port = DATABASES[spec.scheme]
    parsed = urlparse(spec.uri)
    host = f"{parsed.hostname}:{parsed.port or port}"
    url = f"jdbc:{name}://{host};databaseName={spec.path}" if name == "sqlserver" else f"jdbc:{name}://{host}/{spec.path}"
    out = {"url": url, "driver": driver}
    if parsed.username:
        out["user"] = unquote(parsed.username)
    if parsed.password:
        out["password"] = unquote(parsed.password)
    return out | {k: str(v) for k, v in spec.options.items()}


def read_spec(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The lazy DataFrame of a source. JDBC reads are parallel if ``partitionColumn`` is among the options; bounds that
    aren't given are looked up. ``csv_mode`` of text tables: ``auto``, ``strict`` (a malformed line is an error) or
    ``parquet`` (written once to the shared folder as Parquet, for several passes)."""
    if spec.format == "jdbc":
        options = jdbc_options(spec)
        if (column := options.get("partitionColumn")) and "lowerBound" not in options:
            plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}
            low, high = spark.read.format("jdbc").options(**plain, query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {spec.table}").load().first()
            options |= {"lowerBound": str(low), "upperBound": str(high)} if low is not None else {}
            options.setdefault("numPartitions", str(spark.sparkContext.defaultParallelism))
            options = plain if low is None else options
        return spark.read.format("jdbc").options(**options, dbtable=spec.table).load()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in store_settings(spec.scheme, spec.options).items():
        # each bucket has credentials of its own, so two stores don't overwrite each other's
        conf.set(k.replace("fs.s3a.", f"fs.s3a.bucket.{urlparse(spec.path).netloc}.", 1), v)
    path = re.sub(r"^s3://", "s3a://", spec.path)
    if spec.scheme in ("http", "https"):
        path = fetched(spark, path)
    if spec.format == "parquet":
        return spark.read.parquet(path)
    if spec.format == "csv":
        defaults = {"header": "true", "inferSchema": "true", "nullValue": "", "emptyValue": ""}
        mode = str(spec.options.get("csv_mode", "auto"))
        if mode not in ("auto", "strict", "parquet"):
            raise ContractError(f"{mode!r} isn't a csv_mode")
        more = {k: str(v) for k, v in spec.options.items() if k in ("sep", "header", "quote", "escape", "encoding", "inferSchema")}
        df = spark.read.options(**defaults | more | ({"mode": "FAILFAST"} if mode == "strict" else {})).csv(path)
        return staged(df, f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}") if mode == "parquet" else df
    if spec.format == "json":
        lines = os.path.splitext(path)[1].lower() != ".json" or str(spec.options.get("lines", "")).lower() == "true"
        return spark.read.option("multiLine", str(not lines).lower()).json(path)
    raise ContractError(f"the format of {spec.uri} isn't known; give format in the storage options")


def shared_folder(spark: SparkSession) -> str:
    """Where the driver can leave files that executors read: ``spark.checkpoint.dir``, or a folder of this machine where
    all runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/plumbline-sources"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='plumbline-')}"


def fetched(spark: SparkSession, url: str) -> str:
    """A file from the web, copied once to the shared folder by the driver."""
    import urllib.request

    name = os.path.basename(urlparse(url).path) or "file"
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, name)
        urllib.request.urlretrieve(url, local)
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), to)
    return target


def staged(df: DataFrame, folder: str) -> DataFrame:
    """A text source written once as Parquet and read back, for several passes over it."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _in_memory(spark: SparkSession, data: Any) -> DataFrame | None:
    if type(data).__module__.split(".")[0] == "pandas":
        if not len(data.columns):
            return spark.createDataFrame([], T.StructType([]))
        return spark.createDataFrame(data) if len(data) else spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in data.columns]))
    if type(data).__module__.split(".")[0] in ("pyarrow", "polars"):
        return spark.createDataFrame(data if hasattr(data, "to_batches") else data.to_arrow())
    if isinstance(data, dict):
        if data and all(isinstance(v, list | tuple) for v in data.values()):
            sizes = {len(v) for v in data.values()}
            if len(sizes) > 1:
                raise ContractError("the lists of a dict of lists differ in length")
            data = [dict(zip(data, row, strict=True)) for row in zip(*data.values(), strict=True)] or [dict.fromkeys(data)][:0]
        else:
            data = [data]
    if isinstance(data, list):
        if not all(isinstance(x, dict) for x in data):
            raise ContractError("a list must hold dicts")
        names = list(dict.fromkeys(k for row in data for k in row))
        empty = [n for n in names if all(row.get(n) is None for row in data)]
        if not data or len(empty) == len(names):
            return spark.createDataFrame([tuple(None for _ in names) for _ in data], T.StructType([T.StructField(n, T.StringType()) for n in names]))
        fields = []
        for n in names:
            kinds = {type(row[n]) for row in data if row.get(n) is not None}
            kind = T.StringType() if n in empty else T.DoubleType() if kinds == {int, float} else T._infer_type(next(row[n] for row in data if row.get(n) is not None))
            fields.append(T.StructField(n, kind))
        to = {f.name: float if isinstance(f.dataType, T.DoubleType) else lambda x: x for f in fields}
        return spark.createDataFrame([tuple(None if row.get(n) is None else to[n](row[n]) for n in names) for row in data], T.StructType(fields))
    return None


def load(spark: SparkSession, source: Any, storage_options: dict[str, Any] | None = None, table: str | None = None, config: dict[str, Any] | None = None) -> DataFrame:
    """Any source as a lazy DataFrame: a DataFrame itself, a URI or path, ``Query``, a catalog table or view, a named
    ``datasource.table`` of the configuration, pandas, Arrow or Polars frames, lists of dicts, a dict of lists, a dict."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Query):
        if source.database:
            spec = SourceSpec.from_uri(source.database.rstrip("/") + "/query", storage_options)
            return spark.read.format("jdbc").options(**jdbc_options(spec), query=source.sql.strip().rstrip(";")).load()
        return spark.sql(source.sql.strip().rstrip(";"))
    if isinstance(source, SourceSpec):
        return read_spec(spark, source)
    if isinstance(source, str):
        if "://" not in source and not os.path.exists(source) and not re.search(r"[/\\*]|\.(parquet|pq|csv|tsv|jsonl?|ndjson)$", source, re.I):
            from plumbline.sources.config import named_source

            found = named_source(source, config)
            if found is not None:
                return load(spark, found[0], found[1] | (storage_options or {}))
            name = f"{source}.{table}" if table else source
            if spark.catalog.tableExists(name):
                return spark.table(name)
            raise ContractError(f"{source!r} is no path, named source, table or view")
        return read_spec(spark, SourceSpec.from_uri(source, storage_options))
    if isinstance(source, os.PathLike):
        return read_spec(spark, SourceSpec.from_uri(os.fspath(source), storage_options))
    made = _in_memory(spark, source)
    if made is None:
        raise ContractError(f"{type(source).__name__} isn't a source")
    return made


def describe(source: Any) -> str:
    """A name for results; credentials are left out."""
    if isinstance(source, str):
        return re.sub(r"//[^/@]*@", "//", source)
    return type(source).__name__ if not isinstance(source, Query) else "query"
