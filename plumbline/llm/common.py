"""Helpers that the corpus operators share: scratch tables, text batches, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all
    runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def kept_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, as a table in the shared folder; the scratch tables that it made on the way are removed."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        df = make()
    except BaseException:
        _scopes.remove(scope)
        raise
    _scopes.remove(scope)
    out = materialise(df, name)
    for path in scope:
        remove_scratch(spark, path)
    release(spark)
    return out


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: its lineage ends there, so a
    lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by sorting both. Else Spark sends a table whose compressed files are small to all
    executors, by way of the driver, where it may be many times as large."""
    return left.join(right.hint("merge"), on, how)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """The scratch tables of one run of an operator, by name, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table in the shared folder; shuffle files that led to it can go."""
        self.paths[name] = path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        release(self.spark)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            remove_scratch(self.spark, self.paths.pop(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = f"_{name}"
        while made.lower() in taken:
            made = f"_{made}"
        out.append(made)
    return out


def trim() -> None:
    """Give memory that this Python worker has freed back to the system, which else stays with it while it idles."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable, keeps_words: bool = False) -> Callable:
    """The map ``run`` over Arrow batches for a worker that other maps use before and after it: the word memo of former ones
    goes unless this one ``keeps_words``, and freed memory is given back at the end."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sys.modules.get("plumbline.llm.memo")
        if memo and not keeps_words:
            memo.forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose texts hold about ``most_bytes`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
