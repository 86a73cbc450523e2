"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession, rows_per_batch: int = 1000) -> None:
    """Let Python workers import this library, and bound the rows that Arrow hands over at once (a setting of the session, read when queries run).

    Where executors don't see this folder, the library is to be given to them as Spark's py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, env.get("PYTHONPATH", ""))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))


def binaries(data: bytes, stops: np.ndarray) -> pa.Array:
    """The pieces of data between neighbouring stops, without a copy. (pa.array() never lets go of the buffers behind memoryviews.)"""
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh one in local mode; a cluster has to name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The open scopes of this thread, the innermost last: queries from several threads don't see each other's.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside, but for those to be kept, are deleted at the end: results are to be stored before."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, keep: bool = False, **options: object) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: later steps neither recompute it nor depend on the executors that did. options: of the writer."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    if _SCOPES.get() and not keep:
        _SCOPES.get()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote; nothing may read df afterwards."""
    _delete(df.sparkSession, df._stored_path)
