"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch while tables are staged: texts reach Python a few MB at a time, whatever the session's own setting.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder stands in on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="airgrid-")
        _own[app] = base
    return f"{base.rstrip('/')}/airgrid-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows for the jobs that run inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before) if int(before) > 0 else BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later uses neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = shared_folder(spark)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` gave back.  Nothing that is still to be computed may read them."""
    for df in tables:
        if path := _paths.pop(df, None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
