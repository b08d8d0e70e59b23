"""Where intermediate results go: the shared folder that the session names, never a folder of one machine."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import localfs

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.split("[")[0] == "local":
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        else:
            _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Arrow batches hold at most ``rows`` rows, where the session still has Spark's 10000: texts are long, and a batch is
    held by the executor and by the Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them again: cuts lineage, survives lost executors.

    No _SUCCESS file: nothing reads it. On a local file system no child processes (``localfs``).
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    options = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"} | localfs.options(df.sparkSession, path)
    df.write.options(**options).parquet(path)
    if _RUNNING:
        _RUNNING[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the tables that running operators have written, the innermost operator last.
_RUNNING: list[list[str]] = []


def in_scratch(label: str) -> Callable:
    """For operators whose work is done when they return: their result is written as one table, and all other tables that
    they wrote on the way are removed."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args, **options) -> DataFrame:
            _RUNNING.append([])
            try:
                lazy = operator(*args, **options)
                mine = list(_RUNNING[-1])
                out = materialize(lazy, label)
            finally:
                written = _RUNNING.pop()
            for path in written[: len(mine)]:
                _remove(out.sparkSession, path)
            if _RUNNING:
                _RUNNING[-1] += written[len(mine) :]
            return out

        return run

    return wrap


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint that keeps the partitions as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more: it only learns of them by the driver's garbage
    collection, which may be long in coming while executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote for this frame, when nothing reads it any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
