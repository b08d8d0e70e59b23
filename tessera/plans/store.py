"""Cutting long plans: results written as tables in the shared folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder of this application's tables, which goes when the driver's JVM ends (``release`` empties it before).

    It lies in ``spark.checkpoint.dir``; where that is unset, in a temporary folder in local mode and in the warehouse on a cluster.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = spark.sparkContext.master.split("[")[0] == "local"
            base = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir")
        _ROOTS[app] = f"{base.rstrip('/')}/tessera-{app}"
        path, fs = _path(spark, _ROOTS[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _ROOTS[app]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Removes every table written so far; frames that read them are of no use any more."""
    path, fs = _path(spark, root(spark))
    fs.delete(path, True)
    fs.mkdirs(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are kept inside go at its end, but for those of the keeper that it gives; so do shuffle files that no plan refers to any more."""
    app, outer = spark.sparkContext.applicationId, root(spark)
    _ROOTS[app] = f"{outer}/scratch-{uuid.uuid4().hex}"
    try:
        yield keeper(spark, outer)
    finally:
        path, fs = _path(spark, _ROOTS[app])
        _ROOTS[app] = outer
        fs.delete(path, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def keeper(spark: SparkSession, base: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function (frame, label) -> the same rows read from a table that it writes, in ``base`` if given."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = f"{base or root(spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
