"""Tables written once to the folder that driver and executors share, and read back: the plan behind them is not run again, and lost executors lose nothing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_LEFT: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, an error on a cluster."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="nomena-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def written(d: DataFrame) -> DataFrame:
    """d as a table of its own. It stays until it is removed or the program ends, as results read it later; the shuffle files of the write go when it ends."""
    spark, path = d.sparkSession, f"{shared_dir(d.sparkSession)}/nomena-{uuid.uuid4().hex}"
    schema = d.schema
    _LEFT.append(path)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        d.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, what is written hands Python batches of at most so many rows: long texts or packed rows then fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    _delete([d._written for d in tables])


@atexit.register
def _sweep() -> None:
    _delete(list(_LEFT))


def _delete(paths: list[str]) -> None:
    jvm = SparkContext._jvm
    if not paths or jvm is None:
        return
    conf = jvm.org.apache.hadoop.conf.Configuration()
    for x in paths:
        at = jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(conf).delete(at, True)
        _LEFT.remove(x)
