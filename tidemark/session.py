"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streaming state beyond the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Counting a store's rows costs a read before every write; only a metric needs it.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # A batch writes what it changed, not every file of the store anew.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A join of streams keeps one store a partition, not four: each is opened and committed on its own in every batch.
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on; partition counts stay the cluster's choice."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A throw-away local folder is used only in local mode, where driver and executors
    share one disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


_OPEN_SCOPES: list[list[str]] = []
_MARKED: set[str] = set()


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        where, files = _hadoop_path(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _MARKED.add(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table, in the shared folder."""
    path = f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _OPEN_SCOPES[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables made inside it at its end. Results that read them must be written by then."""
    _OPEN_SCOPES.append([])
    try:
        yield
    finally:
        for path in _OPEN_SCOPES.pop():
            where, files = _hadoop_path(spark, path)
            files.delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder, and read it back.

    A lost executor then costs one task's read instead of the whole chain. Being Parquet, the
    copy keeps column pruning and a known size for the joins that follow.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
